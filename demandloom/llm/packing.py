"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by linear grouping.

1. Documents become pieces (only those longer than the capacity are cut) and the pieces a histogram: length -> count.
   The histogram has at most ``capacity`` rows, whatever the corpus' size; only it reaches the driver.
2. Large lengths are sorted and cut into groups of equal cardinality; every length of a group is rounded up to the
   group's largest. A linear program over configurations (multisets of group sizes that fit) is solved by column
   generation; the whole parts of its solution are used.
3. The actual pieces take the places of the rounded ones, run by run of equal lengths. What the whole parts left over,
   and all small lengths, are put in best-fit, longest first: always into the fullest sequence that still has room.
4. The result is a table of runs: pieces number ``from_rank .. from_rank+n-1`` of one length go to sequences
   ``first_sequence ..``, at one offset. Its size depends on the capacity and the number of groups, not on the corpus
   (see ``tests/llm``), so it is broadcast; each piece finds its run by its length and its rank among equal lengths.

Ranks are counted in hash buckets with prefix sums over bucket counts, so that one length shared by a third of the
corpus is not one task.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.common import release, saved, take_memory

CAPACITY = 4096
GROUPS = 96
GROUP_DOCS = 16
SMALL_SHARE = 3
PIVOTS = 2000
BUCKET_ROWS = 100_000
END_ID = 1
MEMO = 800_000
LONG = 64
SLICE_BYTES = 8 << 20
RUNS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("run_length", "from_rank", "run_pieces", "first_sequence", "run_offset")]
)


# ---------------------------------------------------------------- plan over lengths


@dataclass
class Plan:
    """Sequences as kinds: (first sequence, how many, tokens used); ``runs`` say which pieces fill them."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    rank: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    open: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    rooms: list[int] = field(default_factory=list)

    def place(self, length: int, first: int, count: int, offset: int) -> None:
        """One piece of ``length`` into each of ``count`` consecutive sequences."""
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def leave(self, first: int, count: int, room: int) -> None:
        if count and room:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((first, count))

    def fill(self, length: int, first: int, count: int, each: int, room: int) -> None:
        for j in range(each):
            self.place(length, first, count, self.capacity - room + j * length)
        self.leave(first, count, room - each * length)

    def best_fit(self, length: int, count: int) -> None:
        """Best fit: the tightest room takes as many of these pieces as it can before the next is touched."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, many = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
            else:
                room, first = self.capacity, self.sequences
                many = -(-count // (self.capacity // length))
                self.sequences += many
            each = room // length
            full = min(many, count // each)
            if full:
                self.fill(length, first, full, each, room)
                count -= full * each
            if full < many:
                if 0 < count < each:
                    self.fill(length, first + full, 1, count, room)
                    count, full = 0, full + 1
                self.leave(first + full, many - full, room)


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, in groups of equal cardinality; a length may span several groups."""
    total = sum(n for _, n in lengths)
    size = -(-total // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = size
    for length, n in lengths:
        while n:
            if room == 0:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value; sizes repeat as often as they fit."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for g in np.flatnonzero(values > 1e-12):
        s, v = int(sizes[g]), values[g]
        for _ in range(capacity // s):
            with_one = best[:-s] + v
            better = with_one > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = with_one[better]
            choice[s:][better] = g
    picked = np.zeros(len(sizes))
    at = int(best.argmax())
    total = best[at]
    while at > 0 and choice[at] >= 0:
        picked[choice[at]] += 1
        at -= int(sizes[choice[at]])
    return float(total), picked


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, pivots: int = PIVOTS) -> list[tuple[np.ndarray, int]]:
    """Whole parts of a column-generation solution of the configuration program: (pieces per group, sequences)."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(pivots):
        value, entering = _knapsack(sizes, inverse.sum(axis=0), capacity)
        # the walk back may meet a choice that a later, better one replaced: price what it found
        if entering @ sizes > capacity or min(value, float(inverse.sum(axis=0) @ entering)) <= 1 + 1e-7:
            break
        step = inverse @ entering
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        row = int(ratios.argmin())
        if not np.isfinite(ratios[row]):
            break
        pivot = inverse[row] / step[row]
        inverse -= np.outer(step, pivot)
        inverse[row] = pivot
        columns[:, row] = entering
        amount = np.maximum(inverse @ demand, 0)
    return [(columns[:, j].astype(int), int(np.floor(amount[j] + 1e-9))) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Runs for a histogram of piece lengths (1..capacity)."""
    out = Plan(capacity)
    counts = {int(a): int(n) for a, n in histogram.items() if n}
    if full := counts.pop(capacity, 0):
        out.place(capacity, 0, full, 0)
        out.sequences = full
    small = capacity // SMALL_SHARE
    large = sorted(((a, n) for a, n in counts.items() if a > small), reverse=True)
    number = min(groups, sum(n for _, n in large) // GROUP_DOCS)
    if number:
        stock = grouped(large, number)
        sizes = np.array([g[0][0] for g in stock])
        demand = np.array([float(sum(n for _, n in g)) for g in stock])
        for picked, many in configurations(sizes, demand, capacity):
            owners = [g for g in range(len(stock)) for _ in range(picked[g])]
            while many and owners:
                # the next run of sequences in which every place takes one length
                need = defaultdict(int)
                for g in owners:
                    need[g] += 1
                run = min([many, *(stock[g][-1][1] // n for g, n in need.items() if stock[g])], default=0)
                if any(not stock[g] for g in need):
                    break
                chosen = []
                if run:
                    chosen = [(g, stock[g][-1][0]) for g in owners]
                else:  # the last few of a length: one sequence, place by place
                    run, left = 1, {g: [list(x) for x in stock[g]] for g in need}
                    for g in owners:
                        while left[g] and left[g][-1][1] == 0:
                            left[g].pop()
                        if not left[g]:
                            break
                        left[g][-1][1] -= 1
                        chosen.append((g, left[g][-1][0]))
                    if len(chosen) < len(owners):
                        break
                offset, first = 0, out.sequences
                out.sequences += run
                for g, length in chosen:
                    out.place(length, first, run, offset)
                    offset += length
                    for at in range(len(stock[g]) - 1, -1, -1):
                        if stock[g][at][0] == length:
                            stock[g][at] = (length, stock[g][at][1] - run)
                            break
                    stock[g] = [x for x in stock[g] if x[1]]
                out.leave(first, run, capacity - offset)
                many -= run
        left = defaultdict(int)
        for g in stock:
            for length, n in g:
                left[length] += n
        large = sorted(left.items(), reverse=True)
    for length, n in large:
        out.best_fit(length, n)
    for length in sorted((a for a in counts if a <= small), reverse=True):
        out.best_fit(length, counts[length])
    return out


# ---------------------------------------------------------------- tokens


_ENCODERS: dict[str, object] = {}


class _Words:
    """Token ids of white-space separated chunks, as bytes; a chunk's ids don't depend on its neighbours.

    Arrow splits a slice of texts at ASCII white space and numbers its distinct chunks, so that Python handles each of
    them once a slice; the ids of whole texts are gathered by number. Latin letters between ASCII punctuation are looked
    up as three parts, the letters in lower case; any other chunk is one part, as it is written. Ids are remembered per
    part (at most ``MEMO`` and a slice's own). Unknown words are encoded many at a time, as one text whose ids are cut
    behind the vocabulary's word-end tokens; if their number isn't the number of words, one by one.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, stops = ids.tobytes(), (stops * 4).tolist()
                self.memo.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))))
            else:
                self.memo.update((w, self._one(w)) for w in some)

    def chunk_ids(self, lines: str) -> list[bytes]:
        """Ids of distinct chunks, given one a line."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = zip(_PARTS.findall(lines.lower()), lines.split("\n"), strict=True)
        parts = [p if p[1] else ("", chunk, "") for p, chunk in found]
        before, word, after = zip(*parts)
        fresh = set(filterfalse(memo.__contains__, chain(set(before), word, set(after))))
        words = [x for x in fresh if len(x) <= LONG and _letters(x)]
        self._learn(words)
        other = list(fresh.difference(words))
        for x, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            memo[x] = np.array(e.ids, dtype="<u4").tobytes()
        out = [memo[b] + memo[w] + memo[a] if a or b else memo[w] for b, w, a in parts]
        for x in other:
            if len(x) > LONG:
                del memo[x]
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids of whole texts, given as an Arrow array; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = chunks.flatten().dictionary_encode()
        distinct = numbered.dictionary
        if not len(distinct):
            return [b""] * len(texts)
        one = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
        lines = pc.binary_join(one, pa.scalar("\n", distinct.type))
        ids = pa.array(self.chunk_ids(lines[0].as_py()), pa.large_binary()).take(numbered.indices)
        _, ends, raw = ids.buffers()
        first = chunks.offsets.to_numpy()
        ends = np.frombuffer(ends, dtype=np.int64)[first - first[0]].tolist()
        return list(map((raw.to_pybytes() if raw else b"").__getitem__, map(slice, ends, ends[1:])))


# A chunk as punctuation, letters, punctuation; other chunks give three empty parts. The punctuation is all of ASCII's but
# the apostrophe; the letters, once lowered, are single code points of the Latin blocks, which are composed already.
_STOPS = "[!-&(-/:-@\\[-`{-~]*"
_PARTS = re.compile(f"^({_STOPS})([a-z\u00df-\u00f6\u00f8-\u024f]+)({_STOPS})$|^.*$", re.M)


def _letters(word: str) -> bool:
    """Whether a word is made of letters alone, also once it is normalised."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _slices(batch, most: int):
    """An Arrow batch in slices of about ``most`` bytes of text (column 1), of at least one row each."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, upto - at)
        at = upto
    release()


def tokenised(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids): little-endian 32-bit ids, each document closed by ``end_id``.

    ``definition`` is a tokenizer's JSON text; it travels to the tasks once, as a broadcast of its own size. Null
    texts count as empty (one piece with the end id alone).
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        take_memory("packing", _ENCODERS.clear)
        text = shared.value
        if text not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[text] = _Words(text)
        words = _ENCODERS[text]
        step = 4 * capacity
        for batch in batches:
            for part in _slices(batch, SLICE_BYTES):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1))):
                    ids += end
                    for at in range(0, len(ids), step):
                        cut = ids[at : at + step]
                        rows.append((doc_id, at // step, at // 4, len(cut) // 4, cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids binary"
    )


# ---------------------------------------------------------------- placement


def ranked(pieces: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``rank`` (from 0) among pieces of one length, and returns the histogram of lengths."""
    buckets = max(16, -(-total // BUCKET_ROWS))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    inside = Window.partitionBy("length", "bucket").orderBy(*keys)
    numbered = spread.withColumn("inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(bases.select("length", "bucket", "base"), ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .drop("bucket", "inside", "base"),
        histogram,
    )


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces (with a ``length`` of 1..capacity) with ``sequence_id`` and ``offset``; other columns stay.

    ``pieces`` is read three times, so it should be a written table. ``keys`` tell pieces apart; equal ones are placed
    one by one like any others.
    """
    spark = pieces.sparkSession
    numbered, histogram = ranked(pieces, keys, pieces.count())
    if any(not 1 <= a <= capacity for a in histogram):
        raise ValueError(f"piece lengths must be 1..{capacity}")
    runs = spark.createDataFrame(plan(histogram, capacity, groups).runs, RUNS)
    inside = (
        (F.col("length") == F.col("run_length"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("from_rank") + F.col("run_pieces"))
    )
    return (
        numbered.join(F.broadcast(runs), inside)  # bounded: see the module's text
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("from_rank"))
        .withColumnRenamed("run_offset", "offset")
        .drop("run_length", "from_rank", "run_pieces", "first_sequence", "rank")
    )


def pack_documents(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text): one row per piece, with its ids and its place."""
    return pack(saved(tokenised(docs, definition, capacity), "pieces"), ["doc_id", "piece"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids (little-endian 32-bit) in order of offsets; each is at most the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))

