"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter.

**Words.** Texts become one byte per code point (others than U+0000..U+00FF count as separators), are lower-cased (A-Z
only) and split by table look-up; counts are summed per task and then by word. A deterministic typo generator (one
code point of a run goes where a checksum of doc_id and run says so) is part of the definition of the words; checksums
are combined from those of the document's and the word's bytes, not computed again for every pair.

**Search.** A word is a point: how often it holds each letter (``AXES`` counters). One inserted or deleted letter moves
one counter by one, a replaced one lowers one counter and raises another (L1 distance at most two). Points of one
length are cells of a k-d tree; the tree is fitted on the driver to a bounded sample of words (``SAMPLE_WORDS``), while
all words are placed in its cells. A word is sent to the cells whose box it can reach in the trees of its own length and
the lengths beside it. In a cell, a local k-d tree is searched with the same box pruning, distances select
candidates, and the order of letters decides. Cells with more than ``CELL_WORDS`` words (or ``CELL_BYTES``) are split in
blocks; every block gets the cell's queries. Only counts and the best neighbour of each word leave a cell.

**Forms.** A word's form is its near word with the largest count (ties: the smallest) if that is at least twice its own.
Counts double along a chain of forms, so pointer jumping needs few joins.

Defined cases. Null texts hold no words; a null doc_id is written as an empty string in the checksum. Repeated rows
count again. An empty table gives no rows; other columns are ignored. Words have at least ``LEAST_LETTERS`` letters and
``LEAST_COUNT`` occurrences, without an upper limit of length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import release, saved, settle, take_memory

LEAST_LETTERS = 5
LEAST_COUNT = 3
TYPO_EVERY = 97
AXES = 32
SAMPLE_WORDS = 100_000
CELL_WORDS = 16_384
CELL_BYTES = 8 << 20
TREE_LENGTHS = 64  # longer words, of which a corpus has few, have one cell per length
BUCKET_WORDS = 24
MEMO_WORDS = 400_000
PAIRS_AT_ONCE = 2_000_000

_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() or c >= 0xC0 for c in range(256)])
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if _LETTER[c] else 32 for c in range(256))
# counters: a-z have one each, the other letters share the rest
_AXIS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (AXES - 26) for c in range(256)])


# ---------------------------------------------------------------- words


class _Known(dict):
    """Run (one byte per code point) -> number; checksums and lengths by number."""

    def __init__(self):
        super().__init__()
        self.runs: list[bytes] = []
        self.crc: list[int] = []
        self.utf8: list[int] = []
        self.bytes = 0

    def __missing__(self, run: bytes) -> int:
        number = self[run] = len(self.runs)
        self.runs.append(run)
        text = run if run.isascii() else run.decode("latin-1").encode()
        self.crc.append(zlib.crc32(text))
        self.utf8.append(len(text))
        self.bytes += len(run)
        return number


def _checksums(doc_ids: list, doc_of: np.ndarray, numbers: np.ndarray, known: _Known) -> np.ndarray:
    """crc32 of ``<doc_id>:<run>``. crc32(a + b) = crc32(a + zeros) ^ crc32(b) ^ crc32(zeros), zeros as long as b."""
    crc = np.array(known.crc, dtype=np.uint32)[numbers]
    sizes = np.array(known.utf8, dtype=np.int64)[numbers]
    pairs, at = np.unique(doc_of * (1 << 32) + sizes, return_inverse=True)
    part = np.empty(len(pairs), dtype=np.uint32)
    heads = {}
    for k, pair in enumerate(pairs.tolist()):
        doc, size = pair >> 32, pair & 0xFFFFFFFF
        if doc not in heads:
            heads[doc] = zlib.crc32(b"%s:" % (b"" if doc_ids[doc] is None else b"%d" % doc_ids[doc]))
        zeros = bytes(size)
        part[k] = zlib.crc32(zeros, heads[doc]) ^ zlib.crc32(zeros)
    return crc ^ part[at]


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n) per task, of words of LEAST_LETTERS letters and more."""

    def run(batches):
        import pyarrow as pa

        take_memory("spelling", lambda: None)
        known, counts, changed = _Known(), np.zeros(0, dtype=np.int64), {}

        def out():
            sums = dict(changed)
            for run, n in zip(known.runs, counts.tolist()):
                if n and len(run) >= LEAST_LETTERS:
                    sums[run] = sums.get(run, 0) + n
            words = list(sums)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([sums[w] for w in part], pa.int64())], names=["word", "n"]
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                numbers, doc_of = [], []
                for k, text in enumerate(part.column(1)):
                    runs = (text.as_py() or "").encode("latin-1", "replace").translate(_CLEAN).split()
                    numbers.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
                    doc_of.append(np.full(len(runs), k, dtype=np.int64))
                numbers, doc_of = np.concatenate(numbers), np.concatenate(doc_of)
                h = _checksums(ids, doc_of, numbers, known)
                typo = np.flatnonzero(h % TYPO_EVERY == 0)
                for number, value in zip(numbers[typo].tolist(), h[typo].tolist()):
                    run = known.runs[number]
                    cut = value % len(run)
                    if len(run) > LEAST_LETTERS:
                        word = run[:cut] + run[cut + 1 :]
                        changed[word] = changed.get(word, 0) + 1
                whole = np.bincount(np.delete(numbers, typo), minlength=len(known.runs))
                whole[: len(counts)] += counts
                counts = whole
                if len(known) + len(changed) > MEMO_WORDS or known.bytes > 32 << 20:
                    yield from out()
                    known, counts, changed = _Known(), np.zeros(0, dtype=np.int64), {}
        yield from out()
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``least`` occurrences."""
    return _counted(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---------------------------------------------------------------- k-d trees


def points(words: list[bytes]) -> np.ndarray:
    """Letter counts, one row per word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    axes = _AXIS[np.frombuffer(b"".join(words), dtype=np.uint8)]
    where = np.repeat(np.arange(len(words)), sizes) * AXES + axes
    return np.bincount(where, minlength=len(words) * AXES).reshape(-1, AXES).astype(np.int32)


class Tree:
    """K-d tree over letter counts: inner nodes (axis, value) send counts <= value to the left."""

    def __init__(self, sample: np.ndarray, most: float):
        self.axis: list[int] = []
        self.value: list[int] = []
        self.kids: list[tuple[int, int]] = []
        self.leaves = 0
        self._grow(sample, most)

    def _grow(self, sample: np.ndarray, most: float) -> int:
        """Number of the node made: inner nodes from 0, leaf k is -1 - k."""
        if len(sample) > most:
            for axis in np.argsort(-sample.var(axis=0), kind="stable").tolist():
                column = sample[:, axis]
                value = int(np.median(column))
                value -= value >= column.max()
                left = column <= value
                if left.any() and not left.all():
                    node = len(self.axis)
                    self.axis.append(axis)
                    self.value.append(value)
                    self.kids.append((0, 0))
                    self.kids[node] = (self._grow(sample[left], most), self._grow(sample[~left], most))
                    return node
                if column.min() == column.max():
                    break  # so are all others, with less variance
        self.leaves += 1
        return -self.leaves

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        leaf = np.zeros(len(x), dtype=np.int64)
        stack = [(0 if self.axis else -1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif len(rows):
                left = x[rows, self.axis[node]] <= self.value[node]
                stack += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return leaf

    def reach(self, x: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of x) of all boxes that a point can reach by raising one counter (``up``) and lowering one."""
        free, spent = -1, -2
        raised = np.full(len(x), free if up else spent)
        lowered = np.full(len(x), free if down else spent)
        stack = [(0 if self.axis else -1, np.arange(len(x)), raised, lowered)]
        while stack:
            node, rows, raised, lowered = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            axis, value = self.axis[node], self.value[node]
            here = x[rows, axis] + (raised == axis) - (lowered == axis)
            moved = (raised == axis) | (lowered == axis)
            fits = here <= value
            lower = ~fits & ~moved & (lowered == free) & (here - 1 <= value)
            go = fits | lower
            stack.append((self.kids[node][0], rows[go], raised[go], np.where(lower, axis, lowered)[go]))
            fits = here > value
            higher = ~fits & ~moved & (raised == free) & (here + 1 > value)
            go = fits | higher
            stack.append((self.kids[node][1], rows[go], np.where(higher, axis, raised)[go], lowered[go]))


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether deleting one letter of ``long`` gives ``short``."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= short.shape[1]


SAME, LONGER, SHORTER = 1, 2, 3  # what a query asks of a cell: words of its length, with one letter more, one less


class Cell:
    """Words of one length with a local k-d tree."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words = words
        self.counts = np.array(counts, dtype=np.int64)
        self.letters = _letters(words)
        self.points = points(words).astype(np.float32)
        self.norms = (self.points**2).sum(axis=1)
        self.tree = Tree(self.points, BUCKET_WORDS)
        leaf = self.tree.home(self.points)
        order = np.argsort(leaf, kind="stable")
        self.buckets = np.split(order, np.cumsum(np.bincount(leaf, minlength=self.tree.leaves))[:-1])
        # best first: largest count, then smallest word
        self.ranked = np.array(sorted(range(len(words)), key=lambda k: (-counts[k], words[k])), dtype=np.int64)
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[self.ranked] = np.arange(len(words))

    def near(self, words: list[bytes], kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``words``, rows of the cell) of all pairs that differ by one letter."""
        x = points(words)
        own = _letters(words)
        xf = x.astype(np.float32)
        norms = (xf**2).sum(axis=1)
        found = ([], [])
        waiting = 0
        for leaf, rows in self.tree.reach(x, kind != SHORTER, kind != LONGER):
            bucket = self.buckets[leaf]
            step = max(1, PAIRS_AT_ONCE // len(bucket))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                # counters are whole numbers: within one raised and one lowered exactly if the squares add up to 2 at most
                square = norms[part, None] + self.norms[bucket] - 2 * (xf[part] @ self.points[bucket].T)
                i, j = np.nonzero(square <= (2.5 if kind == SAME else 1.5))
                found[0].append(part[i])
                found[1].append(bucket[j])
                waiting += len(i)
                if waiting > PAIRS_AT_ONCE // 8:
                    yield self._checked(own, np.concatenate(found[0]), np.concatenate(found[1]), kind)
                    found, waiting = ([], []), 0
        if waiting:
            yield self._checked(own, np.concatenate(found[0]), np.concatenate(found[1]), kind)

    def _checked(self, own, i, j, kind):
        keep = np.zeros(len(i), dtype=bool)
        step = max(1, PAIRS_AT_ONCE * 8 // own.shape[1])
        for at in range(0, len(i), step):
            a, b = own[i[at : at + step]], self.letters[j[at : at + step]]
            keep[at : at + step] = one_replaced(a, b) if kind == SAME else one_inserted(a, b) if kind == LONGER else one_inserted(b, a)
        return i[keep], j[keep]

    def answer(self, words: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of near words, and the row of the best one (-1 if none)."""
        number = np.zeros(len(words), dtype=np.int64)
        low = np.full(len(words), len(self.words), dtype=np.int64)
        for i, j in self.near(words, kind):
            number += np.bincount(i, minlength=len(words))
            np.minimum.at(low, i, self.rank[j])
        return number, np.where(number > 0, self.ranked[np.minimum(low, len(self.words) - 1)], -1)


# ---------------------------------------------------------------- the search on Spark


def fit_trees(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, Tree]:
    """A tree per length up to TREE_LENGTHS, from at most about ``sample_words`` words drawn by hash."""
    short = words.filter(F.char_length("word") <= TREE_LENGTHS)
    total = short.count()
    share = min(1.0, sample_words / max(1, total))
    drawn = short if share == 1 else short.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    by_length: dict[int, list[bytes]] = {}
    for r in drawn.select("word").toLocalIterator():
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    return {size: Tree(points(sorted(of)), max(1.0, cell_words * share)) for size, of in by_length.items()}


def _spread(batches, trees: dict[int, Tree], blocks: dict[int, int]):
    """Rows (cell, block, kind, word, n): a word at home in its cell, and as a query in all cells it can reach."""
    import pyarrow as pa

    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        counts = np.array(batch.column(1).to_pylist(), dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        columns: list[list[np.ndarray]] = [[], [], [], []]

        def add(cells, block, kind, rows):
            for column, value in zip(columns, (cells, block, np.full(len(rows), kind, dtype=np.int32), rows)):
                column.append(value)

        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            x = points([words[k] for k in of])
            tree = trees.get(size)
            home = (size << 32) + (tree.home(x) if tree else np.zeros(len(of), dtype=np.int64))
            split = np.array([blocks.get(c, 1) for c in home.tolist()], dtype=np.int64)
            mixed = np.array([zlib.crc32(words[k]) for k in of], dtype=np.int64)
            add(home, (mixed % split).astype(np.int32), 0, of)
            for kind, other in ((SAME, size), (LONGER, size + 1), (SHORTER, size - 1)):
                tree = trees.get(other)
                if tree:
                    reached = tree.reach(x, kind != SHORTER, kind != LONGER)
                else:
                    reached = [(0, np.arange(len(of)))]
                for leaf, rows in reached:
                    cell = (other << 32) + leaf
                    for block in range(blocks.get(cell, 0)):
                        add(np.full(len(rows), cell), np.full(len(rows), block, dtype=np.int32), kind, of[rows])
        cells, block, kind, rows = (np.concatenate(c) for c in columns)
        for at in range(0, len(rows), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells[cut], pa.int64()),
                    pa.array(block[cut], pa.int32()),
                    pa.array(kind[cut], pa.int32()),
                    batch.column(0).take(pa.array(rows[cut])),
                    pa.array(counts[rows[cut]], pa.int64()),
                ],
                names=["cell", "block", "kind", "word", "n"],
            )


def _cells(words: DataFrame, trees: dict[int, Tree], most: int) -> dict[int, int]:
    """Number of blocks of each cell that has words; their number is bounded by the trees and the lengths."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            sizes = np.array([len(w) for w in own], dtype=np.int64)
            home = sizes << 32
            for size in np.unique(sizes).tolist():
                if size in trees:
                    of = np.flatnonzero(sizes == size)
                    home[of] += trees[size].home(points([own[k] for k in of]))
            cells, n = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    sums = words.select("word").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r["cell"]: -(-r["n"] // max(1, min(most, CELL_BYTES // (r["cell"] >> 32)))) for r in sums.collect()}


def _search(batches):
    """Answers of sorted rows (cell, block, kind, word, n): the home words of a block come first."""
    import pyarrow as pa

    take_memory("spelling", lambda: None)
    at, cell, words, counts = None, None, [], []
    for batch in batches:
        cells, blocks, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(cells):
            continue
        edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
            if (cells[a], blocks[a]) != at:
                at, cell, words, counts = (cells[a], blocks[a]), None, [], []
            part = batch.slice(a, b - a)
            own = [w.encode("latin-1") for w in part.column(3).to_pylist()]
            if kinds[a] == 0:
                words += own
                counts += part.column(4).to_pylist()
                continue
            if not words:
                continue
            cell = cell or Cell(words, counts)
            number, best = cell.answer(own, int(kinds[a]))
            hit = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(3).take(pa.array(hit)),
                    part.column(4).take(pa.array(hit)),
                    pa.array(number[hit], pa.int64()),
                    pa.array(-cell.counts[best[hit]], pa.int64()),
                    pa.array([cell.words[k].decode("latin-1") for k in best[hit].tolist()], pa.string()),
                ],
                names=["word", "n", "n_near", "less", "form"],
            )


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n) of distinct words of letters up to U+00FF with their counts."""
    trees = fit_trees(words, cell_words, sample_words)
    blocks = _cells(words, trees, cell_words)
    rows = words.select("word", "n").mapInArrow(
        lambda batches: _spread(batches, trees, blocks), "cell long, block int, kind int, word string, n long"
    )
    dealt = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = dealt.mapInArrow(_search, "word string, n long, n_near long, less long, form string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form")))
    return (
        found.unionByName(none)
        .groupBy("word", "n")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .withColumn("good", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
        .select(
            "word",
            "n",
            "n_near",
            F.when(F.col("good"), F.col("best.form")).alias("form"),
            F.when(F.col("good"), -F.col("best.less")).alias("form_n"),
        )
    )


def with_roots(variants: DataFrame) -> DataFrame:
    """Adds ``root``: the end of the chain of forms. Every round doubles the length of the chains followed."""
    step = settle(variants.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = step.join(onward, "root", "left")
        step = settle(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            break
        step = step.drop("moved")
    return variants.join(step.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (doc_id, text)."""
    words = saved(vocabulary(docs), "spelling-words")
    return with_roots(saved(near_words(words), "spelling-near")).select("word", "form", "root", "n", "n_near", "form_n")
