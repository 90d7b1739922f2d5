"""Near-duplicate join on word shingles with Bayesian candidate pruning.

Documents whose sets of five-word shingles are equal form a *class*; a class is compared once. Two classes are linked
if the Jaccard similarity of their sets is at least 0.8.

1. Each class gets ``BANDS * ROWS`` one-byte MinHash values. Classes that agree on all values of a band meet in a
   bucket; a linked pair misses all buckets with a probability below 1e-6 (``missed(0.8)``).
2. In the buckets, pairs are compared a few values at a time. After each step the posterior probability that their
   similarity reaches the threshold (uniform prior) is known from the number of agreements; below the tolerance the
   pair is dropped. What remains of a bucket leaves as a spanning forest, never as pairs.
3. Components of these links bring all possible partners together. Their members' shingle sets are compared: again
   pruned step by step, and the rest verified exactly. Links leave as counts per class and spanning forests.
4. Components of verified links are the groups.

Large buckets and components are dealt out in blocks: a cell holds two blocks, every pair of members meets in exactly
one cell, and cells are spread over tasks. No pair is ever a row. Counting the links of n mutually linked classes
needs about n*n/2 comparisons, which the cells share.

Null and empty texts have no shingles: no links, each its own group. Texts of one to four words are one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import rows_of, settle, take_memory
from demandloom.llm.components import components
from demandloom.llm.shingles import MinHash, forget, shingle_set

THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 36, 5
VALUES = BANDS * ROWS
STEP = 36
BUCKET_BLOCK = 1024
SET_BLOCK = 256
_MINHASH = MinHash(VALUES)


def missed(similarity: float) -> float:
    """Probability that a pair shares no bucket."""
    return (1 - similarity**ROWS) ** BANDS


_LEAST: dict[float, np.ndarray] = {}


def _least(threshold: float) -> np.ndarray:
    """For each number of compared values: the fewest agreements that keep a pair."""
    if threshold not in _LEAST:
        full = np.zeros(VALUES + 1, dtype=np.int64)
        s = (np.arange(4000) + 0.5) / 4000
        p = s + (1 - s) / 256  # one-byte values of different shingles agree by chance
        for k in range(STEP, VALUES + 1, STEP):
            m = np.arange(k + 1)[:, None]
            likelihood = m * np.log(p) + (k - m) * np.log1p(-p)
            weight = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
            enough = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1) >= TOLERANCE
            full[k] = int(np.argmax(enough)) if enough.any() else k
        _LEAST[threshold] = full
    return _LEAST[threshold]


def surviving(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Positions of the pairs (a, b) that the incremental comparison keeps."""
    least = _least(threshold)
    kept = np.arange(len(a))
    agreed = np.zeros(len(a), dtype=np.int64)
    for at in range(0, VALUES, STEP):
        agreed += (sigs[a[kept], at : at + STEP] == sigs[b[kept], at : at + STEP]).sum(axis=1)
        stay = agreed >= least[at + STEP]
        kept, agreed = kept[stay], agreed[stay]
        if not len(kept):
            break
    return kept


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def cell_pairs(side: np.ndarray, same: bool, most: int = 200_000):
    """Pairs of positions of a cell in portions: all pairs of one block, or pairs across two."""
    n = len(side)
    if same and n <= 64:
        if n not in _TRIANGLES:
            _TRIANGLES[n] = np.triu_indices(n, 1)
        yield _TRIANGLES[n]
        return
    left = np.arange(n) if same else np.flatnonzero(side == side.min())
    right = np.arange(n) if same else np.flatnonzero(side == side.max())
    step = max(1, most // max(1, len(right)))
    for at in range(0, len(left), step):
        a, b = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
        if same:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a, b


# ---------------------------------------------------------------- profiles


def class_of(grams: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(grams, digest_size=8).digest(), "little", signed=True)


def profiles(docs: DataFrame, with_sets: bool = False) -> DataFrame:
    """(doc_id, cls, n, sig): fingerprint of the shingle set, its size, one-byte MinHash values; optionally the set."""
    schema = "doc_id long, cls long, n int, sig binary" + (", grams binary" if with_sets else "")

    def run(batches):
        import pyarrow as pa

        take_memory("shingles", forget)
        for batch in batches:
            for part in rows_of(batch, 512):
                rows = []
                for text in part.column(1).to_pylist():
                    grams = shingle_set(text)
                    raw = grams.tobytes()
                    cls = class_of(raw)
                    sig = ((_MINHASH.minima(grams) >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes()
                    rows.append((cls, len(grams), sig, raw))
                cls, n, sig, raw = zip(*rows)
                arrays = [part.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())]
                if with_sets:
                    arrays.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _cells(size: Column, member: Column, block: int) -> Column:
    """The cells (i, j, own block) that a member of a group of ``size`` goes to."""
    blocks = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), own.alias("side")),
    )


def _by_cell(batches, columns: list[str]):
    """Complete cells of sorted batches: arrow tables whose last cell is finished, with the cells' borders."""
    import pyarrow as pa

    held = None

    def borders(table):
        keys = [table.column(c).to_numpy() for c in columns]
        changed = np.zeros(table.num_rows, dtype=bool)
        changed[:1] = True
        for k in keys:
            changed[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = borders(held)
        if len(starts) > 1:
            done = held.slice(0, starts[-1])
            held = held.slice(starts[-1]).combine_chunks()
            yield done, [*starts[:-1].tolist(), done.num_rows]
    if held is not None and held.num_rows:
        yield held, [*borders(held).tolist(), held.num_rows]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, VALUES)


def possible_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join every pair of classes which may be similar enough; a forest per bucket."""
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * ROWS + 1, F.lit(ROWS)))
    )
    entries = classes.select("cls", F.explode(band).alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = entries.join(shared, "band").join(classes.select("cls", "sig"), "cls")
    dealt = met.select("band", "cls", "sig", F.explode(_cells(F.col("size"), F.col("cls"), BUCKET_BLOCK)).alias("cell")).select(
        "band", "cell.i", "cell.j", "cell.side", "cls", "sig"
    )

    def run(batches):
        import pyarrow as pa

        take_memory("cells", lambda: None)
        for table, ends in _by_cell(batches, ["band", "i", "j"]):
            sigs, cls = _matrix(table.column("sig")), table.column("cls").to_numpy()
            side, i, j = (table.column(c).to_numpy() for c in ("side", "i", "j"))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            waits = 0

            def work():
                a, b = (np.concatenate(x) for x in zip(*waiting))
                kept = surviving(sigs, a, b, threshold)
                links.append((a[kept], b[kept]))
                waiting.clear()

            for low, high in zip(ends, ends[1:]):
                if high - low < 2:
                    continue
                for a, b in cell_pairs(side[low:high], i[low] == j[low]):
                    waiting.append((a + low, b + low))
                    waits += len(a)
                    if waits > 100_000:
                        work()
                        waits = 0
            if waiting:
                work()
            if not links:
                continue
            a, b = (np.concatenate(x) for x in zip(*links))
            label = forest(len(cls), a, b)
            moved = np.flatnonzero(label != np.arange(len(cls)))
            x, y = cls[moved], cls[label[moved]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cls, label, links, doc_links) per cell for (component, size, cls, docs, n, sig, grams).

    ``label`` is a class linked to ``cls`` in this cell by a chain of verified links, or itself.
    """
    dealt = members.select("component", "cls", "docs", "sig", "grams", F.explode(_cells(F.col("size"), F.col("cls"), SET_BLOCK)).alias("cell")).select(
        "component", "cell.i", "cell.j", "cell.side", "cls", "docs", "sig", "grams"
    )
    share = threshold / (1 + threshold)

    def run(batches):
        import pyarrow as pa

        take_memory("cells", lambda: None)
        for table, ends in _by_cell(batches, ["component", "i", "j"]):
            sigs, cls, docs = _matrix(table.column("sig")), table.column("cls").to_numpy(), table.column("docs").to_numpy()
            side, i, j = (table.column(c).to_numpy() for c in ("side", "i", "j"))
            grams = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
            n = np.array([len(g) for g in grams])
            links, weight = np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
            chained: list[tuple[np.ndarray, np.ndarray]] = []
            for low, high in zip(ends, ends[1:]):
                if high - low < 2:
                    continue
                codes = np.unique(np.concatenate(grams[low:high]), return_inverse=True)[1]
                starts = np.concatenate([[0], np.cumsum(n[low:high])])
                mark = np.zeros(int(codes.max()) + 1, dtype=np.int64)
                own: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b in cell_pairs(side[low:high], i[low] == j[low]):
                    fits = np.minimum(n[a + low], n[b + low]) >= np.ceil(threshold * np.maximum(n[a + low], n[b + low]) - 1e-9)
                    a, b = a[fits], b[fits]
                    kept = surviving(sigs, a + low, b + low, threshold)
                    a, b = a[kept], b[kept]
                    edges = np.flatnonzero(np.diff(a, prepend=-1))
                    for s, e in zip(edges, [*edges[1:], len(a)]):
                        x, ys = a[s], b[s:e]
                        mine = codes[starts[x] : starts[x + 1]]
                        mark[mine] = 1
                        lengths = n[low + ys]
                        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                        at = np.arange(lengths.sum()) + np.repeat(starts[ys] - first, lengths)
                        common = np.add.reduceat(mark[codes[at]], first)
                        mark[mine] = 0
                        good = ys[common >= np.ceil(share * (n[low + x] + lengths) - 1e-9)]
                        if len(good):
                            links[low + x] += len(good)
                            weight[low + x] += docs[low + good].sum()
                            links[low + good] += 1
                            weight[low + good] += docs[low + x]
                            own.append((np.full(len(good), x), good))
                if own:  # a forest of this cell is enough for the groups
                    a, b = (np.concatenate(x) for x in zip(*own))
                    label = forest(high - low, a, b)
                    moved = np.flatnonzero(label != np.arange(high - low))
                    chained.append((moved + low, label[moved] + low))
            label = cls.copy()
            for a, b in chained:
                label[a] = cls[b]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls, label, links, weight)], names=["cls", "label", "links", "doc_links"])

    return (
        dealt.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(run, "cls long, label long, links long, doc_links long")
    )


# ---------------------------------------------------------------- join


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, cls, group_key, class_id, group_size, copies, links, doc_links.

    ``group_key``: any number of the group; ``class_id``: smallest doc_id of the group; ``links``: other classes linked to the document's class;
    ``doc_links``: other documents linked to it, copies of its own class included.
    """
    base = settle(profiles(docs))
    classes = settle(
        base.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )
    near = components(possible_links(classes, threshold))
    sizes = near.groupBy("component").agg(F.count("*").alias("size"))
    inside = settle(near.join(sizes, "component").join(classes.select(F.col("cls").alias("node"), "rep", "docs"), "node"))
    # the sets of these classes only, from the text of one of their documents; a class whose documents all lack
    # a doc_id has no rep and finds its text among the rows without one
    reps = inside.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text")
    wanted = texts.join(reps, "doc_id", "left_semi").unionByName(texts.filter("doc_id IS NULL"))
    facts_of = inside.select("component", "size", "docs", F.col("node").alias("cls"), "rep")
    sets = (
        profiles(wanted, with_sets=True)
        .join(facts_of, "cls")
        .filter(F.col("doc_id").eqNullSafe(F.col("rep")))
        .drop("rep")
        .dropDuplicates(["cls"])
    )
    checked = settle(verified(sets, threshold))
    groups = components(checked.filter("cls <> label").select(F.col("cls").alias("a"), F.col("label").alias("b")))
    degrees = checked.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    named = (
        classes.select("cls", "rep", "docs")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("group", F.coalesce("component", "cls"))
    )
    totals = named.groupBy("group").agg(F.min("rep").alias("class_id"), F.sum("docs").alias("group_size"))
    facts = named.join(totals, "group").join(degrees, "cls", "left").select(
        "cls",
        F.col("group").alias("group_key"),
        "class_id",
        "group_size",
        F.col("docs").alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("docs") - 1).alias("doc_links"),
    )
    found = base.filter("n > 0").select("doc_id", "cls").join(facts, "cls")
    empty = base.filter("n = 0").select(
        "doc_id", "cls", F.col("cls").alias("group_key"), F.col("doc_id").alias("class_id"), *[F.lit(v).cast("long").alias(c) for c, v in (("group_size", 1), ("copies", 1), ("links", 0), ("doc_links", 0))]
    )
    return found.unionByName(empty)


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the class of each row's text as column ``name``."""
    spot = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        take_memory("shingles", forget)
        for batch in batches:
            for part in rows_of(batch, 512):
                cls = pa.array([class_of(shingle_set(t).tobytes()) for t in part.column(spot).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, cls], names=[*part.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: that with the largest doc_id. Documents without words all stay.

    Rows are decided one by one, also where they share a doc_id; of rows equal in doc_id and class one stays.
    Rows without a doc_id stay.
    """
    marks = settle(near_duplicates(docs, threshold))
    grouped = marks.filter("group_size > 1").select("group_key", "doc_id", "cls")
    keepers = settle(grouped.groupBy("group_key").agg(F.max(F.struct("doc_id", "cls")).alias("k")).select("k.*"))
    gone = settle(grouped.select("doc_id", "cls").join(keepers, ["doc_id", "cls"], "left_anti").distinct())
    shared = settle(marks.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    once = docs.join(shared, "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti")
    if shared.isEmpty():
        return once.select(docs.columns)
    several = with_class(docs.join(shared, "doc_id", "left_semi").select(docs.columns), "_near_class")
    winners, losers = (x.select("doc_id", F.col("cls").alias("_near_class")) for x in (keepers, gone))
    on = ["doc_id", "_near_class"]
    stay = settle(several.join(losers, on, "left_anti").select(several.columns))
    single = stay.join(winners, on, "left_semi").select(several.columns).dropDuplicates(on)
    rest = stay.join(winners, on, "left_anti").select(several.columns)
    return once.select(docs.columns).unionByName(single.unionByName(rest).select(docs.columns))
