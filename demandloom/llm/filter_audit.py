"""Interaction of text filters: what each filter removes in every order of application.

Five filters look at whole texts (null counts as empty; words are runs of bytes other than space and tab to carriage
return, case-sensitive). A text fails

* A with under 50 words, B with 100 * distinct words < 65 * words, C with 100 * ``[A-Z]`` > 5 * code points,
* D if it holds any of ``#$%&*|``, E if a row with a smaller doc_id has the same text.

**Duplicate flags** come from compressed radix tries whose terminals hold the smallest doc_id of a text.

1. *Map side.* Every task puts its texts into a trie. A row whose id is larger than its terminal's is decided there, so
   one row per text and task goes on, however many copies there are. The trie is emptied after ``FLUSH_BYTES``.
2. *Adaptive prefixes.* Texts are dealt by a prefix that is short where texts are few and grows (``DEPTHS``) where
   one prefix holds more bytes than a fraction of a partition; equal texts share a prefix at any depth. Prefixes are
   range-partitioned, so that a task's texts share their beginnings.
3. *Reduce side.* Every task merges its texts into a trie; the traversal gives the flags.

Texts are compared in full, by walking edges. The five flags of a row make a mask; masks are counted by part and label
before anything else, so the 120 orders cost 32 cells a part.

Defined cases. A null doc_id never fails E and makes no other row fail. Rows with equal doc_id and text don't fail E by
each other. A null source is the part ``''``. Of several label rows for a doc_id, any that says 1 counts. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import release, saved, take_memory

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
FLUSH_BYTES = 64 << 20
DEPTHS = (8, 32, 128, 512, 2048)
SHARE = 4  # a prefix is refined from 1/SHARE of a partition's bytes on
OUT_ROWS = 4096

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # of bytes: splits at ASCII white space only
    n = len(words)
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n < 50)
        | (100 * len(set(words)) < 65 * n) << 1
        | (100 * capitals > 5 * points) << 2
        | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    )


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, which differ before the label's end."""
    low, high = 0, len(label)
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low


class Trie:
    """Compressed radix trie over byte strings. A node is [edge label, children by first byte, smallest id, holders].

    ``holders`` counts the rows of the smallest id by what they carry (part and mask).
    """

    def __init__(self):
        self.root: list = [b"", {}, None, None]
        self.bytes = 0

    def offer(self, text: bytes, doc_id: int, held: tuple, n: int = 1):
        """Insert a text; yields (id, held, n) of the rows that are now known to repeat a smaller id's text."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, doc_id, {held: n}]
                self.bytes += len(text) - at + 400
                return
            if text.startswith(child[0], at):
                node, at = child, at + len(child[0])
                continue
            k = _common(child[0], text, at)
            middle = [child[0][:k], {child[0][k]: child}, None, None]
            child[0] = child[0][k:]
            node[1][text[at]] = middle
            node, at = middle, at + k
            self.bytes += 400
        if node[2] is None:
            node[2], node[3] = doc_id, {held: n}
        elif doc_id == node[2]:
            node[3][held] = node[3].get(held, 0) + n
        elif doc_id > node[2]:
            yield doc_id, held, n
        else:
            for other, m in node[3].items():
                yield node[2], other, m
            node[2], node[3] = doc_id, {held: n}

    def terminals(self, texts: bool = True):
        """(text, smallest id, holders) of every text; without ``texts`` the paths aren't put together."""
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            path = path + node[0] if texts else path
            if node[2] is not None:
                yield path, node[2], node[3]
            stack.extend((path, child) for child in node[1].values())


_ROWS = "text binary, doc_id long, part string, mask int, n long"


def _batches(rows, most_bytes: int = 8 << 20):
    """Tuples (text, doc_id, part, mask, n) as Arrow batches of bounded size."""
    import pyarrow as pa

    types = (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64())
    names = ["text", "doc_id", "part", "mask", "n"]

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[0] or b"")
        if len(part) == OUT_ROWS or size > most_bytes:
            yield batch(part)
            part, size = [], 0
    if part:
        yield batch(part)


def _local(docs: DataFrame) -> DataFrame:
    """Masks of A to D, and the map-side tries: decided rows have no text, the others their text."""

    def run(batches):
        import pyarrow as pa

        take_memory("filter_audit", lambda: None)

        def rows():
            trie = Trie()
            for batch in batches:
                ids, texts, parts = batch.columns
                for doc_id, text, part in zip(ids.to_pylist(), texts.cast(pa.binary()), parts.to_pylist()):
                    text = text.as_py() or b""
                    mask = int(text_mask(text))
                    if doc_id is None:
                        yield None, None, part, mask, 1
                        continue
                    for other, (p, m), n in trie.offer(text, doc_id, (part, mask)):
                        yield None, other, p, m | DUPLICATE, n
                    if trie.bytes > FLUSH_BYTES:
                        yield from ((t, i, p, m, n) for t, i, held in trie.terminals() for (p, m), n in held.items())
                        trie = Trie()
            yield from ((t, i, p, m, n) for t, i, held in trie.terminals() for (p, m), n in held.items())

        yield from _batches(rows())
        release()

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
    )
    return columns.mapInArrow(run, _ROWS)


def _merged(rows: DataFrame) -> DataFrame:
    """The reduce-side tries: flags of rows of which equal texts share a partition."""

    def run(batches):
        take_memory("filter_audit", lambda: None)

        def rows_out():
            trie = Trie()
            for batch in batches:
                ids, parts, masks, counts = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
                for text, doc_id, part, mask, n in zip(batch.column(0), ids, parts, masks, counts):
                    for other, (p, m), k in trie.offer(text.as_py(), doc_id, (part, mask), n):
                        yield None, other, p, m | DUPLICATE, k
            yield from ((None, i, p, m, n) for _, i, held in trie.terminals(texts=False) for (p, m), n in held.items())

        yield from _batches(rows_out())
        release()

    return rows.mapInArrow(run, _ROWS)


def adaptive_prefix(rows: DataFrame):
    """Column: beginning of ``text`` (binary), longer where a beginning holds many bytes.

    Only heavy prefixes come to the driver: at most SHARE per partition and depth.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = rows.select("text", F.octet_length("text").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    key = F.substring("text", 1, DEPTHS[0])
    inside = F.lit(True)
    for depth, deeper in zip(DEPTHS, DEPTHS[1:]):
        head = F.substring("text", 1, depth)
        counts = sized.filter(inside & (F.col("size") > depth)).groupBy(head.alias("head")).agg(F.sum("size").alias("size"))
        heavy = [bytes(r["head"]) for r in counts.filter(F.col("size") > max(1, total // (SHARE * parts))).select("head").collect()]
        if not heavy:
            break
        inside = head.isin(heavy)
        key = F.when(inside, F.substring("text", 1, deeper)).otherwise(key)
    return key


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that each row of (doc_id, text, source) fails; ``n`` rows alike."""
    local = saved(_local(docs), "filter-audit")
    open_rows = local.filter(F.col("text").isNotNull())
    dealt = open_rows.repartitionByRange(adaptive_prefix(open_rows))
    return local.filter(F.col("text").isNull()).drop("text").unionByName(_merged(dealt).drop("text"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts the module text names."""
    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    n = F.col("n")
    cells = (
        masks(docs)
        .join(flags, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum(n).alias("n"),
            F.sum(F.when(F.col("good") == 1, n).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("bad") == 1, n).otherwise(0)).alias("bad"),
        )
    )
    return _by_order(cells)


def _by_order(cells: DataFrame) -> DataFrame:
    """All orders and steps from (part, mask, n, good, bad)."""
    size = len(FILTERS)
    everything = range(1 << size)
    whole = (1 << size) - 1
    survives = F.col("mask").bitwiseAND(F.col("s")) == 0
    sums = (
        cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(whole))).alias("s"))
        .groupBy("part", "s")
        .agg(*[F.sum(F.when(survives, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "bad")])
    )
    # arrays by the set of filters S: rows that fail no filter of S
    parts = (
        sums.groupBy("part")
        .agg(F.sort_array(F.collect_list(F.struct("s", "n", "good", "bad"))).alias("left"))
        .select("part", *[F.col(f"left.{c}").alias(f"{c}_left") for c in ("n", "good", "bad")])
    )

    def left(s: int):
        return F.element_at("n_left", F.lit(s + 1))

    shapley = [
        sum(
            (
                (left(s) - left(s | 1 << f)) * (factorial(bin(s).count("1")) * factorial(size - 1 - bin(s).count("1")))
                for s in everything
                if not s >> f & 1
            ),
            F.lit(0),
        )
        for f in range(size)
    ]
    alone = [left(whole ^ 1 << f) - left(whole) for f in range(size)]
    parts = parts.select("*", F.array(*shapley).alias("shapley_of"), F.array(*alone).alias("alone"))
    orders = ["".join(FILTERS[k] for k in order) for order in permutations(range(size))]
    place = F.col("step")
    rows = (
        parts.select("*", F.explode(F.lit(orders)).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
        .withColumn("f", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
        .withColumn("s", sum((F.when(F.instr("filter_order", x) < place, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0)))
        .withColumn("bit", F.expr("shiftleft(1, f)"))
        .withColumn("t", F.col("s") + F.col("bit"))
    )

    def at(name: str, where: str):
        return F.element_at(name, F.col(where) + 1)

    removed = at("n_left", "s") - at("n_left", "t")
    failing = F.element_at("n_left", F.lit(1)) - at("n_left", "bit")
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n_left", "t").cast("long").alias("kept"),
        removed.cast("long").alias("removed"),
        (failing - removed).cast("long").alias("redundant"),
        at("alone", "f").cast("long").alias("unique_fails"),
        (at("good_left", "s") - at("good_left", "t")).cast("long").alias("good_lost"),
        (at("bad_left", "s") - at("bad_left", "t")).cast("long").alias("toxic_lost"),
        at("shapley_of", "f").cast("long").alias("shapley"),
    )
