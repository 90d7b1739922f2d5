"""Filter audit, spelling variants and the quality classifier against brute force on small tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import filter_audit, ngram_join, quality, spelling, warc

SCHEMA = "doc_id long, text string, source string, part string, mask int, n long, word string, x int, label int"
CLASH = ("clash", 9, 7, "clash", 3, 5)
DATA = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


# ---------------------------------------------------------------- filter audit


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        k
        for k, bad in {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
        }.items()
        if bad
    }


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    parts = collections.defaultdict(list)
    for i, text, source in rows:
        own = fails(text or "") | ({"E"} if i is not None and i > least[text or ""] else set())
        parts[source or ""].append((i, own))
    out = {}
    for part, of in parts.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f in x[1] for x in of) - len(gone),
                    sum(x[1] == {f} for x in of),
                    sum(x[0] in good for x in gone),
                    sum(x[0] in toxic for x in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(5)
    texts = ["", "one two", " ".join(f"w{k}" for k in range(60)), "é " * 70, "AB cd\x1cEF\x85gh " * 20, "a | b " * 40, "x" * 30000]
    texts += ["shared beginning " * 30 + t for t in ("", "a", "b", "ab", "é", "è")]
    rows = [(k, rng.choice(texts), rng.choice(["web", "news", None, ""])) for k in range(150)]
    rows += [(k % 7, texts[3], "copies") for k in range(60)] + [rows[3], rows[3], (rows[4][0], rows[4][1], "other")]
    rows += [(None, texts[2], "web"), (None, texts[2], "web"), (None, None, None), (900, None, "web"), (-5, None, "web")]
    rows += [(1000 + k, f"text {k % 90} " * (k % 90), "many") for k in range(200)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 160, 3)] + [(3, 1, 1), (None, 1, 1), (3, 0, 0)]
    return rows, [(i, int(q), int(t)) for i, q, t in labels]


@pytest.mark.parametrize("small", [False, True])
def test_filter_audit(spark, audited, small, monkeypatch):
    rows, labels = audited
    if small:  # several tries a task, prefixes of all depths
        monkeypatch.setattr(filter_audit, "FLUSH_BYTES", 20_000)
        monkeypatch.setattr(filter_audit, "DEPTHS", (1, 2, 5, 30, 500))
        monkeypatch.setattr(filter_audit, "SHARE", 40)
    docs = frame(spark, rows).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[k] for k in kept) for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    one = filter_audit.audit(frame(spark, [(1, None, None)]), labels).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.unique_fails) for r in one] == [(0, 1, 1)] + [(0, 0, 0)] * 4


def test_trie_keeps_smallest_ids():
    rng = random.Random(2)
    rows = [(bytes(rng.choices(b"ab", k=rng.randint(0, 6))), rng.randint(0, 50)) for _ in range(2000)]
    trie, late = filter_audit.Trie(), collections.Counter()
    for text, i in rows:
        for other, _, n in trie.offer(text, i, ("p", 0)):
            late[other] += n
    least = {}
    for text, i in rows:
        least[text] = min(i, least.get(text, i))
    assert {t: i for t, i, _ in trie.terminals()} == least
    assert sum(late.values()) == sum(i > least[t] for t, i in rows)


# ---------------------------------------------------------------- spelling


def words_by_hand(rows, least=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_hand(words):
    out = {}
    for w, n in words.items():
        of = [v for v in words if near(v, w)]
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(of), words[form] if form else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_on_texts(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(base)[: rng.randint(4, 9)] for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += ["Straße×Straße STRASSE naïve—Łódź ŸÀÉÀÉÀ" * 3, "x" * 9000 + " " + "x" * 8999, ("x" * 9000 + " ") * 3 + ("x" * 8999 + " ") * 8, None, ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (-12345678901, texts[5])]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    words = words_by_hand(rows)
    assert len(words) > 200 and max(map(len, words)) == 9000
    assert variants(spelling.group_variants(docs)) == variants_by_hand(words)


@pytest.mark.parametrize("cell", [4, 100])
def test_spelling_cells_and_blocks(spark, cell):
    """Anagrams share a point, so that their cell can't be split by the tree and goes to blocks."""
    rng = random.Random(cell)
    pool = {"".join(p) for p in itertools.permutations("abcde")} | {"".join(rng.choice("abcxyzé") for _ in range(rng.randint(5, 8))) for _ in range(500)}
    pool |= {w[:k] + "q" + w[k + 1 :] for w in list(pool)[::5] for k in (0, 3)} | {w + "z" for w in list(pool)[::4]}
    words = {w: rng.choice([3, 4, 9, 30, 100, 1000]) for w in pool}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = variants(spelling.with_roots(spelling.near_words(table, cell_words=cell, sample_words=300)))
    assert got == variants_by_hand(words)


def test_spelling_of_nothing(spark):
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, None, None), (None, "", None)])).count() == 0


# ---------------------------------------------------------------- quality


def test_discriminant_is_a_density_ratio():
    rng = np.random.default_rng(3)
    classes = [rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(500, 4)) + 1]
    moments = [quality.Moments(len(x), x.sum(axis=0), x.T @ x) for x in classes]
    fitted = quality.discriminant(moments, np.zeros(4), np.ones(4), 0.2, 0.05)
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in classes) / 800
    x = np.clip(rng.normal(size=(50, 4)), -4, 4)
    want = np.zeros(50)
    for sign, c in zip((-1, 1), classes):
        cov = 0.8 * np.cov(c.T, bias=True) + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / 4 * np.eye(4)
        d = x - c.mean(axis=0)
        want += sign * (np.log(len(c) / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(fitted.logit(x), want)


def test_quality_learns_and_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} >= set(held) and len(held) > 50
    junk, fine = ([got[i].predicted for i in held if truth[i] == k] for k in (0, 1))
    assert 1 - sum(junk) / len(junk) >= 0.9 and sum(fine) / len(fine) >= 0.95
    # held-out labels are never seen
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_documents(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_quality_on_odd_rows(spark):
    rng = random.Random(1)

    def prose():
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 60))) + "."

    rows = [(k, prose() if k % 2 else "## $$ " * rng.randint(1, 40), None) for k in range(80)]
    odd = [(None, None, None), (None, prose(), None), (90, "", None), (91, "x" * 200_000, None), (92, "word " * 50_000, None), rows[5], rows[5]]
    labels = [(k, k % 2) for k in range(80)] + [(None, 1), (3, None), (5, 7), (1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_documents(frame(spark, rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd) and all(np.isfinite(r.score) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    assert quality.score_documents(frame(spark, []), table).count() == 0
    none = quality.score_documents(frame(spark, rows), table.filter("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.score_documents(frame(spark, rows), table.filter("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].predicted == 1


# ---------------------------------------------------------------- mended operators


def test_rows_that_share_a_doc_id_are_decided_one_by_one(spark):
    rng = random.Random(6)

    def prose():
        return [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(200)]

    a, u, v = prose(), " ".join(prose()), " ".join(prose())
    near_ = [" ".join([*a[:k], "zz", *a[k + 1 :]]) for k in (0, 100, 199)]
    a = " ".join(a)

    def left(rows):
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
        return sorted((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(docs).select("doc_id", "text", "cls").collect())

    assert left([(1, a), (2, near_[0]), (1, u), (2, v)]) == sorted([(2, near_[0]), (1, u), (2, v)])
    got = left([(1, a), (2, near_[0]), (2, near_[1]), (2, u)])
    assert len(got) == 2 and (2, u) in got and got[0][0] == got[1][0] == 2
    assert len(left([(1, a), (2, a), (2, a), (2, a)])) == 1
    # two groups whose smallest doc_id is the same
    w = u + " tail"
    assert left([(1, a), (2, near_[0]), (1, u), (3, w)]) == sorted([(2, near_[0]), (3, w)])


def test_archives_are_read_in_proportion_to_their_size():
    import time

    import zstandard

    rng = random.Random(3)
    pages = [bytes(rng.randbytes(900)) for _ in range(12_000)]
    compress = zstandard.ZstdCompressor(level=1).compress
    frames = [compress(warc.record(k, "u", p, "0" * 40, "response", None)) for k, p in enumerate(pages)]

    def seconds(n):
        start = time.perf_counter()
        assert sum(1 for _ in warc.records_of(b"".join(frames[:n]))) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(12_000) < 30 * seconds(1500) + 0.5
    with pytest.raises(warc.BadRecord):
        list(warc.records_of(b"".join(frames[:5])[:-3]))
