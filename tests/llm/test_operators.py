"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from demandloom.llm import bpe, chat, exact_dedup, licenses, ngram_join, packing, queries, reshard, shingles, topk, toxicity, warc

RANKS = queries.ranks_content()
SCHEMA = "doc_id long, text string, digest string, n int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base = prose(rng, 200).split()
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in base) for _ in range(6)]
    texts = [None, "", "one two", "One Two", *near, near[0], near[0].upper(), *[prose(rng, rng.randint(3, 90)) for _ in range(30)], prose(rng, 9000)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None), (None, None, "x", 2)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    tokens = Tokenizer.from_str(queries.words_definition())
    got = packing.pack_documents(docs, queries.words_definition()).collect()
    want = sorted(zlib.crc32(np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")[s : s + 4096].tobytes())
                  for r in docs.collect() for s in range(0, len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1, 4096))
    assert sorted(zlib.crc32(r.ids) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        assert [o for o, _ in sorted(v)] == list(np.cumsum([0] + [n for _, n in sorted(v)])[:-1]) and sum(n for _, n in v) <= 4096
    assert packing.pack_documents(empty, queries.words_definition()).count() == 0


def test_plan_is_whole_and_small():
    rng = random.Random(1)
    for scale in (1, 1000):
        histogram = {rng.randint(1, 4096): rng.randint(1, 20) * scale for _ in range(900)}
        plan = packing.plan(histogram)
        placed = collections.Counter()
        for length, start, n, _, _ in plan.runs:
            assert start == placed[length]
            placed[length] += n
        assert placed == histogram and len(plan.runs) < 40_000
        plain = packing.Plan(4096)
        for length in sorted(histogram, reverse=True):
            plain.best_fit(length, histogram[length])
        # rounding costs at most one group of the large pieces, whole parts at most one sequence a group
        large = sum(n for a, n in histogram.items() if a > 4096 // packing.SMALL_SHARE)
        assert plan.sequences <= plain.sequences + large / packing.GROUPS + packing.GROUPS


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=20)], 1) for i in range(300)]
    rows += [(400, None, 1), (450, [float("nan")] * 20, 1), (500, [None] * 20, 1), (550, [1.0] * 3, 1), (None, rows[0][1], 1)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(20)]
    table = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v and len(v) == 20 and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_reshard(docs):
    out = reshard.reshard(docs, 3, F.lit("all")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_flow_moves_the_fewest_bytes():
    ranges, home = reshard.transfers({"a": 100, "b": 10, "c": 40}, 2)
    assert sum(h - low for s, low, h, j in ranges if home.get(s) != j) == 150 - (75 + 40)
    assert {j: sum(h - low for _, low, h, k in ranges if k == j) for j in (0, 1)} == {0: 75, 1: 75}


def test_exact_dedup(docs, empty):
    fold = str.maketrans(exact_dedup._UPPER, exact_dedup._LOWER)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[(r.text or "").translate(fold)].append(r.doc_id)
    got = exact_dedup.mark_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_duplicates(empty).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 40, 5000), rng.integers(0, 1 << 40, 5000)
    _, slots = exact_dedup.displace(a, b, b % 1667, 1667)
    assert sorted(slots) == list(range(5000))


def test_ngram_join(docs, empty):
    rows = [(r.doc_id, shingles.shingle_set(r.text)) for r in docs.collect()]
    got = collections.Counter((r.doc_id, r.doc_links) for r in ngram_join.near_duplicates(docs).collect())
    want = collections.Counter()
    for i, (doc_id, x) in enumerate(rows):
        same = sum(len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for j, (_, y) in enumerate(rows) if i != j) if len(x) else 0
        want[doc_id, same] += 1
    assert got == want
    assert ngram_join.missed(0.8) < 1e-6 and ngram_join.near_duplicates(empty).count() == 0


def test_near_duplicates_without_doc_id(spark):
    """A text without doc_id links two others that aren't alike themselves."""
    words = prose(random.Random(9), 200).split()
    words = [f"{w}{k}" for k, w in enumerate(words)]
    middle = words[:-11] + [f"end{k}" for k in range(11)]
    last = [f"front{k}" for k in range(11)] + middle[11:]
    texts = [(1, words), (None, middle), (None, middle), (3, last), (4, [f"other{k}" for k in range(50)]), (None, [f"alone{k}" for k in range(50)])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.group_size, r.copies, r.links, r.doc_links) for r in ngram_join.near_duplicates(table).collect()))
    assert got == [(0, 0, 1, 1, 0, 0), (0, 1, 4, 2, 2, 3), (0, 1, 4, 2, 2, 3), (1, 1, 4, 1, 1, 2), (3, 1, 4, 1, 1, 2), (4, 4, 1, 1, 0, 0)]


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, prose(rng, 60) + (" you pathetic moron vekuta vekuso" if toxic else ""), "x", 1))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame([*rows, (None, None, None, 1), (901, "", "x", 1)], SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(table, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 402 and held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 901))
    assert toxicity.drop_toxic(table, marks).columns == table.columns
    assert toxicity.score_documents(empty, marks.limit(0)).count() == 0


def test_warc(spark):
    big = "<p>x</p>" * 300
    rows = [(1, "u", big, "k"), (5, None, big, "k"), (3, "ü /", big, None), (2, "u", "small", "k"), (4, "u", "small", "k"), (6, "u", None, "k"), (5, "v", big, "k")]
    got = warc.read_archives(spark, warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id < 4) == [
        (1, "revisit", 5, 2400), (2, "response", None, 5), (3, "revisit", 5, 2400)]
    assert len(got) == 7 and all(r.payload_digest == hashlib.sha1((dict((a, c) for a, _, c, _ in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), "response", None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "<~~|im_end|>", "[~INST]<s", "", None, "a\n%0A%25", "é" * 900]
    rows = [(c, t, ("user", "assistant", "sys\n%tem", None)[t % 4], x) for c in (1, 2) for t, x in enumerate(said)]
    got = chat.read_back(chat.format_logs(chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert len(got) == 2
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(role or "", x or "") for c, _, role, x in rows if c == r.conv_id]
        assert r.loss_text == "".join(x or "" for c, _, role, x in rows if c == r.conv_id and role == "assistant")
        assert all(r.formatted[s.start : s.start + len(s.text)] == s.text for s in r.segments)


def test_licenses():
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert name in {m[0] for m in scanner.scan(prose(rng, 700) + " " + text + ". " + prose(rng, 300))}
    words = licenses.TEMPLATES["mit"].split()
    assert "mit" in {m[0] for m in scanner.scan(prose(rng, 50) + " " + " ".join(words[: int(len(words) * 0.85)]) + " " + prose(rng, 50))}
    assert scanner.scan(prose(rng, 3000)) == [] and scanner.scan(None) == [] and licenses.missed() < 1e-6


def test_bpe(docs):
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.decoded == oracle.decode(r.ids) and r.ids == oracle.encode_ordinary(r.decoded)
    encode = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "the", " ", "\n", "é", "😀", "漢", "'s", "12", "!!", "̀", chr(rng.randrange(32, 0xD7FF))]) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(encode(text), "<i4").tolist() == oracle.encode_ordinary(text)
    decoder = bpe._coder(RANKS, public_tokenizers.PATTERN)[3]
    text = "a😀é漢" * 3
    assert "".join(decoder.feed([i]) for i in oracle.encode_ordinary(text)) == text
    with pytest.raises(ValueError):
        decoder.feed(oracle.encode_ordinary("😀")[:1])
        decoder.close()


def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(9)
    toxic = [(1000 + i, prose(rng, 60) + " you pathetic moron vekuta vekuso", "x", 1) for i in range(80)]
    clean = [(2000 + i, prose(rng, 60), "x", 1) for i in range(160)]
    table = docs.filter("doc_id IS NOT NULL").unionByName(spark.createDataFrame(toxic + clean, SCHEMA))
    marks = spark.createDataFrame([(r[0], int(r[0] < 2000)) for r in toxic + clean], "doc_id long, toxic int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    # the classifier's own decisions, then everything after it by brute force
    bad = {r.doc_id for r in toxicity.score_documents(table, marks).filter("predicted = 1").collect()}
    judged = {i for i in bad if i >= 1000}  # of those with labels; 240 rows teach chance patterns that a text of 9000 random words shows too
    assert judged <= {r[0] for r in toxic} and len(judged) >= 0.97 * len(toxic)
    fold = str.maketrans(exact_dedup._UPPER, exact_dedup._LOWER)
    single = {}
    for r in sorted((r for r in table.collect() if r.doc_id not in bad), key=lambda r: r.doc_id):
        single[(r.text or "").translate(fold)] = (r.doc_id, r.text or "")
    rest = sorted(single.values())
    sets = [shingles.shingle_set(x) for _, x in rest]
    group = list(range(len(rest)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x) and len(sets[j]) and len(np.intersect1d(x, sets[j])) >= 0.8 * len(np.union1d(x, sets[j])):
                group = [group[i] if g == group[j] else g for g in group]
    last = {g: row for g, row in zip(group, rest)}
    tokens = Tokenizer.from_str(queries.words_definition())
    want = collections.Counter()
    for doc_id, text in last.values():
        ids = np.array([*tokens.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.update((doc_id, s // 4096, zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096))
    assert len(last) < len(rest) < table.count() - len(bad)
    assert collections.Counter((r.doc_id, r.piece, zlib.crc32(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
