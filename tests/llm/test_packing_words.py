"""Token ids of whole texts from ids of their distinct chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from demandloom.llm import packing, queries

DEFINITION = queries.words_definition()


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_str(DEFINITION)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_each_distinct_chunk_is_handled_once_a_slice(plain, monkeypatch):
    """Tokenising cost 434 CPU seconds a GB: every chunk of every text was looked up and joined in Python."""
    seen = []
    of_chunks = packing._Words.chunk_ids
    monkeypatch.setattr(packing._Words, "chunk_ids", lambda self, lines: seen.extend(lines.split("\n")) or of_chunks(self, lines))
    texts = ["one Two, three\nfour\tone "] * 400 + [None, "", "two one\x1cthree"]
    assert packing._Words(DEFINITION).encode(pa.array(texts)) == [plain(x) for x in texts]
    assert len(seen) == len(set(seen)) <= 8


def test_ids_are_the_tokenizers(plain):
    """Marks compose with letters as written: the tokenizer lowers after that ("H" + U+0331 stays two code points)."""
    rng = random.Random(7)
    signs = [*" \n\t\x0b\x0c\r\x1c\x1f\x85\xa0 　'abTHJWYsSI.,!\"(-_0éÈßẞİΣσЖ中각",
             *"̱̣̈̊̌̇́KÅ", "'s", "don't", '"Word",', "AΣ ", "x" * 80, "  "]
    texts = ["H̱ T̈", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    texts += [f"{chr(c)} a{chr(c)}B, ({chr(c)})" for c in range(0x20, 0x250)]
    words = packing._Words(DEFINITION)
    want = [plain(x) for x in texts]
    assert words.encode(pa.array(texts)) == want  # first as new words, then as remembered ones
    assert words.encode(pa.array(texts, pa.large_string())) == want
    assert words.encode(pa.array(texts).slice(100, 50)) == want[100:150]
    assert max(map(len, words.memo)) <= packing.LONG


def test_slices_are_bounded_by_bytes():
    texts = ["a" * n for n in (5, 5, 30, 0, 1, 9)] + [None, "é" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert [x.column(0).to_pylist() for x in packing._slices(batch, 10)] == [[0, 1], [2], [3, 4, 5, 6], [7]]
