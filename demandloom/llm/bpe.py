"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled as follows. A nondeterministic transducer walks the trie of token bytes; after the bytes of a
token ``u`` it may emit ``u`` and restart at the root, if the merges leave the pair (previous token, ``u``) apart. A
string's BPE encoding is the one path whose neighbouring tokens all stay apart. A determinised state is the set of live
hypotheses (trie node, last token, tokens not yet emitted); a transition drops hypotheses without a child, adds the one
that just completed a token, and emits what all of them agree on. No hypothesis can outlive the longest token, so the
lookahead is bounded. States and transitions are made when first needed and kept, up to a limit.

Texts are first split by a pattern; each match is encoded separately, and encodings of short matches are remembered.
Decoding feeds token bytes through a UTF-8 state machine built from the encoding's rules; it can stop and go on
between any two tokens, holding back an unfinished character.

Null texts count as empty: no ids. A decoder meets unknown ids with an error.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import ids_column, rows_of, take_memory

MEMO = 200_000
MEMO_CHARS = 48
STATES = 180_000
PAIRS = 400_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes -> id, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Transducer:
    """Encodes bytes of one match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = [-1]
        inner = {0}
        for text, number in ranks.items():
            node = 0
            for byte in text:
                inner.add(node)
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = number
        self.inner = inner
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states = {start: 0}
        self.sets = [start]
        self.next: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        self.last: list[tuple[int, ...] | None] = [()]

    def merged(self, parts: list[bytes], leave: int = 1) -> list[bytes]:
        """The merges themselves: join the neighbours of lowest rank until none can be joined or ``leave`` are left."""
        parts = list(parts)
        while len(parts) > leave:
            found = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(found)
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The token and its outer parts at one side (0 left, 1 right), each with the rank of the merge that ends it."""
        known = self._spines[side].get(token)
        if known is None:
            text = self.bytes[token]
            known = [(text, 1 << 60)]
            if len(text) > 1:
                parts = self.merged([bytes([c]) for c in text], 2)
                known += [(p, min(r, token)) for p, r in self.spine(self.ranks[parts[-side]], side)]
            self._spines[side][token] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges, run over both tokens' bytes, end with exactly these two.

        They don't if, at some time, an outer part of each is there and their merge comes before those that end them
        (at equal ranks the merge further left comes first). Ranks of merges exceed those of their parts.
        """
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            known, ranks = True, self.ranks
            for a, end_a in self.spine(left, 1):
                for b, end_b in self.spine(right, 0):
                    rank = ranks.get(a + b)
                    if rank is not None and rank < end_a and rank <= end_b:
                        known = False
            self._apart[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive: list[tuple[int, int, tuple[int, ...]]] = []
        done = None
        for node, last, pending in self.sets[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if node in self.inner:
                alive.append((node, last, pending))
            number = self.token[node]
            if number >= 0 and done is None and (last < 0 or self.apart(last, number)):
                done = (0, number, (*pending, number))
        if done is None:
            raise ValueError("the ranks lack a token for a single byte")
        alive.append(done)
        common = 0
        shortest = min(len(p) for _, _, p in alive)
        while common < shortest and len({p[common] for _, _, p in alive}) == 1:
            common += 1
        emitted = done[2][:common]
        key = tuple((n, t, p[common:]) for n, t, p in alive)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.last.append(key[-1][2])  # the hypothesis that ends here: what is left to emit at the end
        return target, emitted

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.sets) > STATES:
            self._reset()
        out: list[int] = []
        state, moves, emits = 0, self.next, self.emits
        for byte in data:
            key = state << 8 | byte
            target = moves.get(key)
            if target is None:
                target, emitted = self._step(state, byte)
                if emitted:
                    emits[key] = emitted
                    target = ~target
                moves[key] = target
            if target < 0:  # a move that emits
                out += emits[key]
                target = ~target
            state = target
        return out + list(self.last[state])


# ---------------------------------------------------------------- UTF-8


def utf8_machine() -> list[list[int]]:
    """Transitions state x byte; 0: between characters, -1: not UTF-8. Built from the ranges of the encoding."""
    fail = [-1] * 256

    def state(*ranges: tuple[int, int, int]) -> list[int]:
        row = list(fail)
        for low, high, target in ranges:
            row[low : high + 1] = [target] * (high - low + 1)
        return row

    tail = (0x80, 0xBF)
    return [
        state((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
        state((*tail, 0)),
        state((*tail, 1)),
        state((*tail, 2)),
        state((0xA0, 0xBF, 1)),  # no overlong three-byte forms
        state((0x80, 0x9F, 1)),  # no surrogates
        state((0x90, 0xBF, 2)),  # no overlong four-byte forms
        state((0x80, 0x8F, 2)),  # nothing above U+10FFFF
    ]


class StreamDecoder:
    """Ids in, text out, in any number of calls; bytes of an unfinished character wait for the next call."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.machine = utf8_machine()
        self.moves: dict[int, int] = {}
        self.closed = np.zeros(max(tokens, default=0) + 1, dtype=bool)  # from between characters to between characters
        for number in tokens:
            self.closed[number] = self._move(0, number) == 0
        self.state, self.held = 0, b""

    def _move(self, state: int, number: int) -> int:
        key = state << 24 | number
        target = self.moves.get(key)
        if target is None:
            target = state
            for byte in self.tokens[number]:
                target = self.machine[target][byte]
                if target < 0:
                    break
            self.moves[key] = target
        return target

    def feed(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        data = self.held + b"".join(map(self.tokens.__getitem__, ids.tolist()))
        self.held = b""
        # only tokens that open or continue a character move the machine
        for number in ids[~self.closed[ids]].tolist() if self.state == 0 else ids.tolist():
            self.state = self._move(self.state, number)
            if self.state < 0:
                raise ValueError("ids don't decode to UTF-8")
        if self.state:
            start = len(data) - 1
            while data[start] & 0xC0 == 0x80:
                start -= 1
            data, self.held = data[:start], data[start:]
        return data.decode()

    def close(self) -> None:
        """Call at the end: a character must not be left unfinished."""
        if self.state:
            raise ValueError("ids end inside a character")
        self.state, self.held = 0, b""


# ---------------------------------------------------------------- Spark

_CODERS: dict[tuple[str, str], tuple] = {}


def _coder(ranks: bytes, pattern: str):
    import regex

    take_memory("bpe", _CODERS.clear)
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        table = read_ranks(ranks)
        _CODERS[key] = (Transducer(table), regex.compile(pattern).findall, ({}, {}), StreamDecoder({i: t for t, i in table.items()}))
    return _CODERS[key]


def encoder(ranks: bytes, pattern: str):
    """A function text -> little-endian 32-bit ids."""
    transducer, split, memo, _ = _coder(ranks, pattern)
    young, old = memo  # what is used again moves from the old half to the young one

    def one(match: str) -> bytes:
        ids = old.get(match)
        if ids is None:
            ids = np.array(transducer.encode(match.encode()), dtype="<i4").tobytes()
        if len(match) <= MEMO_CHARS:
            if len(young) > MEMO:
                old.clear()
                old.update(young)
                young.clear()
            young[match] = ids
        return ids

    def encode(text: str) -> bytes:
        get = young.get
        return b"".join([get(m) or one(m) for m in split(text)])

    return encode


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds ``ids array<int>`` to (doc_id, text), computed over whole texts. The ranks are a broadcast of their size."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        work = encoder(shared.value, pattern)
        for batch in batches:
            for part in rows_of(batch, 512):
                ids = [work(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), ids_column(ids)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str = "") -> DataFrame:
    """Adds ``decoded`` (text) to (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        decoder = _coder(shared.value, pattern)[3]
        for batch in batches:
            for part in rows_of(batch, 512):
                lists = part.column(1)
                values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = []
                for low, high in zip(at, at[1:]):
                    texts.append(decoder.feed(values[low:high]))
                    decoder.close()
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ids of whole texts, and the text that the streaming decoder makes of the ids, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        work, decoder = encoder(shared.value, pattern), _coder(shared.value, pattern)[3]

        def text_of(ids: bytes) -> str:
            text = decoder.feed(np.frombuffer(ids, dtype="<i4"))
            decoder.close()
            return text

        for batch in batches:
            for part in rows_of(batch, 512):
                ids = [work(x or "") for x in part.column(1).to_pylist()]
                texts = pa.array(map(text_of, ids), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids_column(ids), texts], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )
