"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the tokenizer's pattern into pre-tokens. Tier one: a minimal perfect hash over the
vocabulary's byte strings (hash and displace; one slot per entry, checked against the entry itself)
resolves each pre-token that is an entry as a whole. Tier two: any other pre-token is merged with a
heap of adjacent pairs over linked bytes, lowest rank first and leftmost on ties, in O(n log n) even
for one very long pre-token. Decoding maps ids back to their bytes.

The vocabulary file is read once on the driver (its path is a parameter) and broadcast: its size is
that of the file. Each Python worker memoises at most ``MEMO`` pre-tokens.

Defined cases: null text counts as empty; the empty text has no ids; equal texts have equal ids;
strings of special tokens in a text are ordinary text; texts of any length are encoded whole; rows are independent of each other, repeated ones are encoded
each; a null id stays null; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import map_arrow

MEMO = 400_000
#: The characters of the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"


def _class_of(major: str) -> str:
    """Body of a regex class with all code points of one major category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def compile_pattern(pattern: str) -> re.Pattern[str]:
    """The tokenizer's pattern for the standard regex engine: properties become explicit classes."""
    classes = {r"\p{L}": _class_of("L"), r"\p{N}": _class_of("N")}
    inside = False
    out, i = [], 0
    while i < len(pattern):
        c, two, four = pattern[i], pattern[i : i + 2], pattern[i : i + 5]
        if four in classes:
            body, i = classes[four], i + 5
            out.append(body if inside else f"[{body}]")
        elif two in (r"\s", r"\S"):
            i += 2
            out.append(SPACE if inside else f"[{'^' if two == r'\S' else ''}{SPACE}]")
        else:
            inside = (inside or c == "[") and c != "]"
            out.append(c)
            i += 1
    return re.compile("".join(out))


class PerfectVocabulary:
    """Byte strings with their ids, found by minimal perfect hashing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = sorted(ranks, key=ranks.__getitem__)
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.keys: list[bytes] = [b""] * n
        self.ids = array("q", [-1]) * n
        self.shift = array("q", [0]) * self.buckets
        free = bytearray(b"\x01" * n)
        singles = []
        for bucket, own in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                singles.append((bucket, own[0][1]))
                continue
            d = 1
            while True:
                slots = {self._slot(h, d, n) for h, _ in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for h, key in own:
                s = self._slot(h, d, n)
                free[s], self.keys[s], self.ids[s] = 0, key, ranks[key]
        rest = (s for s in range(n) if free[s])
        for bucket, key in singles:  # a single key goes straight to a free slot, kept as a negative shift
            s = next(rest)
            self.shift[bucket], self.keys[s], self.ids[s] = -s - 1, key, ranks[key]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 32) % n

    def get(self, key: bytes) -> int:
        """The id of ``key``, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d, self.n)
        return self.ids[s] if self.keys[s] == key else -1


class BpeCodec:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern_text = ranks, pattern
        self.vocabulary = PerfectVocabulary(ranks)
        self.pieces = {i: k for k, i in ranks.items()}
        self._start()

    def _start(self) -> None:
        self.pattern = compile_pattern(self.pattern_text)
        self.quick = regex.compile(self.pattern_text)
        self.memo: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "quick", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BpeCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is no entry: a heap of pairs over linked bytes."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is piece[i:after[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        push, pop, get = heapq.heappush, heapq.heappop, ranks.get
        while heap:
            _, i, end = pop(heap)
            mid = after[i]
            if mid <= i or mid >= n or after[mid] != end:  # one of the two parts is no longer there
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    push(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
                push(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _pre_token(self, token: str) -> bytes:
        piece = token.encode()
        found = self.vocabulary.get(piece)
        ids = [found] if found >= 0 else self.merge(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) < 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = packed
        return packed

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, slow = self.memo.get, self._pre_token
        return b"".join([memo(t) or slow(t) for t in self.pre_tokens(text or "")])

    def pre_tokens(self, text: str) -> list[str]:
        """The matches of the pattern. Engines differ only in newer code points: Latin-1 texts take the quicker one."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.quick.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def load_codec(name: str = "byte_bpe_50k.tiktoken", path: str | None = None, pattern: str | None = None) -> BpeCodec:
    """The codec of a rank file: at ``path``, or ``name`` among the installed public tokenizers."""
    import public_tokenizers

    return BpeCodec.from_file(path or public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, codec: BpeCodec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids (array of int)`` for every row."""
    shared = _share(docs.sparkSession, codec)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        packed = [own.encode_packed(t) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, ids array<int>")


def _share(spark: SparkSession, codec: BpeCodec | None):
    return spark.sparkContext.broadcast(codec or load_codec())


def encode_and_verify(docs: DataFrame, codec: BpeCodec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: a digest of the ids and of what they decode to."""
    shared = _share(docs.sparkSession, codec)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        counts, ids, texts = [], [], []
        for text in batch.column(1).to_pylist():
            packed = own.encode_packed(text)
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(own.decode_packed(packed)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every document."""
    return encode_and_verify(docs)
