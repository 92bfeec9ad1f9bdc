"""Byte-level BPE encoding with a two-tier lookup, after a public vocabulary file.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens; the found entry is
compared with the full key, as the hash maps foreign keys too. Tier two: a pre-token that is no
vocabulary entry is merged with a heap over linked bytes, O(n log n) for a pre-token of n bytes.

Defined results: a NULL or an empty text has no ids (an empty list); blank texts are encoded as
they are; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 200_000  # pre-tokens whose ids a worker remembers; a full cache is emptied
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


class MinimalPerfectHash:
    """Levels of bit arrays: a key sits at the first level where it is alone at its place."""

    GAMMA = 2.0

    def __init__(self, keys: list[bytes]):
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        left = np.arange(len(keys))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.at = np.full(len(keys), -1, dtype=np.int64)
        base = 0
        while len(left):
            m = max(64, int(self.GAMMA * len(left)))
            where = self._place(hashes[left], len(self.levels), m)
            alone = np.bincount(where, minlength=m) == 1
            order = np.cumsum(alone) - 1 + base
            self.levels.append((m, alone, order))
            mine = alone[where]
            self.at[order[where[mine]]] = left[mine]
            base += int(alone.sum())
            left = left[~mine]
            if len(self.levels) > 60:
                raise ValueError("equal keys in the vocabulary")

    @staticmethod
    def _place(h: np.ndarray, level: int, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(m)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key, if it is one of the keys; else of any other, or -1."""
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (m, alone, order) in enumerate(self.levels):
            where = self._place(hashes[left], level, m)
            hit = alone[where]
            out[left[hit]] = self.at[order[where[hit]]]
            left = left[~hit]
            if not len(left):
                break
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        self.keys = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.ranks = dict(zip(self.keys, self.ids))
        self.bytes_of = dict(zip(self.ids, self.keys))
        self.hash = MinimalPerfectHash(self.keys)
        self.cache: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """BPE of one pre-token: the pair of lowest rank merges first, the leftmost on ties."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= e or end[mid] != e:
                continue  # one of its parts has been merged since
            end[i], end[mid] = e, 0
            if e < n:
                prev[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if i > 0 and (r := ranks.get(piece[(p := prev[i]) : e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, tokens: set[str]) -> None:
        """Puts the ids of new pre-tokens into the cache."""
        new = [t for t in tokens if t not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(tokens)
        raw = [t.encode("utf-8", "replace") for t in new]
        for t, b, i in zip(new, raw, self.hash.lookup(raw).tolist()):
            self.cache[t] = [self.ids[i]] if i >= 0 and self.keys[i] == b else self.merged(b)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn({p for s in split for p in s})
        cache, out = self.cache, []
        for s in split:
            ids: list[int] = []
            for p in s:
                ids += cache[p]
            out.append(ids)
        return out

    def pieces(self, text: str) -> tuple[list[str], list[list[int]]]:
        """Pre-tokens of a text and the ids of each."""
        s = self.pattern.findall(text)
        self.learn(set(s))
        return s, [self.cache[p] for p in s]


def encoder(path: str, pattern: str | None = None) -> Encoder:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


BATCH = 256  # texts encoded at a time


def encoded(docs: DataFrame, key: str, text: str, path: str, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of each row; no shuffle."""
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    key_type = chosen.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))], names=["_key", "ids"])

    return chosen.mapInArrow(run, f"_key {key_type}, ids array<int>").withColumnRenamed("_key", key)


def token_counts(docs: DataFrame, columns: list[str], text: str, path: str, pattern: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens`` of each row."""
    chosen = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts, n = b.column(b.num_columns - 1), []
            for at in range(0, b.num_rows, BATCH):
                n += [len(x) for x in enc.encode_batch(texts.slice(at, BATCH).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(run, f"{shape}, n_tokens bigint")
