"""Problem 7: nested JSON records become related flat tables.

Method: each record is parsed as a stream into path-value-ordinal triples; the paths are grouped by
their repeated ancestor (the part up to the last ``[]``); each group is pivoted into one table, whose
rows carry the ordinals of their parents, so children link to parents by (record, ordinals prefix).

The parser reads a record once from left to right and builds no value of it but its strings; triples
are held until the record ends, as an invalid record has none. A number keeps its digits as written.

A path is written from the root ``$``; ``[]`` stands for a place in an array, counted from 1 in
``ordinals``; dots, brackets and backslashes of keys are escaped by a backslash. Paths named in ``repeated`` hold arrays: a lone object or string there is an array of
one, and a string that itself holds JSON is read as that JSON.

Defined results: NULL, blank or invalid JSON (also NaN, trailing text, a cut text) gives no triple;
JSON null, numbers and booleans are triples of their kind; an empty array gives none; of a repeated
key the last counts; depth is not limited; lone surrogates become ``?``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = "doc string, path string, ordinals array<int>, kind string, value string"
_BLANK = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").match
_SPECIAL = re.compile(r"([.\[\]\\])")


def _named(key: str) -> str:
    """A key as part of a path: what has a meaning in paths is escaped."""
    return _SPECIAL.sub(r"\\\1", key if key.isascii() else key.encode("utf-8", "replace").decode())


def _prefixes(paths: frozenset[str]) -> frozenset[str]:
    """The paths that lead to ``paths``, with themselves."""
    out = set(paths)
    for p in paths:
        out.update(p[: m.start()] for m in re.finditer(r"(?<!\\)(?:\.|\[\])", p))
    return frozenset(out)


class _Stream:
    """Reads one JSON text from left to right and notes its triples; no value is built but the strings at its leaves."""

    def __init__(self, repeated: frozenset[str], keep: frozenset[str] | None):
        self.repeated, self.keep = repeated, keep
        self.lead = None if keep is None else _prefixes(keep)
        self.out: list[tuple | None] = []

    def note(self, path: str | None, at: tuple, kind: str, value: str | None) -> None:
        if path is not None and (self.keep is None or path in self.keep):
            self.out.append((path, at, kind, value))

    def _wrapped(self, text: str, path: str, at: tuple) -> bool:
        """Notes the JSON that a string holds; False if it holds none."""
        size = len(self.out)
        try:
            self.read(text, path, at)
        except ValueError:
            del self.out[size:]
            return False
        return True

    def string(self, s: str, path: str | None, at: tuple) -> None:
        if path is None:
            return
        if path in self.repeated:
            if s.lstrip()[:1] in ("{", "[", '"') and self._wrapped(s, path, at):
                return
            path, at = path + "[]", (*at, 1)
        elif path[-2:] == "[]" and path[:-2] in self.repeated and s.lstrip()[:1] == "{" and self._wrapped(s, path, at):
            return
        self.note(path, at, "string", s if s.isascii() else s.encode("utf-8", "replace").decode())

    def below(self, path: str | None, step: str) -> str | None:
        """The path one step down; None where nothing of it is wanted."""
        if path is None:
            return None
        path += step
        return path if self.lead is None or path in self.lead else None

    def read(self, text: str, path: str | None, at: tuple) -> None:
        # a frame: [places so far (of an array; None of an object), name -> its triples, name, first triple, lengths of the path and places around]
        stack: list[list] = []
        here, there = path, at  # of the innermost container that is wanted
        i, end = _BLANK(text, 0).end(), len(text)
        while True:
            c = text[i : i + 1]
            opened = c == "{" or c == "["
            if c == '"':
                s, i = scanstring(text, i + 1, True)
                self.string(s, path, at)
            elif opened:
                if c == "{" and path in self.repeated:
                    path, at = path + "[]", (*at, 1)
                if c == "{":
                    self.note(path, at, "object", None)
                stack.append([0 if c == "[" else None, {}, None, 0, -1 if path is None else len(here), len(there)])
                if path is not None:
                    here, there = path, at
                i = _BLANK(text, i + 1).end()
            elif m := _NUMBER(text, i):
                self.note(path, at, "number", m.group())
                i = m.end()
            else:
                word = next((w for w in ("true", "false", "null") if text.startswith(w, i)), None)
                if word is None:
                    raise ValueError("a value is expected")
                self.note(path, at, "null" if word == "null" else "boolean", None if word == "null" else word)
                i += len(word)
            # what follows a value, or opens the first value of a container
            while True:
                if not stack:
                    if _BLANK(text, i).end() != end:
                        raise ValueError("text after the value")
                    return
                top = stack[-1]
                if not opened:
                    if top[0] is None:
                        top[1][top[2]] = (top[3], len(self.out))
                    i = _BLANK(text, i).end()
                c = text[i : i + 1]
                if c == ("}" if top[0] is None else "]"):
                    stack.pop()
                    if top[4] >= 0:
                        here, there = here[: top[4]], there[: top[5]]
                    i, opened = i + 1, False
                    continue
                if not opened:
                    if c != ",":
                        raise ValueError("a comma is expected")
                    i = _BLANK(text, i + 1).end()
                break
            if top[0] is None:
                if text[i : i + 1] != '"':
                    raise ValueError("a name is expected")
                key, i = scanstring(text, i + 1, True)
                i = _BLANK(text, i).end()
                if text[i : i + 1] != ":":
                    raise ValueError("a colon is expected")
                i = _BLANK(text, i + 1).end()
                if key in top[1]:  # of a repeated name the last counts
                    for k in range(*top[1][key]):
                        self.out[k] = None
                top[2], top[3] = key, len(self.out)
                path, at = None if top[4] < 0 else self.below(here, "." + _named(key)), there
            else:
                top[0] += 1
                path, at = (None, there) if top[4] < 0 else (self.below(here, "[]"), (*there, top[0]))


def triples_of(text: str | None, repeated: frozenset[str], keep: frozenset[str] | None = None) -> list[tuple]:
    """(path, ordinals, kind, value) of one record, in document order."""
    if text is None or not text.strip():
        return []
    stream = _Stream(repeated, keep)
    try:
        stream.read(text, "$", ())
    except ValueError:
        return []
    return [t for t in stream.out if t is not None]


def json_triples(rows: DataFrame, key: str, columns: dict[str, tuple[str, ...]], keep: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key``, ``doc``, ``path``, ``ordinals``, ``kind``, ``value`` of the JSON in ``columns``.

    ``columns`` maps a column to its ``repeated`` paths; ``doc`` is the name of the column. ``keep``
    prunes, by column, to the paths named.
    """
    chosen = rows.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(c) for c in columns])
    key_type = chosen.schema["_key"].dataType.simpleString()
    specs = [(c, frozenset(r), frozenset(keep[c]) if keep and c in keep else None) for c, r in columns.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            ids = b.column(0).to_pylist()
            schema = schema or pa.schema([("_key", b.schema.field(0).type), ("doc", pa.string()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())])
            out: list[tuple] = []
            for c, repeated, kept in specs:
                for k, text in zip(ids, b.column(b.schema.get_field_index(c)).to_pylist()):
                    out.extend((k, c, *t) for t in triples_of(text, repeated, kept))
                    if len(out) > 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return chosen.mapInArrow(run, f"_key {key_type}, {TRIPLE}").withColumnRenamed("_key", key)


def ancestor(path):
    """The repeated ancestor of a path: up to and with its last ``[]``."""
    return F.regexp_extract(path, r"^(.*\[\])", 1)


def path_groups(triples: DataFrame) -> DataFrame:
    """One row per (doc, repeated ancestor): its leaf paths and the rows of its table."""
    t = triples.withColumn("ancestor", ancestor(F.col("path")))
    return t.groupBy("doc", "ancestor").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n_triples"))


def pivot_group(triples: DataFrame, key: str, doc: list[str], parent: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one repeated ancestor.

    One row per element of ``parent`` (with its kind), with ``fields`` (column: path below the
    element, ``""`` for the element itself) as strings. Children and parents share ``key``, ``doc``
    and the ordinals that they have in common.
    """
    at = {c: parent + p for c, p in fields.items()}
    mine = triples.filter(F.col("doc").isin(doc) & F.col("path").isin([parent, *at.values()]))
    return mine.groupBy(key, "doc", "ordinals").agg(
        F.max(F.when(F.col("path") == parent, F.col("kind"))).alias("kind"),
        *[F.max(F.when((F.col("path") == p) & (F.col("kind").isin("string", "number", "boolean")), F.col("value"))).alias(c) for c, p in at.items()],
        *[F.max(F.when(F.col("path") == p, F.col("kind"))).alias(f"{c}_kind") for c, p in at.items()],
    )
