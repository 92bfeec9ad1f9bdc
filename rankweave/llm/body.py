"""Problem 5: the body of a page without menus, notices, adverts, side lists and footers.

Method: minimum-cut labelling. Lines are nodes; the classifier's cost of calling a line body or
furniture are the capacities to the two terminals; adjacent lines, and lines of one block (no blank
line between), are joined by smoothness edges. The minimum cut separates body from furniture.

The graph of a page is banded (edges reach one or two lines), so its minimum cut is found exactly by
dynamic programming over the labels of the last two lines, for all pages of a batch at once; by
max-flow/min-cut duality its value is the maximum flow (tests compare it with augmenting paths).

Defined results: NULL and blank texts have no lines; blank lines are never furniture; a page that is
all furniture but for spam or an error message has no body and gives no line; repeated rows each
give theirs; whole texts of any length are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.mincut import furniture_lines
from rankweave.llm.residue import no_body
from rankweave.llm.spam import page_evidence

def _per_row(rows: DataFrame, key: str, text: str, shape: str, make) -> DataFrame:
    chosen = rows.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    key_type = chosen.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield make(b.column(0), b.column(1).to_pylist())

    return chosen.mapInArrow(run, f"_key {key_type}, {shape}").withColumnRenamed("_key", key)


def body_labels(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``line_no`` of the furniture lines of pages that have a body; no shuffle."""

    def make(keys: pa.Array, texts: list) -> pa.RecordBatch:
        found = furniture_lines(texts)
        ids, numbers = [], []
        for k, (lines, text) in enumerate(zip(found, texts)):
            if lines and has_body(text, lines):
                ids += [k] * len(lines)
                numbers += lines
        return pa.RecordBatch.from_arrays([keys.take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32())], names=["_key", "line_no"])

    return _per_row(rows, key, text, "line_no int", make)


def body_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``body``: the text without its furniture; NULL for pages without a body."""

    def make(keys: pa.Array, texts: list) -> pa.RecordBatch:
        out = []
        for text, lines in zip(texts, furniture_lines(texts)):
            drop = set(lines)
            kept = [x for i, x in enumerate((text or "").split("\n"), 1) if i not in drop]
            out.append("\n".join(kept).strip() or None if text and has_body(text, lines) else None)
        return pa.RecordBatch.from_arrays([keys, pa.array(out, pa.string())], names=["_key", "body"])

    return _per_row(rows, key, text, "body string", make)


def has_body(text: str, furniture: list[int]) -> bool:
    """Whether the rest of a page is more than spam, an error message or filler."""
    drop = set(furniture)
    rest = [s for i, x in enumerate(text.split("\n"), 1) if i not in drop and (s := x.strip())]
    if not rest:
        return False
    return not page_evidence(rest)["spam"] and not no_body(rest)
