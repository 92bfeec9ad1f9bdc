"""Problem 3: records that are identical but for formatting collapse into one, with exact copy counts.

Method: canonical records are range-partitioned by (key, id) and sorted within the partitions (the
sort spills to disk); a scan of each sorted partition compares the full keys of adjacent rows and
emits runs. As the id is part of the range, a key that holds a third of all rows is spread over
many partitions. The runs are written once; those that touch a partition's edge are joined by a table
of at most two rows a partition.

Defined results: rows with a NULL or blank url or run are no case; repeated rows (also of one id)
each count; ties cannot occur, as the smallest id represents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.urls import ALL_TRACKING
from rankweave.session import written

HELD = 16  # batches of one run that a scan holds back
EDGE_LIMIT = 200_000  # edge rows (two a partition) up to which they are broadcast


def _squeezed(text: Column) -> Column:
    """Letters and digits in lower case; what lies between them is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def _decoded(text: Column) -> Column:
    return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)


def canonical_url(url: Column) -> Column:
    """The page a url names, whatever its scheme, ``www.``, fragment, tracking, case, spacing, punctuation and parameter order."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), r"^[^\p{L}\p{N}]*(?:[A-Za-z][A-Za-z0-9+.-]*\s*:\s*[\\/]+)?[^\p{L}\p{N}]*(?i:www\.)*", "")
    path = _squeezed(_decoded(F.split_part(bare, F.lit("?"), F.lit(1))))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.transform(
        F.split(query, r"[&?]"),
        lambda kv: F.concat_ws("=", _squeezed(_decoded(F.split_part(kv, F.lit("="), F.lit(1)))), _squeezed(_decoded(F.regexp_extract(kv, r"=(.*)$", 1)))),
    )
    raw_name = lambda kv: F.replace(F.split_part(kv, F.lit("="), F.lit(1)), F.lit(" "), F.lit("_"))
    pairs = F.filter(pairs, lambda kv: (kv != "=") & ~raw_name(kv).isin(*ALL_TRACKING) & ~raw_name(kv).startswith("utm_"))
    return F.when(query == "", F.concat(path, F.lit("?"))).otherwise(F.concat(path, F.lit("?"), F.array_join(F.array_sort(pairs), "&")))


def canonical_run(run_id: Column) -> Column:
    """``P0001_R03`` and ``P0001_r3`` are one run."""
    r = F.trim(run_id)
    prompt, number = F.regexp_extract(r, r"^(.*)_[rR]0*(\d+)$", 1), F.regexp_extract(r, r"^(.*)_[rR]0*(\d+)$", 2)
    return F.when(number != "", F.concat_ws("_r", F.lower(F.trim(prompt)), number)).otherwise(F.lower(r))


def canonical_text(text: Column) -> Column:
    """Free text without regard to spacing, case and punctuation."""
    return _squeezed(text)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows ``(k, id)``.

    Emits ``(k, id, first, edge)`` per row, where ``first`` is the smallest id of the run in this
    partition and ``edge`` marks the rows of the partition's first and last run.
    """
    schema = pa.schema([("k", pa.string()), ("id", pa.int64()), ("first", pa.int64()), ("edge", pa.bool_())])

    def rows(ks, ids, firsts, edges):
        return pa.RecordBatch.from_arrays([ks.cast(pa.string()), ids.cast(pa.int64()), pa.array(firsts, pa.int64()), pa.array(edges, pa.bool_())], schema=schema)

    def inside(x):
        return x.set_column(3, "edge", pa.array(np.zeros(x.num_rows, dtype=bool)))

    key = first = None  # of the current run
    is_first, held = True, []  # whether it is the partition's first run; else its rows so far
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ks, ids = b.column(0), b.column(1)
        new = np.ones(n, dtype=bool)
        new[1:] = pc.not_equal(ks.slice(1), ks.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = ks[0].as_py() != key
        starts = np.flatnonzero(new)
        begin = int(starts[0]) if len(starts) else n
        if begin:
            more = rows(ks.slice(0, begin), ids.slice(0, begin), np.full(begin, first), np.ones(begin, dtype=bool))
            if is_first:
                yield more
            else:
                held.append(more)
        if len(held) > HELD:  # a run over many batches: as edge rows its rows get the same result
            yield from held
            held = []
        if not len(starts):
            continue
        yield from map(inside, held)
        held, last = [], int(starts[-1])
        own = ids.to_numpy(zero_copy_only=False)
        if last > begin:
            run = np.cumsum(new[begin:last]) - 1
            yield rows(ks.slice(begin, last - begin), ids.slice(begin, last - begin), own[starts[run]], (run == 0) if key is None else np.zeros(last - begin, dtype=bool))
        is_first = key is None and len(starts) == 1
        key, first = ks[last].as_py(), int(own[last])
        tail = rows(ks.slice(last), ids.slice(last), np.full(n - last, first), np.ones(n - last, dtype=bool))
        if is_first:
            yield tail
        else:
            held = [tail]
    yield from held


def copy_membership(records: DataFrame, key: str, id_col: str, partitions: int | None = None) -> DataFrame:
    """``(id, first)`` of each record with a key: ``first`` is the smallest id among its copies."""
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = records.select(F.col(key).alias("k"), F.col(id_col).cast("bigint").alias("id")).filter(F.col("k").isNotNull() & F.col("id").isNotNull())
    runs = chosen.repartitionByRange(n, "k", "id").sortWithinPartitions("k", "id").mapInArrow(_scan, "k string, id bigint, first bigint, edge boolean")
    # written once: a second scan could draw other range bounds, and its edges would not fit the runs of the first
    runs = written(runs.withColumn("k", F.when(F.col("edge"), F.col("k"))), "copy-runs")
    edges = runs.filter("edge").groupBy("k").agg(F.min("first").alias("_first"))
    edges = F.broadcast(edges) if 2 * n <= EDGE_LIMIT else edges
    at_edge = runs.filter("edge").join(edges, "k").select("id", F.col("_first").alias("first"))
    return runs.filter("NOT edge").select("id", "first").unionByName(at_edge)


def collapsed(members: DataFrame) -> DataFrame:
    """One row per record: ``first`` (its representative) and ``n_copies``."""
    return members.groupBy("first").agg(F.count("*").alias("n_copies"))
