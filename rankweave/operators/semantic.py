"""Overlap of lists of vectors: optimal assignment, and single-pass clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

VECTORS = "array<array<float>>"


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment of largest total gain (Hungarian method, O(n^2 m))."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((i, j) for j, i in assignment(gain.T))
    cost = gain.max() - gain
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def _unit(x) -> np.ndarray:
    a = np.array([np.asarray(e, dtype=float) for e in x])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def semantic_overlap(a, b, threshold: float = 0.85) -> float:
    """OVL3: assigned pairs of at least ``threshold`` cosine by the smaller list; 1 if both are empty, 0 if one is."""
    if a is None or b is None:
        return float("nan")
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = _unit(list(dict.fromkeys(map(tuple, a)))), _unit(list(dict.fromkeys(map(tuple, b))))
    sim = x @ y.T
    return sum(sim[i, j] >= threshold for i, j in assignment(sim)) / min(sim.shape)


def overlap_udf(threshold: float = 0.85):
    @pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([semantic_overlap(x, y, threshold) for x, y in zip(a, b)])

    return overlap


def clusters(vectors, threshold: float = 0.85) -> list[list[int]]:
    """CLU1: one forward pass; an item joins the open group if its largest similarity to a member reaches the threshold.

    Similarities are computed a row at a time, so a long list needs no square matrix.
    """
    u = _unit(vectors)
    free, out = np.ones(len(u), dtype=bool), []
    for i in range(len(u)):
        if not free[i]:
            continue
        free[i], group, at, best = False, [i], i, u @ u[i]
        while (near := np.flatnonzero(free[at + 1 :] & (best[at + 1 :] >= threshold))).size:
            at += 1 + int(near[0])
            free[at] = False
            group.append(at)
            best = np.maximum(best, u @ u[at])
        out.append(group)
    return out


def _central(u: np.ndarray, rows: int = 1024) -> int:
    """The row of largest total similarity to all rows, by blocks of rows."""
    return int(np.concatenate([(u[i : i + rows] @ u.T).sum(axis=1) for i in range(0, len(u), rows)]).argmax())


def top_semantic(df: DataFrame, group: str, order: str, name: str, vector: str, top_n: int | None = 10, threshold: float = 0.85) -> DataFrame:
    """CLU1 per group: representatives (closest to their cluster) and counts of the largest clusters.

    A group is one list of items, in ``order``; it is bounded by what one list holds.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o", kind="stable")
        counts = pdf["_n"].value_counts()
        first = pdf.drop_duplicates("_n")
        names, u = first["_n"].tolist(), _unit(first["_v"].tolist())
        rows = []
        for g in clusters(first["_v"].tolist(), threshold):
            rows.append((names[g[_central(u[g])]], int(sum(counts[names[i]] for i in g))))
        rows.sort(key=lambda r: -r[1])
        rows = rows[:top_n] if top_n else rows
        return pd.DataFrame({"_g": [key[0]] * len(rows), "position": range(1, len(rows) + 1), "name": [r[0] for r in rows], "n": [r[1] for r in rows]})

    d = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(name).cast("string").alias("_n"), F.col(vector).alias("_v")).filter("_n IS NOT NULL AND _v IS NOT NULL")
    kind = d.schema["_g"].dataType.simpleString()
    return d.groupBy("_g").applyInPandas(run, f"_g {kind}, position int, name string, n long").withColumnRenamed("_g", group)


def pair_overlap(lists: DataFrame, group: str, list_id: str, vectors: str, threshold: float = 0.85) -> DataFrame:
    """XR1: mean, variance and deviation of OVL3 over the pairs of a group's lists; NULL for one list."""
    a = lists.select(group, F.col(list_id).alias("_i"), F.col(vectors).alias("_a"))
    b = lists.select(group, F.col(list_id).alias("_j"), F.col(vectors).alias("_b"))
    p = a.join(b, group).filter("_i < _j").withColumn("v", overlap_udf(threshold)("_a", "_b"))
    m = p.groupBy(group).agg(F.count("*").alias("n_pairs"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.stddev_pop("v").alias("std"))
    return lists.select(group).distinct().join(m, group, "left").fillna(0, ["n_pairs"])


def blocked(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], blocks: int = 8) -> DataFrame:
    """Every row of ``a`` beside every row of ``b``, in ``blocks`` times ``blocks`` tasks: where the result is a matrix."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    part = lambda keys: F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")
    x = a.withColumn("_bi", part(a_keys)).withColumn("_bj", every)
    y = b.withColumn("_bj", part(b_keys)).withColumn("_bi", every)
    return x.join(y, ["_bi", "_bj"]).drop("_bi", "_bj")


def cross_overlap(lists: DataFrame, group: str, list_id: str, vectors: str, threshold: float = 0.85, within: str | None = None) -> DataFrame:
    """XR3, XR5: mean of OVL3 over all lists of one group by all lists of another, the whole matrix.

    The upper triangle with the diagonal (a list meets itself there) is computed and mirrored. With
    ``within`` only groups of the same value are compared; the other cells are 0.
    """
    i, j = f"{group}_i", f"{group}_j"
    same = [within] if within else []
    a = lists.select(F.col(group).alias(i), F.col(list_id).alias("_i"), F.col(vectors).alias("_a"), *same)
    b = lists.select(F.col(group).alias(j), F.col(list_id).alias("_j"), F.col(vectors).alias("_b"), *same)
    p = (a.join(b, within) if within else blocked(a, [i, "_i"], b, [j, "_j"])).filter(F.col(i) <= F.col(j)).withColumn("v", overlap_udf(threshold)("_a", "_b"))
    m = p.groupBy(i, j).agg(F.count("*").alias("n_pairs"), F.avg("v").alias("mean"))
    cell = F.explode(F.array_distinct(F.array(F.struct(F.col(i).alias("i"), F.col(j).alias("j")), F.struct(F.col(j).alias("i"), F.col(i).alias("j")))))
    m = m.select(cell.alias("_c"), "n_pairs", "mean").select(F.col("_c.i").alias(i), F.col("_c.j").alias(j), "n_pairs", "mean")
    if not within:
        return m
    groups = lists.select(group).distinct()
    cells = groups.withColumnRenamed(group, i).crossJoin(groups.withColumnRenamed(group, j))
    return cells.join(m, [i, j], "left").withColumn("mean", F.when(F.col("n_pairs").isNull(), F.lit(0.0)).otherwise(F.col("mean"))).fillna(0, ["n_pairs"])


def system_overlap(a: DataFrame, b: DataFrame, group: str, vectors: str, threshold: float = 0.85) -> DataFrame:
    """XR8: mean, variance and deviation of OVL3 over all lists of one system by all lists of another, of each group both have."""
    x = a.select(group, F.col(vectors).alias("_a"))
    p = x.join(b.select(group, F.col(vectors).alias("_b")), group)
    return p.withColumn("v", overlap_udf(threshold)("_a", "_b")).groupBy(group).agg(F.count("*").alias("n_pairs"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.stddev_pop("v").alias("std"))
