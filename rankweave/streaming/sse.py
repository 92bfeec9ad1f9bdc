"""Assembly of answers from event-stream chunks, in batch and as a stream; pacing per domain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = "struct<queries:array<string>,groups:array<string>,refs:array<string>,classification:string,text:string>"


def chunk(line: Column) -> Column:
    """The JSON of a ``data:`` line; NULL for others, for the end mark and for what is not JSON."""
    t = F.trim(line)
    body = F.trim(F.substring(t, 6, 1 << 30))
    return F.when(t.startswith("data:") & (body != "[DONE]") & F.try_parse_json(body).isNotNull(), F.from_json(body, CHUNK))


def assembled(lines: DataFrame, conversation: str, order: str, line: str) -> DataFrame:
    """STM1 in batch: queries in first-seen order, groups and references appended, the first classification."""
    c = lines.select(F.col(conversation).alias("_c"), F.col(order).alias("_o"), chunk(F.col(line)).alias("d")).filter("d IS NOT NULL")
    ordered = c.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_o", "d"))).alias("a"), F.min_by("d.classification", F.when(F.col("d.classification").isNotNull(), F.col("_o"))).alias("classification"))
    part = lambda n: F.flatten(F.transform("a", lambda x: F.coalesce(x.d[n], F.array().cast("array<string>"))))
    text = F.array_join(F.transform("a", lambda x: F.coalesce(x.d["text"], F.lit(""))), "")
    return ordered.select(F.col("_c").alias(conversation), F.array_distinct(part("queries")).alias("queries"), part("groups").alias("groups"), part("refs").alias("refs"), "classification", text.alias("text"))


STATE = "queries array<string>, n_refs int, classification string, text string"
OUT = "conversation string, queries array<string>, n_refs int, classification string, text string"


def assembled_stream(lines: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """STM1 as a stream of (conversation, ord, line): the state of each conversation after each batch.

    State is one row per open conversation. It is dropped with the end mark, and with ``timeout_ms``
    also when no chunk came for so long (a query with a timeout runs on without data, so it does not
    end by itself).
    """
    done = F.trim(F.substring(F.trim("line"), 6, 100)) == "[DONE]"
    parsed = lines.select("conversation", "ord", chunk(F.col("line")).alias("d"), (F.trim("line").startswith("data:") & done).alias("done")).filter("d IS NOT NULL OR done")
    parsed = parsed.select("conversation", "ord", "done", "d.queries", "d.refs", "d.classification", "d.text")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, n, kind, text = state.get if state.exists else ([], 0, None, "")
        queries, ended = list(queries), False
        for b in batches:
            for r in b.sort_values("ord").itertuples(index=False):
                queries += [q for q in (r.queries if r.queries is not None else []) if q not in queries]
                n += len(r.refs) if r.refs is not None else 0
                kind = kind if kind is not None else r.classification
                text += r.text or ""
                ended |= bool(r.done)
        if not ended:
            state.update((queries, n, kind, text))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"conversation": [key[0]], "queries": [queries], "n_refs": [n], "classification": [kind], "text": [text]})

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return parsed.groupBy("conversation").applyInPandasWithState(step, OUT, STATE, "update", timeout)


def paced(requests: DataFrame, domain: str, at: str, order: str, spacing_ms: int) -> DataFrame:
    """STM3: the earliest start of each request when a domain is asked at most once in ``spacing_ms``.

    start_i = max over j <= i of (at_j + (i - j) * spacing), a running maximum.
    """
    w = W.partitionBy(domain).orderBy(at, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    t = F.unix_millis(F.col(at).cast("timestamp"))
    n = F.row_number().over(W.partitionBy(domain).orderBy(at, order))
    d = requests.withColumn("_n", n).withColumn("_base", t - F.col("_n") * spacing_ms)
    return d.withColumn("start_ms", F.max("_base").over(w) + F.col("_n") * spacing_ms).withColumn("wait_ms", F.col("start_ms") - t).drop("_n", "_base")
