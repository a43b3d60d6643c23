"""Calls of models over rows: batches, a rate for each task, bounded retries, and a result or an error for each row.

    def scorer(): client = connect(); return lambda rows: client.score([(r["query"], r["text"]) for r in rows])
    calls.call(pairs, scorer, "double")     # adds result, error, attempts, ms

The client is made once for each task; it gets a list of dicts and returns a value for each of them.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from ..functions.scores import jaccard
from .answer import parse_output
from .store import written


class RateLimited(Exception):
    """A client's sign that it may be called again later, after ``seconds`` if it knows."""

    def __init__(self, seconds: float | None = None):
        super().__init__("rate limited")
        self.seconds = seconds


@dataclass(frozen=True)
class Policy:
    """Rows of a call; calls a second of one task (0: any), of which ``burst`` may come at once; attempts at a call;
    the wait after the first failed one, which doubles, with up to ``jitter`` of it on top; the longest wait.

    A cluster's rate is ``per_second`` times the tasks that run at once.
    """

    batch: int = 20
    per_second: float = 2.0
    burst: int = 1
    attempts: int = 5
    backoff: float = 1.0
    jitter: float = 1.0
    longest: float = 60.0


class Bucket:
    """A token bucket on a monotonic clock."""

    def __init__(self, per_second: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.most, self.clock, self.sleep = per_second, max(1, burst), clock, sleep
        self.tokens, self.at = float(self.most), clock()

    def take(self) -> None:
        if self.rate <= 0:
            return
        now = self.clock()
        self.tokens = min(self.most, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.at, self.tokens = self.clock(), 1.0
        self.tokens -= 1


def attempted(client: Callable[[list[dict]], list], rows: list[dict], policy: Policy, bucket: Bucket, sleep: Callable[[float], None] = time.sleep) -> tuple[list, str | None, int]:
    """(a value for each row, error, attempts): what the client returns, or nulls and the last error."""
    error = None
    for n in range(1, policy.attempts + 1):
        bucket.take()
        try:
            values = list(client(rows))
            if len(values) != len(rows):
                raise ValueError(f"{len(values)} results for {len(rows)} rows")
            return values, None, n
        except Exception as e:  # noqa: BLE001  whatever a client raises becomes the batch's error
            error = f"{type(e).__name__}: {e}"
            if n < policy.attempts:
                wait = policy.backoff * 2 ** (n - 1) * (1 + random.random() * policy.jitter)
                sleep(min(policy.longest, max(wait, getattr(e, "seconds", None) or 0)))
    return [None] * len(rows), error, policy.attempts


def call(rows: DataFrame, client: Callable[[], Callable[[list[dict]], list]], kind: str, policy: Policy = Policy()) -> DataFrame:
    """``rows`` with ``result`` (of type ``kind``), ``error``, ``attempts`` and ``ms``, the time of the row's batch.

    Rows go out in batches of ``policy.batch``, in their order within a partition, so rows that belong together should lie
    together.  A batch that fails for good has null results and its error; others go on.  A task that is run again
    calls again: keep the outcome as a table.
    """
    result = _parse_datatype_string(kind)
    schema = StructType([*rows.schema.fields, StructField("result", result), StructField("error", StringType()), StructField("attempts", IntegerType()), StructField("ms", DoubleType())])
    kinds = (to_arrow_type(result), pa.string(), pa.int32(), pa.float64())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, bucket = None, Bucket(policy.per_second, policy.burst)
        for batch in batches:
            for start in range(0, batch.num_rows, policy.batch):
                part = batch.slice(start, policy.batch)
                ask = ask or client()
                began = time.monotonic()
                values, error, attempts = attempted(ask, part.to_pylist(), policy, bucket)
                took = 1000 * (time.monotonic() - began)
                columns = (values, [error] * len(values), [attempts] * len(values), [took] * len(values))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], schema.names)

    return rows.mapInArrow(each, schema)


def reranked(candidates: DataFrame, client: Callable[[], Callable[[list[dict]], list]], k: int = 6, policy: Policy = Policy()) -> DataFrame:
    """Candidates (query_id, query, chunk_id, text, fused_rank) by a model's logits through the sigmoid.

    Where a batch fails for good, its rows alone are scored by Jaccard; ``scored_by`` says which.  Ties keep the fused rank.
    """
    asked = call(candidates.repartition("query_id").sortWithinPartitions("query_id", "fused_rank"), client, "double", policy)
    logit = F.col("result")
    near = F.when(logit >= 0, 1 / (1 + F.exp(-logit))).otherwise(F.exp(logit) / (1 + F.exp(logit)))  # neither overflows
    failed = F.col("error").isNotNull() | logit.isNull() | F.isnan("result")
    scored = asked.withColumn("rerank_score", F.round(F.when(failed, jaccard(F.col("query"), F.col("text"))).otherwise(near), 6)).withColumn("scored_by", F.when(failed, "jaccard").otherwise("model"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "fused_rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k).drop("result")


#: What a model says about the concepts of a batch of chunks.
FACTS = "array<struct<concept: string, property_name: string, property_value: string, source_chunk_id: string, confidence: double>>"
_FENCE = re.compile(r"^```(?:json)?|```$")


def _whole_batch(client: Callable[[], Callable[[list[dict]], str]]) -> Callable[[], Callable[[list[dict]], list]]:
    """A client of one JSON list a batch as one of a text a row: the first row has it.  What is no list raises, and is asked again."""

    def made():
        ask = client()

        def each(rows: list[dict]) -> list:
            text = _FENCE.sub("", ask(rows).strip()).strip()
            if not isinstance(json.loads(text), list):
                raise ValueError("the answer is no list")
            return [text] + [None] * (len(rows) - 1)

        return each

    return made


def extracted(chunks: DataFrame, client: Callable[[], Callable[[list[dict]], str]], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(properties, failures) of chunks (chunk_id, text), by a model that answers each batch with a JSON list of FACTS.

    Code fences around the list are dropped; facts without a concept or about no chunk of the table are left out, a
    missing confidence is 0.  The chunks of a batch that failed for good are failures (chunk_id, error).
    """
    asked = written(call(chunks.select("chunk_id", "text"), _whole_batch(client), "string", policy), "extracted")
    facts = asked.where("result is not null").select(F.inline(F.from_json("result", FACTS))).where(F.length(F.trim("concept")) > 0)
    known = facts.join(chunks.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_semi")
    found = known.select(F.trim("concept").alias("concept"), "property_name", "property_value", "source_chunk_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit("tier3_model").alias("extraction_tier"))
    return found, asked.where("error is not null").select("chunk_id", "error")


def judged(answers: DataFrame, client: Callable[[], Callable[[list[dict]], list[str]]], policy: Policy = Policy(batch=1)) -> DataFrame:
    """(query_id, faithful) of answers (query_id, context, answer, fast_path) by a model that says YES or NO.

    Fast answers and NOT_FOUND are not judged and have no row; a call that fails for good counts as not faithful.
    """
    due = answers.where(~F.col("fast_path") & (F.trim("answer") != "NOT_FOUND")).select("query_id", "context", "answer")
    said = call(due, client, "string", policy)
    return said.select("query_id", F.coalesce(F.contains(F.upper("result"), F.lit("YES")), F.lit(False)).alias("faithful"))


def faithfulness(judgements: DataFrame) -> DataFrame:
    """One row: the share of judged answers that are faithful (none: 0), and how many were judged."""
    return judgements.agg(F.coalesce(F.avg(F.col("faithful").cast("double")), F.lit(0.0)).alias("faithfulness"), F.count("*").alias("judged"))


def answered(contexts: DataFrame, client: Callable[[], Callable[[list[dict]], list[str]]], policy: Policy = Policy(), prompt_chars: int = 30_000, context_chars: int = 4_000) -> DataFrame:
    """(query_id, answer, citations, error) of contexts (query_id, query, context): a model's answers, read as :func:`answer.parse_output` does.

    The context is cut to ``context_chars`` and the question to ``prompt_chars``.  A call that fails for good answers NOT_FOUND
    and has its error.
    """
    cut = contexts.select("query_id", F.left("query", F.lit(prompt_chars)).alias("query"), F.left("context", F.lit(context_chars)).alias("context"))
    asked = call(cut, client, "string", policy)
    said = asked.withColumn("said", parse_output(F.coalesce("result", F.lit("NOT_FOUND"))))
    return said.select("query_id", "said.answer", "said.citations", "error")


def counters(calls: DataFrame, provider: str) -> DataFrame:
    """Calls as (provider, ms) rows of batches for :func:`evaluate.provider_counters`: one for each distinct batch time."""
    return calls.select("ms").distinct().select(F.lit(provider).alias("provider"), "ms")
