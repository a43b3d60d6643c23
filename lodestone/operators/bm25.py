"""BM25 with postings, and its top k for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from .store import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows (query, term) that go with the tasks at most (some 10 MB), queries in a block, chunks and words in a
#: batch, and pairs of a chunk's term and a query that are added up at once.
BROADCAST_ROWS, BLOCK, BATCH, WORDS, PAIRS = 200_000, 256, 1_000, 200_000, 1_000_000


@dataclass(frozen=True)
class Index:
    """postings (chunk_id, document_id, ordinal, term, tf, dl), terms (term, df, idf), corpus (n, avgdl, mean_idf)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def term_counts(words: Column) -> Column:
    """(term, tf) of each distinct word: the runs of equal words in their sorted array, so no row leaves its place."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        return F.element_at(F.transform(F.array(starts), lambda at: lengths(s, at)), 1)

    def lengths(s: Column, at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("long").alias("tf")))

    return F.when(F.size(words) > 0, F.element_at(F.transform(F.array(F.array_sort(words)), runs), 1))


def postings(chunks: DataFrame) -> DataFrame:
    """A row for each chunk and distinct term; nothing is shuffled."""
    worded = chunks.select("chunk_id", "document_id", "ordinal", tokens(F.col("text")).alias("tokens"))
    return worded.select("chunk_id", "document_id", "ordinal", F.size("tokens").alias("dl"), F.inline(term_counts(F.col("tokens"))))


def statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, total): in how many chunks a term is; the row without a term counts chunks and their words.

    One scan of the chunks and one shuffle of (term, df), combined before it.
    """
    words = tokens(F.col("text"))
    each = chunks.select(F.size(words).alias("dl"), F.array_distinct(words).alias("terms"))
    # a null term for the chunk itself
    rows = each.select("dl", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def weighted(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms (term, df, idf) and corpus (n, avgdl, mean_idf) of :func:`statistics`, best of a written table.

    A term in over half of the chunks has a negative idf, which is replaced by a quarter of the mean idf.
    """
    size = counted.where("term is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))  # one row
    raw = counted.where("term is not null").join(F.broadcast(size.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row, like size
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return terms, size.join(F.broadcast(mean))


def index(chunks: DataFrame, counted: DataFrame | None = None) -> Index:
    """Statistics over just these chunks: a scope's index is built from the scope's chunks.

    ``counted`` is what :func:`statistics` gave for them, if it was saved; else it is written now.
    """
    return Index(postings(chunks), *weighted(written(statistics(chunks), "statistics") if counted is None else counted))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def asked_terms(queries: DataFrame, built: Index) -> DataFrame:
    """(query_id, term, weight, avgdl): what a term that the corpus has adds to a query's score, but for the chunk's part."""
    asked = query_terms(queries).join(built.terms, "term").join(F.broadcast(built.corpus.select("avgdl")))  # one row
    return asked.select("query_id", "term", (F.col("idf") * (K1 + 1) * F.col("times")).alias("weight"), "avgdl")


def scores(queries: DataFrame, built: Index) -> DataFrame:
    """(query_id, chunk_id, document_id, ordinal, score) of all chunks that share a term with the query, by joins."""
    part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = built.postings.join(asked_terms(queries, built), "term")
    return found.groupBy("query_id", "chunk_id", "document_id", "ordinal").agg(F.round(F.sum(part), 6).alias("score"))


#: Documents sort by number where they have one.
def corpus_order() -> list:
    return [F.col("document_id").try_cast("long"), F.col("document_id"), F.col("ordinal")]


def _blocks(asked: list[tuple]) -> tuple[pa.Array, list[tuple[list, np.ndarray, np.ndarray, np.ndarray]]]:
    """The terms of (query_id, term, weight) and blocks of BLOCK queries: their ids and, by term, who asks for it.

    A term's queries in a block are ``queries[starts[t]:starts[t + 1]]``, with their ``weights``.
    """
    terms = {t: k for k, t in enumerate(sorted({t for _, t, _ in asked}))}
    names = sorted({q for q, _, _ in asked})
    place = {q: k for k, q in enumerate(names)}
    at = np.array([place[q] for q, _, _ in asked])
    of = np.array([terms[t] for _, t, _ in asked])
    weight = np.array([w for _, _, w in asked], np.float64)
    out = []
    for first in range(0, len(names), BLOCK):
        own = np.flatnonzero((at >= first) & (at < first + BLOCK))
        own = own[np.lexsort((at[own], of[own]))]
        starts = np.searchsorted(of[own], np.arange(len(terms) + 1))
        out.append((names[first : first + BLOCK], starts, at[own] - first, weight[own]))
    return pa.array(terms, pa.string()), out


def _finder(triples: list[tuple], avgdl: float, k: int, kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with chunks (chunk_id, document_id, ordinal, tokens, number) for queries (query_id, term, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, blocks = _blocks(triples)
        best: dict = {}
        bars = [np.full(len(names), -np.inf) for names, *_ in blocks]  # the kth score so far
        for whole in batches:
            for batch in _sliced(whole):
                n = batch.num_rows
                lists = batch.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
                met = at >= 0
                key, tf = np.unique(np.repeat(np.arange(n), sizes)[met] * len(terms) + at[met], return_counts=True)
                row, term = np.divmod(key, len(terms))
                part = tf / (tf + K1 * np.maximum(1 - B + B * sizes / avgdl, 1e-300)[row])
                for (names, starts, queries, weights), bar in zip(blocks, bars, strict=True):
                    found, shared = np.zeros(n * len(names)), np.zeros(n * len(names), bool)
                    every = starts[term + 1] - starts[term]
                    cuts = np.searchsorted(np.cumsum(every), np.arange(PAIRS, every.sum(), PAIRS))
                    for own in np.split(np.arange(len(term)), cuts):
                        many = every[own]
                        entry = np.arange(many.sum()) + np.repeat(starts[term[own]] - np.cumsum(many) + many, many)
                        pair = np.repeat(row[own] * len(names), many) + queries[entry]
                        found += np.bincount(pair, np.repeat(part[own], many) * weights[entry], len(found))
                        shared[pair[weights[entry] != 0]] = True
                    found, shared = np.round(found, 6).reshape(n, -1), shared.reshape(n, -1)
                    if (weights >= 0).all():
                        shared &= found > 0
                    score = np.where(shared, found, -np.inf)
                    least = bar
                    if n > k and np.count_nonzero(shared & (score >= bar)) > 2 * k * len(names):
                        least = np.maximum(bar, np.partition(score, n - k, axis=0)[n - k])
                    hit, by = np.nonzero(shared & (score >= least))
                    places = [batch.column(c).take(pa.array(hit)).to_pylist() for c in (4, 1, 2, 0)]
                    for q, s, number, *place in zip(by.tolist(), score[hit, by].tolist(), *places, strict=True):
                        best.setdefault(names[q], []).append((-s, number is not None, number or 0, *place))
                    for q in set(by.tolist()):
                        held = best[names[q]]
                        held.sort()
                        del held[k:]
                        if len(held) == k:
                            bar[q] = -held[-1][0]
        out = [(q, r[5], r[3], r[4], -r[0]) for q, held in best.items() for r in held]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "chunk_id", "document_id", "ordinal", "score"])

    return run


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of BATCH chunks and WORDS words at most, or one longer chunk."""
    ends, start = batch.column(3).offsets.to_numpy(), 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + WORDS, "right")) - 1
        stop = min(max(stop, start + 1), start + BATCH, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _scored(asked: list, chunks: DataFrame, k: int, query_type: str) -> DataFrame:
    """(query_id, chunk_id, document_id, ordinal, score): each task's ``k`` best chunks for each query.

    Chunks are counted over the queries' terms alone, a batch at a time, and only pairs of a chunk and a query that
    share a term are added up; a task holds its best so far, and looks at a score only if it reaches the ``k``-th of
    them.  So what is shuffled is ``k`` rows a query and task, whatever the corpus.
    """
    kinds = [pa.int64() if query_type == "bigint" else pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
    run = _finder([(r["query_id"], r["term"], r["weight"]) for r in asked], asked[0]["avgdl"], k, kinds)
    worded = chunks.select("chunk_id", "document_id", F.col("ordinal").cast("int").alias("ordinal"), tokens(F.col("text")).alias("tokens"), F.col("document_id").try_cast("long").alias("number"))
    return worded.mapInArrow(run, f"query_id {query_type}, chunk_id string, document_id string, ordinal int, score double")


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, built: Index | None = None) -> DataFrame:
    """The ``k`` best chunks of each query, with ``rank`` from 1; ties in corpus order.

    Chunks that share no term score 0 and fill up what is missing: the first ``k`` of the corpus suffice.
    The terms of a batch of queries go with the tasks, which read the chunks once and shuffle no postings;
    batches with more than BROADCAST_ROWS of them are joined with the postings by term.
    """
    built = built or index(chunks)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *corpus_order())
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kind = dict(queries.dtypes)["query_id"]
    asked = asked_terms(queries, built).limit(BROADCAST_ROWS + 1).collect() if kind in ("bigint", "string") else []
    few = kind in ("bigint", "string") and len(asked) <= BROADCAST_ROWS
    first = chunks.select("chunk_id", "document_id", "ordinal").orderBy(*corpus_order()).limit(k)
    none = queries.select("query_id").join(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows
    if few and not asked:
        return best(none)
    some = _scored(asked, chunks, k, kind) if few else best(scores(queries, built)).drop("rank")
    return best(some.unionByName(none).groupBy("query_id", "chunk_id", "document_id", "ordinal").agg(F.sum("score").alias("score")))


def stage_confidence(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.least(F.lit(1.0), F.max("score") / 10).alias("confidence"))
