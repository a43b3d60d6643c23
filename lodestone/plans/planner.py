"""Which stages a query takes, decided by rules over its words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, contains_any, entities


@dataclass(frozen=True)
class Rules:
    """A preset of the planner."""

    entity_weight: float
    fast_below: float
    most_entities: int
    multi_above: int
    stop_words: tuple[str, ...]
    fast_with_negation: bool
    temporal: tuple[str, ...]
    comparison: tuple[str, ...]
    negation: tuple[str, ...]
    relationship: tuple[str, ...]


#: Phrases that mark a kind of query, found anywhere in its lower-case text.
FUSED = Rules(
    0.04, 0.15, 3, 3, tuple(STOP_WORDS), True,
    ("q1 ", "q2 ", "q3 ", "q4 ", "fy20", "202", "201", "between ", "during ", "since "),
    ("vs", "compare", "difference between", "higher than", "lower than", "better than"),
    ("not", "except", "without", "other than"),
    ("lead to", "because of", "impact of", "relation between", "why did", "result of", "due to", "caused by", "depends on"),
)
SCOPED = Rules(
    0.25, 0.30, 1, 1, (), False,
    ("q1", "q2", "q3", "q4", "202", "201", "between", "during", "since", "year", "month"),
    ("vs", "compare", "difference", "higher", "lower", "better than"),
    ("not", "except", "without", "other than"),
    ("cause", "affect", "depend", "lead to", "because", "impact", "relation between", "why did", "result of", "due to"),
)

#: The stages of a fast query, and of one that uses the graph.
FAST_STAGES = ("bm25", "page_index", "vector")
GRAPH_STAGES = ("bm25", "page_index", "vector", "okf", "graph", "reranker", "fidelity_check", "compressor", "llm")


def flags(query: Column, rules: Rules) -> dict[str, Column]:
    lower = F.lower(query)
    return {x: contains_any(lower, getattr(rules, x)) for x in ("temporal", "comparison", "negation", "relationship")}


def complexity(n_entities: Column, f: dict[str, Column], rules: Rules) -> Column:
    part = lambda on, w: F.when(on, w).otherwise(0.0)
    total = (
        F.least(n_entities, F.lit(3)) * rules.entity_weight
        + part(n_entities > rules.multi_above, 0.20)
        + part(f["temporal"], 0.15)
        + part(f["comparison"], 0.15)
        + part(f["negation"], 0.10)
        + part(f["relationship"], 0.15)
    )
    return F.round(F.least(F.lit(1.0), total), 6)


def route(queries: DataFrame, rules: Rules = FUSED) -> DataFrame:
    """``queries`` (query_id, query) with entities, complexity, route (fast, graph, analytical, full), fast_path, use_graph and stages."""
    f = flags(F.col("query"), rules)
    marked = queries.withColumn("entities", entities(F.col("query"), list(rules.stop_words)))
    n = F.size("entities")
    score = complexity(n, f, rules)
    plain = ~f["relationship"] & ~f["temporal"] & ~f["comparison"]
    if not rules.fast_with_negation:
        plain = plain & ~f["negation"]
    way = F.when((score < rules.fast_below) & (n <= rules.most_entities) & plain, "fast").when(f["relationship"], "graph").when(f["temporal"] | f["comparison"], "analytical").otherwise("full")
    full = [s for s in GRAPH_STAGES if s != "graph"]
    stages = lambda names: F.array(*map(F.lit, names))
    return (
        marked.withColumn("complexity", score)
        .withColumn("route", way)
        .withColumn("fast_path", F.col("route") == "fast")
        .withColumn("use_graph", F.col("route") == "graph")
        .withColumn("stages", F.when(F.col("fast_path"), stages(FAST_STAGES)).when(F.col("use_graph"), stages(GRAPH_STAGES)).otherwise(stages(full)))
    )
