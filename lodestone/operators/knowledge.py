"""Concepts, properties and relations: extraction, clustering of names, lookup and bounded walks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entities, raw_tokens
from ..schemas import CONCEPT_TYPES
from . import vector
from .fusion import settle
from .store import written

#: Verbs by relation type.
VERBS = {"CAUSES": "causes|leads to|results in", "DEPENDS_ON": "depends on|relies on|requires", "AFFECTS": "affects|impacts|influences"}
MAX_HOPS, MAX_ROWS, MIN_WEIGHT = 2, 40, 0.3


def extract_properties(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Dates, percentages and identifiers in chunks, a row for each, as facts of ``DocumentEntity``.

    ``strict`` finds a percentage only where a word character follows its sign.
    """
    dates = F.regexp_extract_all("text", F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b"), F.lit(1))
    percentages = F.regexp_extract_all("text", F.lit(r"\b([0-9]+(?:\.[0-9]+)?%)" + (r"\b" if strict else "")), F.lit(1))
    identifiers = F.filter(raw_tokens(F.col("text")), lambda x: x.rlike("^[A-Z0-9]{5,}$"))

    def named(name: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("property_name"), v.alias("property_value")))

    facts = F.concat(named("Date", dates), named("Percentage", percentages), named("Identifier", identifiers))
    return chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.inline(facts)).select(
        F.lit("DocumentEntity").alias("concept"), "property_name", "property_value", "source_chunk_id", F.lit(1.0).alias("confidence"), F.lit("tier1_regex").alias("extraction_tier")
    )


def _sites(texts: DataFrame, verbs: dict[str, str], longest: int) -> DataFrame:
    """A row for each place where a name may stand beside a verb: on ``side`` 0 it ends at ``at``, on side 1 it begins there.

    ``far`` is the number of words between, up to three, ``alternative`` the verb's place in its family, and ``near``
    the ``longest`` characters there.
    """
    compiled = [(kind, k, re.compile(rf"(?<=\s){v}(?=\s)", re.IGNORECASE)) for kind, family in verbs.items() for k, v in enumerate(family.split("|"))]
    word, space = re.compile(r"\w+\s+"), re.compile(r"\s+")
    schema = "chunk_id string, relation_type string, verb int, alternative int, side int, far int, at int, near string"

    def ends(text: str, at: int) -> Iterator[int]:
        """Where a name may end before the verb at ``at``: in front of its white space, and of up to three words'."""
        for _ in range(4):
            end = at
            while end and text[end - 1].isspace():
                end -= 1
            if end == at:
                return
            yield end
            at = end
            while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                at -= 1
            if at == end:
                return

    def begins(text: str, end: int) -> Iterator[int]:
        at = space.match(text, end).end()
        for _ in range(4):
            yield at
            if not (next_word := word.match(text, at)):
                return
            at = next_word.end()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, k, verb in compiled:
                    for m in verb.finditer(text):
                        rows += [(chunk, kind, m.start(), k, 0, far, at, text[max(0, at - longest) : at]) for far, at in enumerate(ends(text, m.start()))]
                        rows += [(chunk, kind, m.start(), k, 1, far, at, text[at : at + longest]) for far, at in enumerate(begins(text, m.end()))]
            for start in range(0, len(rows), 5000):
                columns = zip(*rows[start : start + 5000], strict=True)
                kinds = (pa.string(),) * 2 + (pa.int32(),) * 5 + (pa.string(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    some = "|".join(verbs.values())
    return texts.where(F.col("text").rlike(rf"(?i)\s(?:{some})\s")).select(F.col("chunk_id").cast("string"), "text").mapInArrow(each, schema)


def extract_relations(chunks: DataFrame, names: DataFrame, verbs: dict[str, str] | None = None) -> DataFrame:
    """Concept, verb, concept within a chunk, up to three words on either side of the verb; the longest names first.

    As a pattern of all ``names`` (name) would find them, without regard to case: from the left, no match within
    another; but the names stay a table of any size.  Only places beside a verb are looked at: the stretches there of the
    lengths that names have meet the names by equality, and a fold over a chunk's few candidates keeps those that a scan
    from the left would.  A text equal on both sides is no relation.  Null texts and empty names are left out.
    """
    verbs = VERBS if verbs is None else verbs
    own = names.where(F.length("name") > 0).select(F.lower("name").alias("name")).distinct()
    lengths = own.agg(F.sort_array(F.collect_set(F.length("name"))).alias("lengths"), F.max(F.length("name")).alias("longest"))
    longest = lengths.first()["longest"] or 0
    sites = _sites(chunks, verbs, longest).join(F.broadcast(lengths.select("lengths")))  # one row, as long as there are different lengths
    tried = sites.withColumn("size", F.explode(F.filter("lengths", lambda n: n <= F.length("near"))))
    tried = tried.withColumn("start", F.when(F.col("side") == 0, F.col("at") - F.col("size")).otherwise(F.col("at")))
    tried = tried.withColumn("found", F.when(F.col("side") == 0, F.substr("near", F.length("near") - F.col("size") + 1, F.col("size"))).otherwise(F.substr("near", F.lit(1), F.col("size"))))
    kept = tried.drop("near", "lengths").withColumn("name", F.lower("found")).join(own, "name", "left_semi")
    one = ["chunk_id", "relation_type", "verb", "alternative"]
    left, right = (kept.where(F.col("side") == side).select(*one, F.struct("start", "size", "far", "found").alias(x)) for side, x in ((0, "l"), (1, "r")))
    # what a pattern prefers: the leftmost start, then the longest first name, many words, the first verb, many words, the longest second name
    order = F.struct("l.start", (-F.col("l.size")).alias("a"), (-F.col("l.far")).alias("b"), "alternative", (-F.col("r.far")).alias("c"), (-F.col("r.size")).alias("d"), (F.col("r.start") + F.col("r.size")).alias("end"), F.col("l.found").alias("from_concept"), F.col("r.found").alias("to_concept"))
    options = left.join(right, one).groupBy("chunk_id", "relation_type").agg(F.array_sort(F.collect_list(order)).alias("options"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from_concept:string,to_concept:string>>").alias("taken"))
    taken = F.aggregate("options", none, lambda s, o: F.when(o["start"] >= s["end"], F.struct(o["end"].alias("end"), F.concat(s["taken"], F.array(F.struct(o["from_concept"].alias("from_concept"), o["to_concept"].alias("to_concept")))).alias("taken"))).otherwise(s))
    out = options.select(F.col("chunk_id").alias("source_chunk_id"), "relation_type", F.inline(taken["taken"])).where(F.lower("from_concept") != F.lower("to_concept"))
    return out.select("from_concept", "to_concept", "relation_type", F.lit(0.6).alias("relation_weight"), "source_chunk_id", F.lit(True).alias("low_confidence"), F.lit("tier1.5_regex").alias("extraction_tier"))


def _heads(names: DataFrame, near: DataFrame) -> DataFrame:
    """(name): the names that open a cluster, taken in sorted order, where ``near`` (a, b, score; a < b) are similar.

    A name opens one unless a smaller near name has.  In each round the names whose smaller near names are all
    settled are settled; what is written ends the lineage.  Rounds are as many as the longest chain of falling names
    that are near one another, mostly a few.
    """
    open_ = written(names.select("name"), "open")
    edges = written(near.select("a", "b"), "edges")
    heads = None
    while not open_.isEmpty():
        new = written(open_.join(edges.select(F.col("b").alias("name")), "name", "left_anti"), "heads")
        heads = new if heads is None else heads.union(new)
        joined = edges.join(new.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        settled = written(new.union(joined), "settled")
        open_ = written(open_.join(settled, "name", "left_anti"), "open")
        for end in "ab":  # a name that joined opens nothing, so it stands in no other's way
            edges = edges.join(settled.select(F.col("name").alias(end)), end, "left_anti")
        edges = written(edges, "edges")
    return open_ if heads is None else heads


def _joined(names: DataFrame, least: float, first: bool) -> DataFrame:
    """(name, canonical, score): each distinct name with the head that it joins, itself where it is one (score null)."""
    settle(names)
    own = written(names.select("name", "vector").dropDuplicates(["name"]), "names")
    near = written(vector.similar(own, least, "vector", "name"), "near")
    heads = written(_heads(own, near), "heads")
    choices = near.join(heads.select(F.col("name").alias("a")), "a", "left_semi").join(heads.select(F.col("name").alias("b")), "b", "left_anti")
    place = F.struct("a") if first else F.struct((-F.col("score")).alias("s"), "a")
    best = choices.groupBy(F.col("b").alias("name")).agg(F.min_by(F.struct("a", "score"), place).alias("best"))
    return own.select("name").join(best, "name", "left").select("name", F.coalesce("best.a", "name").alias("canonical"), F.col("best.score").alias("score"))


def cluster_first(names: DataFrame, merge: float = 0.92) -> DataFrame:
    """(name, canonical): names (name, vector) joined, in sorted order, to the first cluster whose first name is similar enough.

    Others open a cluster.  A repeated name counts once; a name without a vector is a cluster of its own.
    """
    return _joined(names, merge, True).select("name", "canonical")


def cluster_names(names: DataFrame, merge: float = 0.92, review: float = 0.85) -> DataFrame:
    """(name, canonical, low_confidence, review): names (name, vector) joined, in sorted order, to the cluster whose first name is most similar.

    From ``merge`` on they join; between ``review`` and it they join with low confidence; below, a new cluster
    opens, marked for review unless it is the first of all.  Similarities are exact, in blocks; ties go to the first cluster.
    """
    joined = _joined(names, review, False)
    least = joined.agg(F.min("name").alias("least"))
    low = F.coalesce(F.col("score") < merge, F.lit(False))
    return joined.join(F.broadcast(least)).select("name", "canonical", low.alias("low_confidence"), ((F.col("name") == F.col("canonical")) & (F.col("name") != F.col("least"))).alias("review"))


def lookup(queries: DataFrame, concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties of the concepts that a query names, with their case."""
    named = queries.select("query_id", F.explode(entities(F.col("query"))).alias("name"))
    own = concepts.select(F.col("id").alias("concept_id"), F.col("name"))
    found = named.join(own, "name").join(properties, "concept_id")
    return found.select("query_id", F.col("name").alias("concept"), "property_name", "property_value", "source_chunk_id", "confidence")


def fact_counts(queries: DataFrame, concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """(query_id, facts): how many different properties :func:`lookup` finds for each query, of those that find any.

    They are told apart once for each name, however many queries have it, and no query's are held together.
    """
    named = written(queries.select("query_id", F.explode(entities(F.col("query"))).alias("name")), "named")
    own = written(concepts.select(F.col("id").alias("concept_id"), "name").join(named.select("name").distinct(), "name", "left_semi"), "concepts")
    different = properties.select("concept_id", "property_name", "property_value", "source_chunk_id").join(own, "concept_id").drop("concept_id").distinct()
    return named.join(different.groupBy("name").agg(F.count("*").alias("n")), "name").groupBy("query_id").agg(F.sum("n").alias("facts"))


def starts(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, concept_id): the concepts whose names a query holds as entities, where its walk begins."""
    named = queries.select("query_id", F.explode(entities(F.col("query"))).alias("name"))
    return named.join(concepts.select(F.col("id").alias("concept_id"), "name"), "name").select("query_id", "concept_id").distinct()


def walk(starts: DataFrame, relations: DataFrame, hops: int = MAX_HOPS, rows: int | None = MAX_ROWS, least: float = MIN_WEIGHT) -> DataFrame:
    """Nodes within ``hops`` edges of weight ``least`` or more from each start (query_id, concept_id).

    Distinct (node, relation type, weight, hop) rows, at most ``rows`` for each query: near ones first, then
    heavy ones.  Each hop is deduplicated before the next, so a cycle costs no more than its nodes.
    """
    from pyspark.sql.window import Window

    edges = relations.where(F.col("relation_weight") >= least).select("from_concept_id", "to_concept_id", "relation_type", "relation_weight")
    front = starts.select("query_id", F.col("concept_id").alias("from_concept_id")).distinct()
    out = None
    for hop in range(1, hops + 1):
        step = front.join(edges, "from_concept_id").select("query_id", F.col("to_concept_id").alias("concept_id"), "relation_type", "relation_weight", F.lit(hop).alias("hop")).distinct()
        out = step if out is None else out.unionByName(step)
        front = step.select("query_id", F.col("concept_id").alias("from_concept_id")).distinct()
    if rows is None:
        return out
    order = Window.partitionBy("query_id").orderBy("hop", F.col("relation_weight").desc(), "concept_id", "relation_type")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).drop("place")


def type_audit(concepts: DataFrame) -> DataFrame:
    """How many concepts each type has, and whether it is a known type."""
    return concepts.groupBy("type").agg(F.count("*").alias("n")).withColumn("known", F.col("type").isin(*CONCEPT_TYPES))
