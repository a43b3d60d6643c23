"""What the pipelines hold and compute: candidates' vectors alone, and facts by their number."""

from pyspark.sql import functions as F

from lodestone.functions.vectors import hash_embedding
from lodestone.operators import chunking, knowledge
from lodestone.plans import pipeline


def chunked(spark):
    """Chunks of which the last document is asked for by no question."""
    texts = ["Paris is the capital of France and of much else", "Rome is the capital of Italy and of much else", "Paris and Rome are compared here in many words"] * 12 + ["never embedded"]
    return chunking.paragraph_chunks(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string"))


def asked(spark):
    return spark.createDataFrame([(1, "What is the capital of Paris"), (2, "Compare Paris with Rome during 2024 without France"), (3, "Why did Rome lead to Paris")], "query_id long, query string")


def graph(spark):
    """Concepts that share a name, properties that repeat and hold nulls, and a relation."""
    concepts = spark.createDataFrame([("a", "Paris"), ("b", "Paris"), ("c", "Rome"), ("d", "Oslo")], "id string, name string")
    facts = [("a", "size", "big", "1"), ("b", "size", "big", "1"), ("b", "size", "big", "2"), ("c", "size", None, "1"), ("c", "size", None, "1"), ("c", "age", "old", None), ("d", "size", "big", "3")]
    properties = spark.createDataFrame([(*f, 1.0) for f in facts], "concept_id string, property_name string, property_value string, source_chunk_id string, confidence double")
    relations = spark.createDataFrame([("a", "c", "CAUSES", 0.5), ("c", "d", "CAUSES", 0.5), ("c", "a", "AFFECTS", 0.1)], "from_concept_id string, to_concept_id string, relation_type string, relation_weight double")
    return pipeline.Knowledge(concepts, properties, relations)


def test_scoped_vectors_are_computed_of_candidates_alone(spark):
    """A text that is no candidate is not embedded; answers are those over chunks that have their vectors."""
    def embed(width):
        return lambda t: F.when(t.startswith("never"), F.raise_error(F.lit("embedded")).cast("array<double>")).otherwise(hash_embedding(t, width, normalize=False))

    config = pipeline.Config(**{**pipeline.SCOPED.__dict__, "embed": embed(384), "embed_full": embed(1024)})
    plain = pipeline.Config(**{**pipeline.SCOPED.__dict__, "embed": lambda t: hash_embedding(t, 384, normalize=False)})
    got = sorted(map(str, pipeline.answers(asked(spark), chunked(spark), config).collect()))
    assert got == sorted(map(str, pipeline.answers(asked(spark), pipeline.vectored(chunked(spark), plain), plain).collect())) and len(got) == 3


def test_facts_by_their_number(spark):
    """As many as there are in the columns of facts, of which no query's are held together."""
    for config in (pipeline.FUSED, pipeline.SCOPED):
        whole, numbers = ({r.query_id: r for r in pipeline.answers(asked(spark), chunked(spark), config, graph(spark), counted=c).collect()} for c in (False, True))
        for k, row in whole.items():
            assert (numbers[k].properties, numbers[k].graph) == tuple(None if x is None else len(x) for x in (row.properties, row.graph))
            assert numbers[k].answer == row.answer
        assert {r.properties for r in numbers.values()} > {4}
    found = knowledge.fact_counts(asked(spark), graph(spark).concepts, graph(spark).properties)
    assert "collect_" not in found._jdf.queryExecution().toString() and {r.query_id: r.facts for r in found.collect()} == {1: 2, 2: 4, 3: 4}
