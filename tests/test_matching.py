"""Dictionary matches, substring and prefix joins, and the vector index, against plain versions."""

import random
import re
import tempfile

from pyspark.sql import functions as F

from lodestone.operators import affix, knowledge, vector, vector_index

SEED = random.Random(11)


def _pattern(texts, names, verbs):
    """Relations as one pattern of all names finds them."""
    out = []
    group = "(" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")"
    for kind, family in verbs.items():
        pattern = re.compile(group + r"\s+(?:\w+\s+){0,3}(?:" + family + r")\s+(?:\w+\s+){0,3}" + group, re.IGNORECASE)
        for i, text in texts:
            out += [(i, kind, m[1], m[2]) for m in pattern.finditer(text or "") if m[1].lower() != m[2].lower()]
    return sorted(out)


def _relations(spark, texts, names, verbs):
    chunks = spark.createDataFrame(texts, "chunk_id string, text string")
    found = knowledge.extract_relations(chunks, spark.createDataFrame([(n,) for n in names], "name string"), verbs)
    return sorted((r.source_chunk_id, r.relation_type, r.from_concept, r.to_concept) for r in found.collect())


def test_relations_equal_one_pattern_of_200_names(spark):
    words = ["Ab", "cd", "EF", "gé", "a.b", "x_1", "causes", "leads to", "affects", "requires", "no", "of"]
    names = [n for n in {" ".join(SEED.choices(words[:6] + ["pump", "valve"], k=SEED.choice([1, 1, 2, 3]))) for _ in range(400)}][:200] + ["causes", "b"]
    texts = [(str(k), "".join(SEED.choice(words) + SEED.choice([" ", " ", " ", "  ", "\t", ", ", ""]) for _ in range(SEED.randrange(40)))) for k in range(300)]
    texts += [("long", "Ab causes cd " * 3000), ("none", None), ("empty", "")]
    got = _relations(spark, texts, names, knowledge.VERBS)
    assert got == _pattern(texts, names, knowledge.VERBS) and len(got) > 1000


def test_relations_of_many_names_and_of_none(spark):
    names = [f"part {k}" for k in range(100_000)]
    texts = [("1", "We say Part 77 often leads to the new part 99999 here"), ("2", "part 1 affects part 1"), ("3", "part 5 affects part")]
    assert _relations(spark, texts, names, None) == [("1", "CAUSES", "Part 77", "part 99999")]
    assert _relations(spark, texts, [], None) == [] and _relations(spark, [], ["a"], None) == []


def test_containing_and_prefixed(spark):
    texts = ["".join(SEED.choices("abc.", k=SEED.randrange(30))) for _ in range(200)] + [None, "", "aaaaaaaaaa"]
    needles = ["".join(SEED.choices("abc.", k=SEED.randrange(1, 8))) for _ in range(60)] + [None, "", "aaaaaa"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    for some in (needles, [x for x in needles if x and len(x) >= affix.GRAM]):
        found = affix.containing(spark.createDataFrame([(x,) for x in some], "needle string"), t)
        assert sorted(map(tuple, found.collect())) == sorted((x, i) for x in {*some} - {None, ""} for i, y in enumerate(texts) if y is not None and x in y)
    plan = affix.containing(n, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    p = n.withColumnRenamed("needle", "prefix")
    got = sorted((r.text_id, r.prefix) for r in affix.prefixed(t, p).collect())
    want = sorted((i, x) for x in {*needles} - {None, ""} for i, y in enumerate(texts) if y is not None and y.startswith(x))
    assert got == want
    best = {r.text_id: r.prefix for r in affix.prefixed(t, p, longest=True).collect()}
    assert best == {i: max((x for j, x in want if j == i), key=len) for i, _ in want}


def test_vector_index(spark):
    centres = [[SEED.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(k, [x + SEED.gauss(0, 0.3) for x in centres[k % 12]]) for k in range(1500)] + [(2000, None)]
    rows += [(3000 + k, [1.0] * 16) for k in range(700)]  # a cell that holds a third
    df = spark.createDataFrame(rows, "chunk_id long, embedding_full array<float>")
    path = tempfile.mkdtemp(prefix="spark-")
    assert vector_index.opened(spark, path + "/index") is None
    vector_index.build(df.where("chunk_id % 2 = 0"), path + "/index", cells=12)
    index = vector_index.opened(spark, path + "/index")
    vector_index.add(index, df.where("chunk_id % 2 = 1"))
    assert index.vectors.count() == 2200 and index.centroids.count() == 12
    queries = df.where("chunk_id % 50 = 0 and embedding_full is not null").select(F.col("chunk_id").alias("query_id"), F.col("embedding_full").alias("vector"))
    exact = vector.top_k(queries, df, 5)
    every = vector_index.top_k(queries, index, 5, probes=12)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    shares = []
    for probes in (1, 3, 12):
        shares.append((vector_index.scanned_share(queries, index, probes).first()[0], vector_index.recall(vector_index.top_k(queries, index, 5, probes), exact).first()[0]))
    assert shares[0][0] < shares[1][0] < shares[2][0] == 1.0 and shares[1][1] > 0.9 and shares[2][1] == 1.0
    assert vector_index.calibrated(queries, index, 5, 0.9) <= 3
