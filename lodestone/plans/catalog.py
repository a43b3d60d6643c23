"""Registry of the queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text, vectors
from ..operators import affix, answer, bm25, cache, chunking, evaluate, fusion, knowledge, known_items, page_index, pooling, sampling, store, vector, vector_index
from ..schemas import CONCEPT_TYPES
from ..sources import elements
from . import pipeline, planner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, sf_dir, "documents"))


#: Tables that were made once, by name, input files and session: what several queries read.
_saved: dict[tuple, object] = {}


def _version(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """The tables' files with their sizes and times of change: a table written again is another one."""
    files = [f for n in names for f in table(spark, sf_dir, n).inputFiles()]
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    stats = [path(f).getFileSystem(conf).getFileStatus(path(f)) for f in sorted(files)]
    return (spark.sparkContext.applicationId, *((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in stats))


def saved(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over the documents and questions of ``sf_dir``, written by its first reader in this session."""
    key = (name, *_version(spark, sf_dir, "documents", "benchmark"))
    if key not in _saved:
        _saved[key] = store.written(make(), name)
    return _saved[key]


def saved_index(spark: SparkSession, sf_dir: str, make: Callable[[str], vector_index.Index]) -> vector_index.Index:
    """The vector index over the embeddings of ``sf_dir``, built by its first reader in this session."""
    key = ("index", *_version(spark, sf_dir, "embeddings"))
    if key not in _saved:
        _saved[key] = make(store.fresh(spark, "index"))
    return _saved[key]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, dealt by document, so that its readers have as many tasks as its writer, however few files came in."""
    return saved(spark, sf_dir, "chunks", lambda: chunking.paragraph_chunks(table(spark, sf_dir, "documents").repartition("doc_id")))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table with both vector columns, which are computed where a search reads them: a run reads each once."""
    return store.with_embeddings(chunks(spark, sf_dir))


def lexical(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of all chunks; its statistics are a saved table."""
    c = chunks(spark, sf_dir)
    return bm25.index(c, saved(spark, sf_dir, "statistics", lambda: bm25.statistics(c)))


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each question, which all later stages read."""
    return saved(spark, sf_dir, "hits", lambda: bm25.top_k(asked(spark, sf_dir), chunks(spark, sf_dir), built=lexical(spark, sf_dir)))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Questions about each nation, by which the planner and the graph are exercised.
TEMPLATES = ("What is the policy of {}", "Why did {} lead to a loss because of Overheating", "Compare {} with Q1 and Q2 in 2024", "Explain the rules of {} except 10 without Exports", "{} Brand Types and Sizes by Region")


def nation_name():
    """A nation's name as a capitalised word."""
    return F.initcap(F.lower(F.replace("n_name", F.lit("_"))))


def nation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    forms = F.array(*(F.struct(F.lit(k).alias("k"), F.concat(F.lit(t.split("{}")[0]), nation_name(), F.lit(t.split("{}")[1])).alias("query")) for k, t in enumerate(TEMPLATES)))
    return n.select("n_nationkey", F.inline(forms)).select((F.col("n_nationkey") * 10 + F.col("k")).cast("long").alias("query_id"), "query")


NATION_QUESTIONS = "nq AS (" + " UNION ALL ".join(
    f"SELECT CAST(n_nationkey * 10 + {k} AS BIGINT) AS query_id, '{t.split('{}')[0]}' || upper(left(n_name, 1)) || lower(replace(substr(n_name, 2), '_', '')) || '{t.split('{}')[1]}' AS query FROM nation" for k, t in enumerate(TEMPLATES)
) + ")"

T = r"[\p{L}\p{N}_]+"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{T}')"


def pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda p: p <> '')"


CHUNKS = f"""lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, CAST(o AS INTEGER) AS ordinal, doc_id || ':p' || o AS chunk_id, source AS source_format, trim(line) AS text,
  CASE WHEN o = 0 THEN 'title' WHEN len({pieces("trim(line)")}) <= 5 THEN 'heading' ELSE 'paragraph' END AS element_type, CAST(o // 10 + 1 AS INTEGER) AS page_number,
  CASE WHEN o = 0 THEN 1 ELSE 2 END AS depth FROM lines WHERE trim(line) <> '')"""

INDEX = f"""post AS (SELECT chunk_id, doc_id, ordinal, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, ordinal, unnest({tok("text")}) AS term FROM chunks) GROUP BY ALL),
dls AS (SELECT chunk_id, len({tok("text")}) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
mean AS (SELECT avg(raw) AS m FROM raw),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN m * 0.25 ELSE raw END AS idf FROM raw, mean)"""

BM25 = f"""{CHUNKS}, {INDEX},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tok("text")}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, doc_id, ordinal, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN dls USING (chunk_id), corpus GROUP BY ALL),
nothing AS (SELECT item_id AS query_id, chunk_id, doc_id, ordinal, 0.0 AS score FROM benchmark, (SELECT * FROM chunks ORDER BY doc_id, ordinal LIMIT 5)),
best AS (SELECT query_id, chunk_id, doc_id, ordinal, sum(score) AS score FROM (SELECT * FROM scored UNION ALL SELECT * FROM nothing) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM best QUALIFY rank <= 5)"""

PAGES = f"""{BM25},
placed AS (SELECT h.query_id, h.chunk_id, h.doc_id, h.ordinal, c.page_number, round(len(list_intersect(list_distinct({tok("b.text")}), list_distinct({tok("c.text")})))
  * CASE element_type WHEN 'title' THEN 3.0 WHEN 'heading' THEN 2.5 ELSE 1.0 END / (1 + 0.1 * greatest(depth - 1, 0)), 6) AS structural_score
  FROM hits h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY structural_score DESC, doc_id, ordinal) AS page_rank FROM placed)"""


# --- documents to chunks ---------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT document_id, ordinal, chunk_id, source_format, text, element_type, page_number, len(text) AS chars FROM chunks")
def chunk_paragraphs(spark, sf_dir):
    return fresh_chunks(spark, sf_dir).drop("section_path").withColumn("chars", F.length("text").cast("long"))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS n_chunks, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM chunks GROUP BY document_id")
def doc_assemble(spark, sf_dir):
    made = chunking.assembled(chunks(spark, sf_dir))
    return made.select("document_id", F.size("chunks").cast("long").alias("n_chunks"), F.array_join("chunks.text", "\n").alias("text"))


@query()
def merge_split_chunks(spark, sf_dir):
    return chunking.resize_chunks(chunks(spark, sf_dir))


@query(
    f"""WITH {CHUNKS}, counted AS (SELECT document_id, ordinal, text, element_type, len({pieces("text")}) AS n FROM chunks),
    p AS (SELECT document_id, ordinal, text, CAST(CASE WHEN element_type <> 'paragraph' THEN CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 ELSE 3 END END AS INTEGER) AS level FROM counted),
    w AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN ordinal END) OVER (PARTITION BY document_id ORDER BY ordinal) AS h{k}" for k in (1, 2, 3))} FROM p),
    open AS (SELECT document_id, ordinal, level, text, h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END AS h2, CASE WHEN h3 > greatest(coalesce(h1, -1), coalesce(h2, -1)) THEN h3 END AS h3 FROM w)
    SELECT o.document_id, o.ordinal, o.level, o.text, concat_ws(' > ', a.text, b.text, c.text) AS section_path FROM open o
    {" ".join(f"LEFT JOIN p {t} ON {t}.document_id = o.document_id AND {t}.ordinal = o.h{k}" for k, t in ((1, "a"), (2, "b"), (3, "c")))}"""
)
def section_path_fold(spark, sf_dir):
    """Headings nest by their words: one word is level 1, two or three level 2, more level 3."""
    c = chunks(spark, sf_dir)
    n = text.word_count(F.col("text"))
    level = F.when(F.col("element_type") != "paragraph", F.when(n <= 1, 1).when(n <= 3, 2).otherwise(3))
    return chunking.section_paths(c.select("document_id", "ordinal", level.alias("level"), "text")).withColumn("section_path", F.array_join("section_path", " > "))


@query(
    f"""WITH {CHUNKS} SELECT chunk_id, len(s) AS n_sentences, s[1] AS first_sentence FROM
    (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM chunks)"""
)
def split_sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", F.size(s).cast("long").alias("n_sentences"), F.element_at(s, 1).alias("first_sentence"))


@query(
    """SELECT conv_id || ':page:' || CAST(turn // 10 + 1 AS INTEGER) || ':element:0' AS chunk_id, CAST(conv_id AS VARCHAR) || '-' || turn AS document_id, trim(text) AS text,
    coalesce(nullif(role, ''), 'paragraph') AS element_type, CAST(turn // 10 + 1 AS INTEGER) AS page_number, CAST(turn AS DOUBLE) AS x1, 'Page: ' || CAST(turn // 10 + 1 AS INTEGER) AS location_reference
    FROM conversations WHERE trim(text) <> ''"""
)
def elements_normalize(spark, sf_dir):
    """Turns of conversations as a parser would give them: each field under one of its names, by turn."""
    c = table(spark, sf_dir, "conversations")
    fields = (("content", "source", "text"), ("type", "element_type", "type"), ("page number", "page_number", "page"), ("bounding box", "bounding_box", "bbox"))
    x = F.col("turn").cast("double")
    values = (F.to_json(F.struct(F.col("text").alias("v"))), F.to_json(F.struct(F.col("role").alias("v"))), F.to_json(F.struct((F.floor(F.col("turn") / 10) + 1).alias("v"))), F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(x, x, x, x).alias("v")))).otherwise(F.to_json(F.struct(F.struct(x.alias("x1")).alias("v")))))
    # {"v":...} without its braces and with the field's own name
    named = [F.concat(F.element_at(F.array(*(F.lit(f'"{n}":') for n in names)), (F.col("turn") % 3 + 1).cast("int")), F.regexp_replace(v, r'^\{"v":(.*)\}$', "$1")) for names, v in zip(fields, values, strict=True)]
    payload = F.concat(F.lit('{"kids":[{'), F.concat_ws(",", *named), F.lit("}]}"))
    made = elements.normalized(c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("document_id"), payload.alias("payload")))
    return made.select(F.regexp_replace("chunk_id", "-[0-9]+:page", ":page").alias("chunk_id"), "document_id", "text", "element_type", "page_number", F.col("bounding_box.x1").alias("x1"), "location_reference")


@query("SELECT doc_id, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS failed FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def failed_docs_anti(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    outputs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return elements.failed_documents(inputs, outputs).select(F.col("document_id").alias("doc_id"), F.lit(True).alias("failed"))


#: The links of a page as markdown images named after their targets.
IMAGES = "regexp_replace(html, '<a href=\"([^\"]*)\">', '![\\1](\\1.png)', 'g')"


@query(f"""SELECT page_id, regexp_replace({IMAGES}, '!\\[([^\\]]*)\\]\\((?:[^)\\s]*/)?([^)/\\s]+\\.(?:png|jpe?g))\\)', '![\\1](store://images/\\2)', 'g') AS markdown FROM pages""")
def image_link_rewrite(spark, sf_dir):
    """All pages, whose links are images as a parser's markdown has them."""
    raw = F.regexp_replace("html", '<a href="([^"]*)">', "![$1]($1.png)")
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_links(raw, "store://images/").alias("markdown"))


# --- lexical retrieval ------------------------------------------------------------------------------


@query(f"WITH {CHUNKS}, {INDEX} SELECT chunk_id, term, tf FROM post")
def tokenize_terms(spark, sf_dir):
    return bm25.postings(chunks(spark, sf_dir)).select("chunk_id", "term", "tf")


@query(
    f"""WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    own AS (SELECT list_distinct({tok("trim(line)")}) AS terms FROM lines WHERE trim(line) <> ''),
    n AS (SELECT count(*) AS n FROM own),
    dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM own) GROUP BY term),
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, n),
    mean AS (SELECT avg(raw) AS m FROM raw)
    SELECT term, df, round(CASE WHEN raw < 0 THEN m * 0.25 ELSE raw END, 6) AS idf FROM raw, mean"""
)
def term_document_frequency(spark, sf_dir):
    return lexical(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CHUNKS}, {INDEX} SELECT n, round(avgdl, 6) AS avgdl, round(m, 6) AS mean_idf FROM corpus, mean")
def corpus_stats(spark, sf_dir):
    return lexical(spark, sf_dir).corpus.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hits")
def bm25_topk(spark, sf_dir):
    return lexical_hits(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {BM25} SELECT query_id, least(1.0, max(score) / 10) AS confidence FROM hits GROUP BY query_id")
def bm25_confidence(spark, sf_dir):
    return bm25.stage_confidence(lexical_hits(spark, sf_dir))


def structured(spark, sf_dir):
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir)
    hits = lexical_hits(spark, sf_dir)
    return page_index.rank(q, hits.select("query_id", "chunk_id").join(c, "chunk_id"))


@query(f"WITH {PAGES} SELECT query_id, chunk_id, structural_score, CAST(page_rank AS INTEGER) AS page_rank FROM ranked")
def page_index_topk(spark, sf_dir):
    return structured(spark, sf_dir).select("query_id", "chunk_id", "structural_score", "page_rank")


@query(f"WITH {PAGES} SELECT query_id, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages, least(1.0, round(avg(structural_score) / 10, 6)) AS confidence FROM ranked GROUP BY query_id")
def candidate_pages(spark, sf_dir):
    return page_index.candidate_pages(structured(spark, sf_dir)).select("query_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "confidence")


# --- vectors ----------------------------------------------------------------------------------------

UNIT = "unit AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
KNN = f"""{UNIT}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, a.label AS want, b.label AS label, round(list_dot_product(a.v, b.v), 6) AS score FROM unit a JOIN unit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5)"""


def neighbours(spark, sf_dir, k=5):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.top_k(q, e, k, "embedding", "vec_id", exclude_self=True)


@query(f"WITH {KNN} SELECT query_id, vec_id, score, rank FROM near")
def vector_topk(spark, sf_dir):
    return neighbours(spark, sf_dir)


@query(
    """WITH t AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings QUALIFY k <= 512),
    p AS (SELECT label, i, avg(embedding[i]) AS x FROM t, range(1, 65) r(i) WHERE vec_id % 3 <> 0 GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS size FROM p GROUP BY label)
    SELECT label, round(sum(x / size), 6) AS total, round(max(CASE WHEN i = 1 THEN x / size END), 6) AS first, count(*) AS dim FROM p JOIN n USING (label) GROUP BY label"""
)
def pooled_labels(spark, sf_dir):
    """A label's first 512 vectors as the tokens of a text, pooled; those whose id is divisible by 3 are masked."""
    first = Window.partitionBy("label").orderBy("vec_id")
    t = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(first)).where(F.col("k") <= pooling.TOKENS)
    rows = t.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "embedding"))).alias("t"))
    pooled = pooling.masked_mean(rows.select("label", F.col("t.embedding").alias("vectors"), F.transform("t", lambda x: (x["vec_id"] % 3 != 0).cast("int")).alias("mask")))
    total = F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x)
    return pooled.select("label", F.round(total, 6).alias("total"), F.round(F.col("pooled")[0], 6).alias("first"), F.size("pooled").cast("long").alias("dim"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def points_upsert(spark, sf_dir):
    """Points of all documents written twice, the second time over the first: each is there once."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.length("text").cast("int").alias("page_number"), "text")
    path = store.fresh(spark, "points")
    c = store.with_embeddings(d).withColumn("embedding_full", F.lit(None).cast("array<float>"))
    for _ in range(2):
        store.save_points(c, path)
    return store.points(spark, path, 384).select("chunk_id", F.col("page_number").cast("long").alias("chars"))


def vector_questions(spark, sf_dir):
    """Every vector whose id is divisible by 100, asked against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_cells(spark, sf_dir):
    """The index of all embeddings; as many cells as the root of their number."""
    e = table(spark, sf_dir, "embeddings")
    return saved_index(spark, sf_dir, lambda path: vector_index.build(e, path, column="embedding"))


@query(f"WITH {KNN} SELECT query_id, vec_id, score, rank FROM near")
def vector_index_exact(spark, sf_dir):
    """The index in its exact mode: every cell is probed."""
    index = vector_cells(spark, sf_dir)
    return vector_index.top_k(vector_questions(spark, sf_dir), index, 5, index.centroids.count(), "embedding", "vec_id", exclude_self=True)


@query()
def vector_index_topk(spark, sf_dir):
    """The index with as many probes as these questions need for a recall of 0.9."""
    index, asked_ = vector_cells(spark, sf_dir), vector_questions(spark, sf_dir)
    probes = vector_index.calibrated(asked_, index, 5, 0.9, "embedding", "vec_id", exclude_self=True)
    return vector_index.top_k(asked_, index, 5, probes, "embedding", "vec_id", exclude_self=True)


@query()
def vector_index_recall(spark, sf_dir):
    """Recall and share of vectors compared, for 1, 2, 4, ... probes."""
    index, asked_ = vector_cells(spark, sf_dir), vector_questions(spark, sf_dir)
    curve = vector_index.recall_curve(asked_, index, 5, "embedding", "vec_id", exclude_self=True)
    return curve.select("probes", F.round("recall", 6).alias("recall"), F.round("share", 6).alias("share"))


@query(f"WITH {UNIT}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(a.v, b.v), 6) AS score FROM unit a JOIN unit b ON a.vec_id % 100 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5")
def vector_topk_scoped(spark, sf_dir):
    """Only vectors of the query's own label are candidates."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0")
    return vector.top_k(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), e, 5, "embedding", "vec_id", exclude_self=True, scope=("label",))


@query(f"WITH {KNN} SELECT query_id, round(least(1.0, greatest(0.0, avg(score))), 6) AS confidence FROM near GROUP BY query_id")
def vector_avg_confidence(spark, sf_dir):
    return vector.stage_confidence(neighbours(spark, sf_dir))


@query("SELECT item_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, len(v) AS dim FROM (SELECT item_id, list_transform(range(384), lambda i: CAST('0x' || substr(sha256(text), CAST(i % 32 * 2 + 1 AS INTEGER), 2) AS INTEGER) / 127.5 - 1) AS v FROM benchmark)")
def hash_embedding(spark, sf_dir):
    v = vectors.hash_embedding(F.col("text"), 384, normalize=False)
    return table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"), F.size("v").cast("long").alias("dim"))


# --- fusion and reranking ---------------------------------------------------------------------------

FUSED = f"""{PAGES}, both_lists AS (SELECT query_id, chunk_id, page_rank AS rank, 0 AS l FROM ranked UNION ALL SELECT query_id, chunk_id, rank, 1 AS l FROM hits),
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (59 + rank)), 9) AS rrf, min(l * 1000 + rank) AS first FROM both_lists GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS INTEGER) AS fused_rank FROM fused QUALIFY fused_rank <= 4)"""


def fused(spark, sf_dir):
    """BM25 hits fused with their structural order."""
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir)
    hits = lexical_hits(spark, sf_dir)
    order = page_index.rank(q, hits.select("query_id", "chunk_id").join(c, "chunk_id"))
    top = fusion.rrf([order.select("query_id", "chunk_id", F.col("page_rank").alias("rank")), hits])
    return top.join(q, "query_id").join(c, "chunk_id")


@query(f"WITH {FUSED} SELECT query_id, chunk_id, rrf, fused_rank FROM top")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "chunk_id", "rrf", "fused_rank")


JACCARD = f"""{FUSED}, words AS (SELECT t.query_id, t.chunk_id, t.fused_rank, c.document_id, c.source_format, c.text, c.element_type, c.page_number, b.text AS query, list_distinct({pieces("lower(b.text)")}) AS x, list_distinct({pieces("lower(c.text)")}) AS y
  FROM top t JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = t.query_id),
reranked AS (SELECT *, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS rerank_score FROM words),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS rerank_rank FROM reranked)"""


@query(f"WITH {JACCARD} SELECT query_id, chunk_id, rerank_score, rerank_rank FROM ordered")
def jaccard_rerank(spark, sf_dir):
    return fusion.rerank(fused(spark, sf_dir)).select("query_id", "chunk_id", "rerank_score", "rerank_rank")


# --- planning ---------------------------------------------------------------------------------------


def route_sql(rules: planner.Rules) -> str:
    quote = lambda xs: ", ".join("'" + x + "'" for x in xs)
    flag = lambda name: f"len(list_filter([{quote(getattr(rules, name))}], lambda p: contains(lower(query), p))) > 0"
    stop = f"AND NOT list_contains([{quote(rules.stop_words)}], x)" if rules.stop_words else ""
    negation = "" if rules.fast_with_negation else "AND NOT neg"
    return f"""WITH {NATION_QUESTIONS}, alls AS (SELECT query_id, query FROM nq UNION ALL SELECT item_id + 1000000, text FROM benchmark),
    f AS (SELECT *, len(list_distinct(list_filter(regexp_extract_all(query, '{T}'), lambda x: regexp_full_match(x, '[A-Z][a-z0-9]+|[0-9]+') {stop}))) AS n,
      {flag("temporal")} AS tmp, {flag("comparison")} AS cmp, {flag("negation")} AS neg, {flag("relationship")} AS rel FROM alls),
    s AS (SELECT *, round(least(1.0, least(n, 3) * {rules.entity_weight} + CASE WHEN n > {rules.multi_above} THEN 0.2 ELSE 0 END + CASE WHEN tmp THEN 0.15 ELSE 0 END + CASE WHEN cmp THEN 0.15 ELSE 0 END
      + CASE WHEN neg THEN 0.1 ELSE 0 END + CASE WHEN rel THEN 0.15 ELSE 0 END), 6) AS complexity FROM f)
    SELECT query_id, n AS n_entities, CAST(complexity AS DOUBLE) AS complexity, CASE WHEN complexity < {rules.fast_below} AND n <= {rules.most_entities} AND NOT rel AND NOT tmp AND NOT cmp {negation} THEN 'fast' WHEN rel THEN 'graph' WHEN tmp OR cmp THEN 'analytical' ELSE 'full' END AS route FROM s"""


def all_questions(spark, sf_dir):
    return nation_questions(spark, sf_dir).unionByName(asked(spark, sf_dir).withColumn("query_id", F.col("query_id") + 1000000))


def routed(spark, sf_dir, rules):
    return planner.route(all_questions(spark, sf_dir), rules).select("query_id", F.size("entities").cast("long").alias("n_entities"), "complexity", "route")


@query(route_sql(planner.FUSED))
def planner_route_a(spark, sf_dir):
    return routed(spark, sf_dir, planner.FUSED)


@query(route_sql(planner.SCOPED))
def planner_route_b(spark, sf_dir):
    return routed(spark, sf_dir, planner.SCOPED)


QUERY_ENTITIES = f"""list_distinct(list_concat(regexp_extract_all(query, '"([^"]*)"', 1), list_transform(list_filter({pieces("query")}[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}')), lambda x: trim(x, '?,.!'))))"""
ENTITIES = f"ents AS (SELECT query_id, query, CASE WHEN len({QUERY_ENTITIES}) > 0 THEN {QUERY_ENTITIES} ELSE list_distinct(list_transform(list_filter({pieces('query')}, lambda x: len(x) > 5), lambda x: trim(x, '?,.!'))) END AS e FROM qs)"


@query(f"WITH qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {ENTITIES} SELECT query_id, len(e) AS n_entities, array_to_string(list_sort(e), '|') AS entities FROM ents")
def query_entities(spark, sf_dir):
    e = text.query_entities(F.col("query"))
    return asked(spark, sf_dir).select("query_id", F.size(e).cast("long").alias("n_entities"), F.array_join(F.array_sort(e), "|").alias("entities"))


# --- answers ----------------------------------------------------------------------------------------

SNIPPETS = f"""{JACCARD}, snippets AS (SELECT query_id, query, rerank_rank, text, rerank_score, '[' || rerank_rank || '] ' AS name, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE p[:1] END, ' ... ') AS snippet FROM
  (SELECT *, list_filter(p, lambda z: len(list_filter({pieces("query")}, lambda w: len(w) > 3 AND contains(lower(z), lower(w)))) > 0) AS h FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '') AS p FROM ordered)))"""
FOLD = f"""WITH RECURSIVE {SNIPPETS},
fold AS (SELECT item_id AS query_id, 0 AS i, 0 AS used, '' AS context FROM benchmark
  UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN f.used >= 4000 THEN f.used ELSE f.used + len(s.name) + len(CASE WHEN len(s.snippet) > 4000 - f.used THEN regexp_replace(left(s.snippet, 4000 - f.used), ' [^ ]*$', '') ELSE s.snippet END) + 2 END,
    CASE WHEN f.used >= 4000 THEN f.context ELSE f.context || CASE WHEN f.i > 0 THEN chr(10) || chr(10) ELSE '' END || s.name || CASE WHEN len(s.snippet) > 4000 - f.used THEN regexp_replace(left(s.snippet, 4000 - f.used), ' [^ ]*$', '') ELSE s.snippet END END
  FROM fold f JOIN snippets s ON s.query_id = f.query_id AND s.rerank_rank = f.i + 1),
contexts AS (SELECT query_id, max_by(context, i) AS context FROM fold GROUP BY query_id)"""


def reranked(spark, sf_dir):
    """The reranked chunks of each question, six at most, which the answer's stages read."""
    return saved(spark, sf_dir, "reranked", lambda: fusion.rerank(fused(spark, sf_dir)))


@query(f"{FOLD} SELECT query_id, context FROM contexts")
def compress_context(spark, sf_dir):
    return answer.compress(reranked(spark, sf_dir))


COVERED = f"{FOLD}, qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {ENTITIES}, cov AS (SELECT query_id, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_filter(e, lambda x: contains(lower(context), lower(x)))) / len(e) END AS coverage FROM ents JOIN contexts USING (query_id))"


@query(f"{COVERED} SELECT query_id, round(coverage, 6) AS coverage, coverage >= 1 AS passes FROM cov")
def fidelity_coverage(spark, sf_dir):
    both = answer.compress(reranked(spark, sf_dir)).join(asked(spark, sf_dir), "query_id")
    share = answer.coverage(F.col("query"), F.col("context"))
    return both.select("query_id", F.round(share, 6).alias("coverage"), (share >= 1).alias("passes"))


@query(f"{COVERED} SELECT query_id, round(least(1.0, greatest(0.0, 0.6 * m + 0.4 * coverage)), 4) AS confidence FROM cov JOIN (SELECT query_id, avg(rerank_score) AS m FROM ordered GROUP BY query_id) USING (query_id)")
def full_answer_confidence(spark, sf_dir):
    r = reranked(spark, sf_dir)
    both = answer.compress(r).join(r.groupBy("query_id").agg(F.first("query").alias("query"), F.avg("rerank_score").alias("mean")), "query_id")
    return both.select("query_id", F.round(scores.confidence(F.col("mean"), answer.coverage(F.col("query"), F.col("context"))), 4).alias("confidence"))


FAST = f"""WITH {JACCARD}, own AS (SELECT query_id, any_value(query) AS query, left(string_agg(text, ' ' ORDER BY rerank_rank), 500) AS answer, avg(rerank_score) AS m FROM ordered WHERE rerank_rank <= 3 GROUP BY query_id),
sure AS (SELECT *, round(least(1.0, greatest(0.0, 0.6 * m + 0.4 * len(list_intersect(list_distinct({pieces("lower(query)")}), list_distinct({pieces("lower(answer)")}))) / greatest(1, len(list_distinct({pieces("lower(query)")}))))), 4) AS confidence FROM own)"""


@query(f"{FAST} SELECT query_id, answer, confidence FROM sure")
def fast_answer(spark, sf_dir):
    return answer.fast_answer(reranked(spark, sf_dir), "rerank_score", "rerank_rank").select("query_id", "answer", "confidence")


@query(f"{FAST} SELECT query_id, CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM sure")
def confidence_band(spark, sf_dir):
    return answer.fast_answer(reranked(spark, sf_dir), "rerank_score", "rerank_rank").select("query_id", "band")


LOCATED = "CASE WHEN source_format = 'src0' THEN NULL WHEN element_type = 'heading' THEN 'Heading: ' || left(text, 30) WHEN page_number > 0 THEN 'Page: ' || page_number ELSE 'Section: ' || element_type END"


@query(f"WITH {JACCARD} SELECT query_id, chunk_id, document_id, left(text, 200) AS text_snippet, rerank_rank AS place, {LOCATED} AS location_reference FROM ordered")
def citations(spark, sf_dir):
    r = reranked(spark, sf_dir)
    fmt = F.when(F.col("source_format") == "src0", "pdf").otherwise(F.col("source_format"))
    c = answer.citation(fmt, F.lit(None).cast(elements.BOX), F.lit(None).cast("string"), F.col("element_type"), F.col("page_number"), F.col("text"))
    return r.select("query_id", c.alias("c"), F.col("rerank_rank").alias("place")).select("query_id", "c.chunk_id", "c.document_id", "c.text_snippet", "place", "c.location_reference")


@query(f"WITH {CHUNKS} SELECT chunk_id, {LOCATED} AS location_reference, CASE WHEN source_format = 'src0' THEN 1.0 END AS x2, CASE WHEN source_format = 'src0' THEN page_number ELSE 0 END AS box_page FROM chunks")
def location_fallback(spark, sf_dir):
    """Source src0 stands for PDF files, whose chunks have no boxes here."""
    fmt = F.when(F.col("source_format") == "src0", "pdf").otherwise(F.col("source_format"))
    place = answer.location(fmt, F.lit(None).cast(elements.BOX), F.lit(None).cast("string"), F.col("element_type"), F.col("page_number"), F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", place.alias("p")).select("chunk_id", "p.location_reference", F.col("p.bounding_box.x2").alias("x2"), F.coalesce("p.bounding_box.page_number", F.lit(0)).alias("box_page"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'NOT_FOUND' ELSE event_type || ' ' || event_id END AS answer, CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 4 = 2 THEN 1 ELSE 2 END AS n_citations FROM events")
def parse_llm_json(spark, sf_dir):
    """Outputs as models give them: plain, fenced, with an odd citation, and no JSON at all."""
    said = F.concat(F.lit('{"answer": "'), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit('", "confidence": 0.99, "citations": '))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(said, F.lit('[1, "2"]}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), said, F.lit('["[2]", 3]}\n```'))).when(F.col("event_id") % 4 == 2, F.concat(said, F.lit('["x", 1]}'))).otherwise("NOT_FOUND")
    parsed = answer.parse_output(raw)
    return table(spark, sf_dir, "events").select("event_id", parsed["answer"].alias("answer"), F.size(parsed["citations"]).alias("n_citations"))


def _pipeline_rows(spark, sf_dir, config):
    c = chunks(spark, sf_dir)
    q = asked(spark, sf_dir).unionByName(nation_questions(spark, sf_dir).withColumn("query_id", F.col("query_id") + 1000000))
    graph = pipeline.Knowledge(concepts(spark, sf_dir), part_properties(spark, sf_dir), relations(spark, sf_dir))
    out = pipeline.answers(q, c, config, graph, built=lexical(spark, sf_dir), counted=True).withColumn("citations", F.array_join("citations", ","))
    return out.withColumns({x: F.coalesce(F.col(x), F.lit(0)).cast("int") for x in ("properties", "graph")})


@query()
def pipeline_fused(spark, sf_dir):
    return _pipeline_rows(spark, sf_dir, pipeline.FUSED)


@query()
def pipeline_scoped(spark, sf_dir):
    return _pipeline_rows(spark, sf_dir, pipeline.SCOPED)


@query()
def cached_flow(spark, sf_dir):
    """All benchmark items asked of an empty cache, and again, otherwise written, of the entries that came of it."""
    q = asked(spark, sf_dir).withColumn("document_ids", F.array().cast("array<string>"))
    c = embedded(spark, sf_dir)
    out = None
    entries = spark.createDataFrame([], store.TABLES["cache"])
    for turn, said in ((1, F.col("query")), (2, F.concat(F.lit("  "), F.upper("query")))):
        got, new = pipeline.cached_answers(q.withColumn("query", said), c, entries, now(), built=lexical(spark, sf_dir))
        rows = got.select(F.lit(turn).alias("turn"), "query_id", "answer", "confidence", "source")
        out = rows if out is None else out.unionByName(rows)
        entries = store.written(store.conformed(new, store.TABLES["cache"]), "entries")
    return out


@query()
def stage_metrics(spark, sf_dir):
    """What each stage gave when the benchmark items were answered: rows and mean confidence, observed on the way."""
    stages = pipeline.Stages()
    pipeline.answers(asked(spark, sf_dir), chunks(spark, sf_dir), pipeline.SCOPED, stages=stages, built=lexical(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    return stages.table(spark)


# --- knowledge --------------------------------------------------------------------------------------

CONCEPTS = """concepts AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'LOCATION' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, upper(left(n_name, 1)) || lower(replace(substr(n_name, 2), '_', '')), 'LOCATION' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'ORGANIZATION' FROM supplier)"""
RELATIONS = """relations AS (SELECT 'r' || n_regionkey AS f, 'n' || n_nationkey AS t, 'CONTAINS' AS relation_type, 0.3 + n_nationkey % 7 / 10.0 AS w FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'AFFECTS', c_custkey % 10 / 10.0 FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'DEPENDS_ON', s_suppkey % 10 / 10.0 FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'r' || s_suppkey % 5, 'CAUSES', 0.5 FROM supplier)"""


def concepts(spark, sf_dir):
    r, n, c, s = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier"))
    row = lambda p, key, name, kind: [F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), name.alias("name"), kind.alias("type")]
    return (
        r.select(*row("r", "r_regionkey", F.col("r_name"), F.lit("LOCATION")))
        .unionByName(n.select(*row("n", "n_nationkey", nation_name(), F.lit("LOCATION"))))
        .unionByName(c.select(*row("c", "c_custkey", F.col("c_name"), F.col("c_mktsegment"))))
        .unionByName(s.select(*row("s", "s_suppkey", F.col("s_name"), F.lit("ORGANIZATION"))))
    )


def relations(spark, sf_dir):
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    end = lambda p, key: F.concat(F.lit(p), F.col(key).cast("string"))
    row = lambda f, t, kind, w: [f.alias("from_concept_id"), t.alias("to_concept_id"), F.lit(kind).alias("relation_type"), w.alias("relation_weight")]
    return (
        n.select(*row(end("r", "n_regionkey"), end("n", "n_nationkey"), "CONTAINS", F.lit(0.3) + F.col("n_nationkey") % 7 / 10.0))
        .unionByName(c.select(*row(end("n", "c_nationkey"), end("c", "c_custkey"), "AFFECTS", F.col("c_custkey") % 10 / 10.0)))
        .unionByName(s.select(*row(end("n", "s_nationkey"), end("s", "s_suppkey"), "DEPENDS_ON", F.col("s_suppkey") % 10 / 10.0)))
        .unionByName(s.select(*row(end("s", "s_suppkey"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")), "CAUSES", F.lit(0.5))))
    )


def walk_sql(hops: int, rows: int | None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, w DESC, concept_id, relation_type) <= {rows}" if rows else ""
    return f"""WITH RECURSIVE {RELATIONS}, walk AS (SELECT DISTINCT r_regionkey AS query_id, t AS concept_id, relation_type, w, 1 AS hop FROM region JOIN relations ON f = 'r' || r_regionkey WHERE w >= 0.3
      UNION SELECT k.query_id, r.t, r.relation_type, r.w, k.hop + 1 FROM walk k JOIN relations r ON r.f = k.concept_id WHERE k.hop < {hops} AND r.w >= 0.3)
    SELECT query_id, concept_id, relation_type, round(w, 6) AS relation_weight, hop FROM walk {cut}"""


def walked(spark, sf_dir, hops, rows):
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("concept_id"))
    out = knowledge.walk(starts, relations(spark, sf_dir), hops, rows)
    return out.withColumn("relation_weight", F.round("relation_weight", 6))


@query(walk_sql(2, None))
def graph_walk_2hop(spark, sf_dir):
    return walked(spark, sf_dir, 2, None)


@query(walk_sql(3, None))
def graph_walk_3hop(spark, sf_dir):
    return walked(spark, sf_dir, 3, None)


@query(walk_sql(2, 40))
def graph_walk_capped(spark, sf_dir):
    """The walk as a query answers it: at most 40 rows, which is what the operator promises."""
    return walked(spark, sf_dir, 2, 40)


@query(f"WITH {CONCEPTS} SELECT type, count(*) AS n, list_contains([{', '.join(repr(x) for x in CONCEPT_TYPES)}], type) AS known FROM concepts GROUP BY type")
def concept_type_audit(spark, sf_dir):
    return knowledge.type_audit(concepts(spark, sf_dir))


PROPERTIES = "properties AS (SELECT 'n' || p_partkey % 25 AS concept_id, unnest(['brand', 'type', 'size']) AS property_name, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS property_value, 'p' || p_partkey AS source_chunk_id FROM part)"


@query(f"""WITH {NATION_QUESTIONS}, {CONCEPTS}, {PROPERTIES}, named AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(query, '{T}'), lambda x: regexp_full_match(x, '[A-Z][a-z0-9]+|[0-9]+') AND NOT list_contains([{', '.join(repr(x) for x in text.STOP_WORDS)}], x)))) AS name FROM nq)
    SELECT query_id, name AS concept, property_name, property_value, source_chunk_id, CAST(1.0 AS DOUBLE) AS confidence FROM named JOIN concepts USING (name) JOIN properties ON concept_id = id""")
def property_lookup(spark, sf_dir):
    return knowledge.lookup(nation_questions(spark, sf_dir), concepts(spark, sf_dir), part_properties(spark, sf_dir))


def part_properties(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("concept_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_chunk_id"), F.expr("stack(3, 'brand', p_brand, 'type', p_type, 'size', cast(p_size as string)) as (property_name, property_value)"))
    return part.withColumn("confidence", F.lit(1.0))


EXTRACTED = f"""WITH {CHUNKS} SELECT * FROM (SELECT chunk_id AS source_chunk_id, 'Date' AS property_name, unnest(regexp_extract_all(text, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})\\b', 1)) AS property_value FROM chunks
  UNION ALL SELECT chunk_id, 'Percentage', unnest(regexp_extract_all(text, '\\b([0-9]+(?:\\.[0-9]+)?%)', 1)) FROM chunks
  UNION ALL SELECT chunk_id, 'Identifier', unnest(list_filter(regexp_extract_all(text, '{T}'), lambda x: regexp_full_match(x, '[A-Z0-9]{{5,}}'))) FROM chunks)"""


@query(EXTRACTED)
def extract_properties(spark, sf_dir):
    return knowledge.extract_properties(chunks(spark, sf_dir)).select("source_chunk_id", "property_name", "property_value")


@query("SELECT property_name, count(*) AS n, count(DISTINCT property_value) AS distinct_values FROM (" + EXTRACTED + ") GROUP BY property_name")
def extract_property_counts(spark, sf_dir):
    found = knowledge.extract_properties(chunks(spark, sf_dir))
    return found.groupBy("property_name").agg(F.count("*").alias("n"), F.countDistinct("property_value").alias("distinct_values"))


#: Fixed values of the query: verbs that the driver's texts have.
VERBS = {"BY": "by", "FROM": "with|from", "AT": "at"}
RELATION = r"\s+(?:\w+\s+){{0,3}}(?:{})\s+(?:\w+\s+){{0,3}}"


@query(
    f"WITH {CHUNKS}, words AS (SELECT DISTINCT unnest({tok('text')}) AS name FROM benchmark), names AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS p FROM words WHERE regexp_full_match(name, '[a-z]{{5,}}')), "
    + "found AS ("
    + " UNION ALL ".join(
        f"SELECT chunk_id, '{kind}' AS relation_type, regexp_extract(m, '(?i)(' || p || '){RELATION.format(verbs)}(' || p || ')', 1) AS from_concept, regexp_extract(m, '(?i)(' || p || '){RELATION.format(verbs)}(' || p || ')', 2) AS to_concept FROM (SELECT chunk_id, p, unnest(regexp_extract_all(text, '(?i)(?:' || p || '){RELATION.format(verbs)}(?:' || p || ')')) AS m FROM chunks, names WHERE regexp_matches(text, '(?i)\\s(?:{verbs})\\s'))"
        for kind, verbs in VERBS.items()
    )
    + ") SELECT chunk_id AS source_chunk_id, relation_type, from_concept, to_concept, CAST(0.6 AS DOUBLE) AS relation_weight FROM found WHERE lower(from_concept) <> lower(to_concept)"
)
def extract_relations(spark, sf_dir):
    """Relations in all chunks between the words of five letters or more of all benchmark items."""
    word = asked(spark, sf_dir).select(F.explode(text.tokens(F.col("query"))).alias("name")).where(F.col("name").rlike("^[a-z]{5,}$"))
    return knowledge.extract_relations(chunks(spark, sf_dir), word, VERBS).select("source_chunk_id", "relation_type", "from_concept", "to_concept", "relation_weight")


@query()
def entity_clusters(spark, sf_dir):
    """Names of parts' types, clustered by their letters."""
    letters = F.array(*(F.regexp_count(F.lower("name"), F.lit(c)).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"))
    return knowledge.cluster_names(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().withColumn("vector", letters))


@query(
    """WITH names AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), needles AS (SELECT DISTINCT regexp_extract(host, '^[^.]*') AS needle FROM names)
    SELECT needle, page_id FROM needles JOIN pages ON length(needle) > 0 AND contains(url, needle)"""
)
def substring_join(spark, sf_dir):
    """The pages whose url holds a host's first label anywhere."""
    p = table(spark, sf_dir, "pages")
    first = F.regexp_extract("url", r"^[a-z]+://([^/?#.]*)", 1)
    return affix.containing(p.select(first.alias("needle")), p, text_col="url", id_col="page_id").withColumnRenamed("id", "page_id")


@query(
    """WITH stems AS (SELECT DISTINCT left(text, 12) AS prefix FROM benchmark WHERE length(text) >= 12 UNION SELECT DISTINCT left(text, 5) FROM benchmark WHERE length(text) >= 5)
    SELECT doc_id, prefix FROM documents JOIN stems ON starts_with(text, prefix)"""
)
def prefix_join(spark, sf_dir):
    """The documents that begin as a benchmark item does, for 5 and for 12 characters."""
    b = asked(spark, sf_dir)
    stems = [b.where(F.length("query") >= n).select(F.left("query", F.lit(n)).alias("prefix")) for n in (5, 12)]
    return affix.prefixed(table(spark, sf_dir, "documents").select("doc_id", "text"), stems[0].union(stems[1])).select("doc_id", "prefix")


# --- cache ------------------------------------------------------------------------------------------

NOW = "TIMESTAMP '2024-01-16 00:00:00'"


def now():
    return F.lit("2024-01-16 00:00:00").cast("timestamp")


def cached(spark, sf_dir):
    """Events as cache entries: the user's question about an event type, scoped by user for odd ones."""
    e = table(spark, sf_dir, "events")
    scope = F.when(F.col("user_id") % 2 == 1, F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        scores.cache_key(F.col("event_type"), scope).alias("cache_key"), F.array(F.col("value"), F.lit(1.0)).alias("query_embedding"), scores.scope_hash(scope).alias("doc_scope_hash"),
        F.lit("offline").alias("provider"), scope.alias("document_ids"), F.col("event_id").cast("string").alias("payload"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"),
    )


def cache_questions(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    scope = F.when(F.col("user_id") % 2 == 1, F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return n.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("query_id"), F.concat(F.lit("  "), F.upper("event_type")).alias("query"), scope.alias("document_ids"), F.array(F.col("value"), F.lit(1.0)).alias("query_vector"), F.lit("offline").alias("provider"))


KEYED = "'query:' || sha256(event_type || CASE WHEN user_id % 2 = 1 THEN sha256(CAST(user_id AS VARCHAR)) ELSE '' END)"
LIVE = f"live AS (SELECT {KEYED} AS cache_key, CASE WHEN user_id % 2 = 1 THEN sha256(CAST(user_id AS VARCHAR)) ELSE '' END AS scope, CAST(event_id AS VARCHAR) AS payload, ts, value FROM events WHERE ts + INTERVAL 10 DAY > {NOW})"
CACHE_Q = f"cq AS (SELECT user_id || '/' || event_type AS query_id, {KEYED} AS cache_key, CASE WHEN user_id % 2 = 1 THEN sha256(CAST(user_id AS VARCHAR)) ELSE '' END AS scope, max(value) AS value FROM events GROUP BY user_id, event_type)"


@query(f"SELECT event_id, {KEYED} AS cache_key FROM events")
def cache_key(spark, sf_dir):
    scope = F.when(F.col("user_id") % 2 == 1, F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", scores.cache_key(F.concat(F.lit(" "), F.upper("event_type")), scope).alias("cache_key"))


@query(f"WITH {LIVE}, {CACHE_Q} SELECT query_id, max_by(payload, (ts, payload)) AS payload FROM cq JOIN live USING (cache_key) GROUP BY query_id")
def cache_exact_hit(spark, sf_dir):
    return cache.exact_hits(cache_questions(spark, sf_dir), cached(spark, sf_dir), now())


@query(
    f"""WITH {LIVE}, {CACHE_Q}, pairs AS (SELECT query_id, cache_key, payload, round((q.value * l.value + 1) / (sqrt(q.value * q.value + 1) * sqrt(l.value * l.value + 1)), 6) AS similarity FROM (SELECT query_id, scope, value FROM cq) q JOIN live l USING (scope))
    SELECT query_id, payload, similarity FROM pairs WHERE similarity >= 0.95 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cache_key DESC, payload DESC) = 1"""
)
def cache_semantic_hit(spark, sf_dir):
    """All questions: those with a scope of their own, and those without, which share one."""
    return cache.semantic_hits(cache_questions(spark, sf_dir), cached(spark, sf_dir), now()).select("query_id", "payload", "similarity")


@query("SELECT event_id FROM events WHERE value / 100 >= 0.5 AND event_type <> 'error'")
def cache_write_guard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "error", answer.NOT_FOUND).otherwise(F.col("event_type"))
    rows = e.select(F.col("event_id").cast("string").alias("query"), F.array().cast("array<string>").alias("document_ids"), F.array(F.col("value")).alias("query_vector"), F.lit("offline").alias("provider"), F.concat(said, F.lit("")).alias("answer"), (F.col("value") / 100).alias("confidence"), "event_id")
    written = cache.entries(rows, now()).select("cache_key")
    keys = rows.select("event_id", scores.cache_key(F.col("query"), F.col("document_ids")).alias("cache_key"))
    return keys.join(written, "cache_key", "left_semi").select("event_id")


@query(f"SELECT event_type, count(*) AS live FROM events WHERE ts + INTERVAL 10 DAY > {NOW} GROUP BY event_type")
def cache_ttl(spark, sf_dir):
    alive = cache.live(cached(spark, sf_dir), now()).select(F.col("payload").cast("long").alias("event_id"))
    return alive.join(table(spark, sf_dir, "events"), "event_id").groupBy("event_type").agg(F.count("*").alias("live"))


@query("SELECT count(*) AS kept FROM events WHERE user_id % 2 = 1 AND user_id % 3 <> 0")
def cache_invalidation(spark, sf_dir):
    """Documents whose number divides by three were ingested again."""
    again = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("document_id")).distinct()
    return cache.invalidated(cached(spark, sf_dir), again).agg(F.count("*").alias("kept"))


# --- evaluation -------------------------------------------------------------------------------------

JUDGED = f"""{KNN}, judged AS (SELECT query_id, rank, label = want AS hit FROM near),
per AS (SELECT query_id, max(CASE WHEN rank <= 3 AND hit THEN 1 ELSE 0 END) AS recall_3, max(CASE WHEN hit THEN 1 ELSE 0 END) AS recall_5, round(sum(CASE WHEN rank <= 3 AND hit THEN 1 ELSE 0 END) / 3, 6) AS precision_3,
  round(coalesce(1 / min(CASE WHEN hit THEN rank END), 0.0), 6) AS mrr_5, round(CASE WHEN sum(CASE WHEN hit THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, CAST(greatest(1, sum(CASE WHEN hit THEN 1 ELSE 0 END)) AS BIGINT) + 1), lambda k: 1 / log2(k + 1))) ELSE 0.0 END, 6) AS ndcg_5,
  round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS context_precision FROM judged GROUP BY query_id)"""


def judged(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = neighbours(spark, sf_dir)
    return near.join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").select("query_id", "rank", (F.col("label") == F.col("want")).alias("hit"))


@query(f"WITH {JUDGED} SELECT query_id, recall_3, recall_5 FROM per")
def recall_at_k(spark, sf_dir):
    return evaluate.per_query(judged(spark, sf_dir)).select("query_id", "recall_3", "recall_5")


@query(f"WITH {JUDGED} SELECT query_id, precision_3 FROM per")
def precision_at_3(spark, sf_dir):
    return evaluate.per_query(judged(spark, sf_dir)).select("query_id", "precision_3")


@query(f"WITH {JUDGED} SELECT query_id, mrr_5 FROM per")
def mrr_at_5(spark, sf_dir):
    return evaluate.per_query(judged(spark, sf_dir)).select("query_id", "mrr_5")


@query(f"WITH {JUDGED} SELECT query_id, ndcg_5 FROM per")
def ndcg_at_5(spark, sf_dir):
    return evaluate.per_query(judged(spark, sf_dir)).select("query_id", "ndcg_5")


@query(f"WITH {JUDGED} SELECT round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(precision_3), 6) AS precision_3, round(avg(mrr_5), 6) AS mrr_5, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(context_precision), 6) AS context_precision, count(*) AS n_queries FROM per")
def eval_means(spark, sf_dir):
    return evaluate.means(evaluate.per_query(judged(spark, sf_dir)))


@query("SELECT event_type, round(avg(value), 4) AS mean, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def latency_p95_index(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN value - 50 END), 4) AS mean_positive FROM events GROUP BY event_type")
def stage_mean_positive(spark, sf_dir):
    return evaluate.mean_positive(table(spark, sf_dir, "events").withColumn("value", F.col("value") - 50), ["event_type"], "value")


@query(
    f"""WITH w AS (SELECT item_id, text, {pieces("text")} AS k FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT item_id, doc_id, round(len(list_filter(k, lambda x: contains(t, lower(x)))) / greatest(len(k), 1), 6) AS recall, len(list_filter(k, lambda x: contains(t, lower(x)))) / greatest(len(k), 1) >= 0.5 AS passes FROM w JOIN d ON item_id = doc_id"""
)
def keyword_recall(spark, sf_dir):
    """All words of an item against the document of the same number."""
    w = table(spark, sf_dir, "benchmark").select("item_id", text.blank_split(F.col("text")).alias("k"))
    both = w.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    r = evaluate.keyword_recall(F.col("k"), F.col("text"))
    return both.select("item_id", F.col("item_id").alias("doc_id"), F.round(r, 6).alias("recall"), (r >= 0.5).alias("passes"))


@query(
    f"""{FOLD}, raws AS (SELECT query_id, sum(len(text)) AS chars, count(*) AS candidates FROM ordered GROUP BY query_id) SELECT query_id, round(1 - len(context) / chars, 6) AS compression FROM contexts JOIN raws USING (query_id)"""
)
def compression_ratio(spark, sf_dir):
    r = reranked(spark, sf_dir)
    both = answer.compress(r).join(r.groupBy("query_id").agg(F.sum(F.length("text")).alias("chars")), "query_id")
    return both.select("query_id", F.round(evaluate.compression_ratio(F.col("context"), F.col("chars")), 6).alias("compression"))


@query(
    f"WITH {BM25}, gold AS (SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b JOIN hits h ON h.query_id = b.item_id JOIN chunks c ON c.chunk_id = h.chunk_id AND contains(c.text, b.text)) SELECT query_id, max(CASE WHEN g.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS found FROM hits LEFT JOIN gold g USING (query_id, chunk_id) GROUP BY query_id"
)
def known_item(spark, sf_dir):
    """Whether a chunk that holds the query itself is among the five best."""
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir)
    hits = lexical_hits(spark, sf_dir).select("query_id", "chunk_id").join(q, "query_id").join(c.select("chunk_id", "text"), "chunk_id")
    return hits.groupBy("query_id").agg(F.max(F.contains("text", "query").cast("int")).alias("found"))


@query(
    f"""WITH {CHUNKS}, n AS (SELECT chunk_id, text, len({pieces("text")}) AS w FROM chunks), s AS (SELECT chunk_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: len({pieces("x")}) > 10) AS s FROM n WHERE w > 30 AND w < 150)
    SELECT chunk_id, s[len(s) // 2 + 1] || '?' AS query FROM s WHERE len(s) > 0"""
)
def synthetic_queries(spark, sf_dir):
    return sampling.synthetic_queries(chunks(spark, sf_dir))


SYNTHETIC = f"""n AS (SELECT chunk_id, text, len({pieces("text")}) AS w FROM chunks), s AS (SELECT chunk_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: len({pieces("x")}) > 10) AS s FROM n WHERE w > 30 AND w < 150),
benchmark AS (SELECT chunk_id AS item_id, s[len(s) // 2 + 1] || '?' AS text FROM s WHERE len(s) > 0)"""


@query(f"WITH {BM25.replace(INDEX, SYNTHETIC + ', ' + INDEX)} SELECT query_id AS chunk_id, bool_or(query_id = chunk_id) AS found FROM hits GROUP BY query_id")
def known_item_synthetic(spark, sf_dir):
    """Whether the question made of a chunk finds it among the five best of all chunks: every such chunk is asked for."""
    c = fresh_chunks(spark, sf_dir)
    return known_items.recovered(c, saved(spark, sf_dir, "statistics", lambda: bm25.statistics(c)))


@query(f"WITH {LIVE}, {CACHE_Q}, hit AS (SELECT DISTINCT query_id FROM cq JOIN live USING (cache_key)) SELECT round((SELECT count(*) FROM hit) / count(*), 6) AS cache_hit_rate FROM cq")
def cache_hit_rate(spark, sf_dir):
    q = cache_questions(spark, sf_dir)
    rate = evaluate.cache_hit_rate(q, cache.exact_hits(q, cached(spark, sf_dir), now()))
    return rate.select(F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


@query(f"SELECT round(1 - count(*) FILTER (route = 'fast') / count(*), 6) AS activation, count(*) AS n_queries FROM ({route_sql(planner.FUSED)})")
def activation(spark, sf_dir):
    """The share of questions that do not take the fast path."""
    return evaluate.activation(planner.route(all_questions(spark, sf_dir))).select(F.round("activation", 6).alias("activation"), "n_queries")


@query("SELECT event_type AS provider, count(*) AS calls, round(sum(value), 4) AS total_ms, round(avg(value), 4) AS mean_ms FROM events GROUP BY event_type")
def provider_counters(spark, sf_dir):
    """Events as calls of their type's provider."""
    return evaluate.provider_counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("value").alias("ms")))
