"""Empty tables, very long texts and repeated rows, and the image hash against a plain transform."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import media, mixing, neardup, pieces, quality, urlfilter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCUMENTS)


def test_empty_tables_stay_empty(spark):
    import corpus_pipeline as p

    none = documents(spark, [])
    assert quality.judge(none).count() == 0 and quality.passing(none).columns == none.columns
    assert neardup.cluster(none).count() == 0 and mixing.copies(none).count() == 0
    docs = none
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == none.columns and docs.count() == 0


def test_an_empty_table_is_encoded_as_one(spark):
    model = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    assert pieces.encode(documents(spark, []), model).count() == 0


def test_very_long_texts_are_judged_whole(spark):
    r = random.Random(11)
    line = lambda: " ".join(f"word{r.randrange(10**6)}" for _ in range(20)) + "."
    lines = [line() for _ in range(5_000)]
    menu = "Home | News | Shop | Cart"
    got = quality.judge(documents(spark, ["\n".join([*lines, menu, lines[0]])])).select("quality.*").first()
    assert got.n_words == 20 * 5_001 + 7 and got.n_dup_lines == 1 and got.n_symbols == 3 and got.n_repeat_words == 40 and not got.base_failed
    assert got.kept and menu not in got.clean_text and got.clean_text.endswith(lines[0])


def test_very_long_texts_are_compared_whole(spark):
    r = random.Random(12)
    words = [f"w{r.randrange(10**6)}" for _ in range(100_000)]
    late = [*words[:-30_000], *(f"v{k}" for k in range(30_000))]  # 70 % of the shingles of each
    docs = documents(spark, [" ".join(x) for x in (words, late, [*words, "more"])])
    assert {x.doc_id: x.component_id for x in neardup.cluster(docs).collect()} == {0: 0, 1: 1, 2: 0}


def test_repeated_pages_and_very_long_urls_get_one_verdict(spark):
    rules = [urlfilter.Rule("net", "/de/", "block")]
    urls = ["http://a.net/de/" + "x" * 1_000_000, "http://" + "b." * 100_000 + "net/en/"]
    pages = spark.createDataFrame([(k // 2, urls[k // 2]) for k in range(4)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 0), (1, 0)], "page_id long, bad int")
    got = sorted((x.page_id, x.rule, x.verdict, len(x.host), len(x.path)) for x in urlfilter.judge(pages, outcomes, rules).select("page_id", F.coalesce("rule", F.lit("")).alias("rule"), "verdict", "host", "path").collect())
    first, second = (0, "net/de/", "block", 5, 1_000_004), (1, "", "allow", 200_003, 4)
    assert got == [first, first, second, second]


def plain_hash(samples):
    """Means of 24 x 24 areas and the cosine sums written out, place by place."""
    edge = [k * len(samples) // 24 for k in range(25)]
    cells = [[statistics.fmean(int(samples[y][x]) for y in range(edge[i], edge[i + 1])) for x in range(24)] for i in range(24)]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 24)
    wave = lambda k, x: math.cos(math.pi * k * (2 * x + 1) / 48)
    low = [round(scale(u) * scale(v) * sum(cells[y][x] * wave(u, y) * wave(v, x) for y in range(24) for x in range(24)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    bits = "".join("1" if c > middle else "0" for c in low)
    return int(bits, 2).to_bytes(8, "big")


@pytest.mark.parametrize("height", [24, 31, 48, 250])
def test_image_hash_is_that_of_a_plain_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 24), dtype=np.uint8)
    assert media.cosine_hash(samples) == plain_hash(samples.tolist())


def test_a_mix_has_each_document_as_often_as_its_copies_say(spark):
    r = random.Random(13)
    rows = [(k, "w " * r.choice([0, 3, 40, 300]), "en", r.choice(["a", "b", None]), 1) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    want = {x.doc_id: x.copies for x in mixing.copies(docs).collect() if x.copies}
    assert {x.doc_id: x.n for x in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
