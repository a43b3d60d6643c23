"""Hard negatives, spelling variants and packing against plain versions, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives, packing, queries, spelling

SEED = random.Random(5)


def _mined(rows, positives=5, negatives_=5, low=80, high=100):
    """rows: (id, label, vector); plain search, anchors have ids divisible by 100."""
    kept = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in kept:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in kept if len(w) == len(v))
            for s, p, _ in [x for x in scored if x[2] == y and x[1] != i][:positives]:
                fit = [(j, -t) for t, j, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:negatives_]
                out += [(i, p, k + 1, j, -s, t) for k, (j, t) in enumerate(fit)]
    return sorted(out)


def _vectors(n, dim, odd=True):
    rows = [(k, SEED.randrange(3), [SEED.choice([0.25, 0.5, SEED.uniform(-1, 1)]) * 4 ** (k % 3) for _ in range(dim)]) for k in range(n)]
    if odd:
        rows += [(n, None, [1.0] * dim), (n + 1, 1, None), (None, 1, [1.0] * dim), (n + 2, 1, [None] + [1.0] * (dim - 1)), (n + 3, 1, [float("nan")] * dim), (n + 4, 2, [float("inf")] * dim), (n + 5, 1, []), (n + 6, 1, [1.0])]
        rows += [rows[7], rows[100], rows[201]]  # repeated rows, an anchor among them
    return rows


@pytest.mark.parametrize("block,bucket,chunk", [(2048, 8192, 4096), (3, 17, 5)])
def test_negatives_equal_a_plain_search(spark, monkeypatch, block, bucket, chunk):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "PACKED_BYTES", 16 * bucket)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = _vectors(410, 6)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, `a.b` string").withColumnRenamed("a.b", "key")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))
    want = _mined(rows)
    assert got == want and len(want) > 50


def test_negatives_of_huge_vectors_and_of_none(spark):
    big = [(100 * k, k % 2, [2.0**20 * (k + 1), -(2.0**19)]) for k in range(6)] + [(7, 1, [3e38, 1.0])]
    schema = "vec_id long, label int, embedding array<double>"
    df = spark.createDataFrame(big, schema)
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == _mined(big[:-1])
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []


def _variants(docs, least=7, at_least=2, ratio=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: k for w, k in n.items() if k >= at_least}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[p + (len(a) == len(b)) :] == b[p + 1 :]

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart(v, w)] for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


@pytest.mark.parametrize("group", [100_000, 40])
def test_variants_equal_a_plain_version(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP_CHARS", group)
    stems = ["".join(SEED.choice("abé") for _ in range(SEED.randrange(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ababababab"]
    weights = [SEED.choice([1, 1, 3, 40]) for _ in stems]
    docs = [(k, " ".join(w if SEED.random() < 0.8 else w[:3] + SEED.choice("aBÉ÷") + w[SEED.choice([3, 4]) :] for w in SEED.choices(stems, weights, k=60))) for k in range(40)]
    docs += [(90, None), (91, ""), (None, "aaaaaaa aaaaaaa NOBODY"), (92, "x" * 30_000 + " " + "x" * 30_001), (93, "x" * 30_000 + " " + "x" * 30_001), docs[3]]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, word int")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())
    want = _variants(docs)
    assert got == want and sum(x[1] != "" for x in want) > 3 and sum(x[4] for x in want) > 50


def test_variants_of_nothing_and_chains(spark):
    schema = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(["abcdefg"] * 400 + ["abcdefx"] * 30 + ["abcdeyx"] * 2)
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([(None, text)], schema)).collect()}
    assert got == {"abcdefg": (None, "abcdefg"), "abcdefx": ("abcdefg", "abcdefg"), "abcdeyx": ("abcdefx", "abcdefg")}


TOKENIZER = "word_bpe_49k.json"


def test_packing_ids_equal_the_librarys():
    file = queries.tokenizer_file(TOKENIZER)
    encoder = packing.encoder(file)
    letters = [*map(chr, range(1, 0x180)), "’", "–", "　", "ﬁ", "Σ", "İ", "é", "<|endoftext|>", "'s", "'LL", "語", "😀"]
    for _ in range(400):
        text = "".join(SEED.choices(letters, k=SEED.randrange(40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert len(encoder.encode("x" * 200_000)) > 4


def test_packing_holds_every_piece_once(spark):
    texts = [None, "", "the cat", "word " * 70, *(" ".join(SEED.choices(["a", "bird", "Flies"], k=SEED.randrange(90))) for _ in range(150))]
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "again", "y")] + [(1000 + k, "same words here", "x") for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length string")
    file, limit = queries.tokenizer_file(TOKENIZER), 64
    cut = packing.pieces(df, file, limit).withColumn("a.b", F.lit(1))
    packed = packing.pack(cut, limit)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "a.b", "sequence_id", "offset"]
    rows = packed.collect()
    encoder = packing.encoder(file)
    want = Counter()
    for i, t, _ in docs:
        ids = encoder.encode(t or "") + bytes(4)
        want.update((i, n, s // 4, ids[s : s + 4 * limit]) for n, s in enumerate(range(0, len(ids), 4 * limit)))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length == len(r.ids) // 4 and r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= limit and len(at) <= math.ceil(sum(r.length for r in rows) / limit) + 2
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert sorted(len(x) // 4 for x in whole.values()) == sorted(at.values())
    assert packing.pack(packing.pieces(df.limit(0), file, limit), limit).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(65,)], "length long"), limit)


@pytest.mark.parametrize("histogram", [{60: 7, 40: 7, 50: 3}, {33: 300}, {51: 40, 49: 20, 25: 40, 24: 7}, {100: 5}, {1: 1}, {34: 60, 33: 60, 35: 60, 30: 1}])
def test_plans_hold_the_histogram_near_the_bound(histogram):
    """Rounding costs one sequence at most over the fewest possible here."""
    uses = packing.plan(histogram, 100)
    held = Counter()
    for use in uses:
        assert sum(n * k for n, k in use.parts) <= 100
        for n, k in use.parts:
            held[n] += k * use.times
    best = {60: 9, 33: 100, 51: 45, 100: 5, 1: 1, 34: 75}[next(iter(histogram))]
    assert held == Counter(histogram) and sum(u.times for u in uses) <= best + 1
