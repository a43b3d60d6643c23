"""Sharding, mixing and repeated rows against plain versions."""

import math
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, mixing, neardup, sharding, substrings


def hashed(*values):
    """Spark's xxhash64: each value's hash is the next one's seed; nulls are passed over."""
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(size, "little", signed=True), h)
    return h


def shard(key, leaves):
    at = ""
    for level in range(3):
        weights = defaultdict(float)
        for x in leaves:
            names = ("", x.region, x.rack, f"{x.rack}/{x.shard}")
            if names[level] == at:
                weights[names[level + 1]] += x.weight
        at = min((-math.log(((hashed((key, 8), (n, 0), (0, 4)) >> 11) + 0.5) / 2.0**53) / w, n) for n, w in weights.items())[1]
    return int(at.rsplit("/", 1)[1])


def test_shards_are_those_of_a_plain_descent(spark):
    leaves = sharding.reweighted(sharding.tree(24), 7, 2.5)
    got = spark.range(-50, 400).select("id", sharding.shard_of(F.col("id"), leaves).alias("s")).collect()
    assert [r.s for r in got] == [shard(r.id, leaves) for r in got]


def copies_of(rows, targets):
    """Copies of rows (id, source, size): tiers by length, ranks within them, one offset a source, boundaries crossed."""
    step = lambda n: n if n < 64 else math.floor(16 * (math.log(n) / math.log(2))) - 32
    sources = defaultdict(list)
    for i, s, n in rows:
        sources[s].append((step(n), hashed((i, 8), (n, 8), (0, 4)), n, (i is not None, i or 0)))
    out = defaultdict(list)
    for s, own in sources.items():
        longest = defaultdict(int)
        for c, _, n, _ in own:
            longest[c] = max(longest[c], n)
        tier = lambda c: sum(longest[c] <= share * targets[s] for share in mixing.TIERS)
        own = sorted((tier(c), c, (h - (1 << 64) if h >> 63 else h) % 64, n, i) for c, h, n, i in own)
        h = hashed(("-" if s is None else "s" + s, 0), (1, 4))
        u = ((h - (1 << 64) if h >> 63 else h) % mixing.OFFSETS + 0.5) / mixing.OFFSETS
        open_, rest, base = targets[s], sum(x[3] for x in own), 0.0
        for t in range(3):
            rate = max(0.0, min(open_ / rest, 3.0)) if rest > 0 else 0.0
            mine = [x for x in own if x[0] == t]
            for r, x in enumerate(mine, 1):
                c = min(math.floor(base + r * rate + u) - math.floor(base + (r - 1) * rate + u), 3)
                out[(x[4][1] if x[4][0] else None, s, x[3])].append(c)
                open_, rest = open_ - c * x[3], rest - x[3]
            base += len(mine) * rate
    return out


def test_copies_are_those_of_plain_systematic_sampling(spark):
    r = random.Random(6)
    rows = [(k, r.choice(["a", "b", "b", "c", None]), r.choice([0, 3, 9, 40, 70, 300, 2500])) for k in range(900)] + [(None, "a", 5), (None, "a", 5), (7, "b", 40), (7, "b", 40)]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in rows], "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    want = copies_of(rows, {x.source: x.target for x in got})
    have = defaultdict(list)
    for x in got:
        have[(x.doc_id, x.source, x.size)].append(x.copies)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for s in ("a", "b", "c", None):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.size * x.copies for x in own) - own[0].target) < 0.005 * own[0].target


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(7, long, "x"), (7, long, "x"), (7, long + " tail", "y"), (7, "other words here", "z"), (3, "OTHER words here", "q"), (9, long, "x"), (None, "", "e"), (None, "", "e"), (None, None, "e"), (8, "", "e"), (None, "alone it is", "n"), (None, "alone it is", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, times string")
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((str(x.doc_id), str(x.text)) for x in kept.collect())
    first = [x for x in got if x[0] == "7"]
    assert len(first) == 1 and first[0][1].startswith(long)
    assert [x for x in got if x[0] != "7"] == [("3", "OTHER words here"), ("8", ""), ("None", ""), ("None", "None"), ("None", "alone it is")]
    assert neardup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [4000, 2])
def test_repeats_with_ids_of_other_types(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    passage = " ".join(f"p{k}" for k in range(25))
    ids = ["b", "a10", "a9", None, "c"]
    df = spark.createDataFrame([(i, f"{k} {passage} end{k}") for k, i in enumerate(ids)], "doc_id string, text string")
    got = {x.doc_id: x.n_removed for x in substrings.deduplicate(df).collect()}
    assert got == {"a10": 0, "a9": 25, "b": 25, "c": 25, None: 25}
    dates = df.withColumn("doc_id", F.expr("date'2020-01-01' + int(ascii(doc_id))"))
    assert sorted(x.n_removed for x in substrings.deduplicate(dates.where("doc_id is not null")).collect()) == [0, 25, 25, 25]


def test_tables_on_the_way_are_deleted(spark):
    place = common.shared_dir(spark).removeprefix("file://")
    import os

    before = set(os.listdir(place))
    df = spark.createDataFrame([(k, " ".join(f"w{j % 40 + k % 3}" for j in range(80))) for k in range(40)], "doc_id long, text string")
    neardup.cluster(df).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(place)) - before}
    assert left == {"signatures", "nodes", "links", "components"}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
