"""Near-duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles.  A text's sketch is its ``SKETCH`` smallest shingle hashes; inverted
lists of these retained values generate the pairs, the sketch of the union estimates their similarity,
and exact Jaccard similarity of the whole shingle sets confirms links.  Texts with equal words are one
node from the start, so copies cost nothing.

Which values of a sketch generate pairs: similar texts share many retained values, hence one at least
among their rarest few (how many follows from the similarity and, for texts with more shingles than a
sketch holds, from a binomial tail below ``MISS``).  Lists of at most ``SHORT`` texts are paired in full.
Longer lists are never paired in full, and are not cut either: each has a leader, the text with the most
long-list values, with which every text is compared that has one of its rarest values there.  All these
texts then enter with their whole shingle sets, rarest shingles first.  In that order two similar texts
share a shingle within a short prefix, at places that bound how similar they can be; joined on shingles,
sizes and places, they are compared unless links found before connect them already.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import blake2b
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, outcome, settle
from .components import components, matching

SKETCH = 64
SHORT = 32
MISS = 1e-9
#: Shingles that one task counts at a time.
BUCKET = 1_000_000
#: Classes of hashes by which texts are told apart before they are compared.
PARITY = 512


class _Hashes(dict):
    """64-bit hashes of words, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hash = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in lower case (A-Z only); bytes.split splits at the same six characters."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence where there are fewer, none without words."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - size + 1, 1)
    out = np.full(n, min(len(w), size), np.uint64)
    for j in range(min(size, len(w))):
        out = (out ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def shingle_set(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(size)), strict=False))


def least_shared(percent: int, k: int = SKETCH, miss: float = MISS) -> int:
    """What the sketch of a union holds at least of the shared values, but for ``miss``: a binomial tail."""
    t, below = Fraction(percent, 100), Fraction(0)
    for c in range(k + 1):
        below += comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > miss:
            return c
    return k


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, node (16 bytes, of the words in order), n_shingles, sketch (unsigned order) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            values = np.unique(shingle_hashes(words, size))
            nodes.append(blake2b(b" ".join(words), digest_size=16).digest())
            sizes.append(len(values))
            sketches.append(values[:SKETCH].view(np.int64))
        offsets = np.cumsum([0, *map(len, sketches)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sketches, np.empty(0, np.int64)])))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_hash", "node", "n_shingles", "sketch"])

    text = docs[text_col]
    return arrow_map(docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), each, f"doc_id {kind}, text_hash long, node binary, n_shingles long, sketch array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(nid, text) of the ``wanted`` nodes (nid, text_hash): a scan of all texts, of which these remain."""
    found = matching(docs.select(F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text")), wanted.select("text_hash").distinct(), "text_hash")
    return found.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash").select("nid", "text")


def _compare(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) whose whole shingle sets are similar enough."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked, held = [], (None, set())
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if held[0] != one:
                held = (one, shingle_set(words_of(one), size))
            left, right = held[1], shingle_set(words_of(two), size)
            shared = len(left & right)
            linked.append(100 * shared >= percent * (len(left) + len(right) - shared))
        return batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return arrow_map(pairs, each, "a long, b long")


def _rare_first(texts: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """(nid, n, parity, i, value): for each of the ``texts`` the prefix of its shingles, rarest first, that it can
    share with any similar text; n is the number of its shingles, i a shingle's place, and those alone are left
    out.  ``parity`` has a bit for each of PARITY classes of hashes: whether the text's number of shingles in it
    is odd.  Two texts differ in as many shingles as bits at least.

    Shingles are counted in ``buckets`` of their hashes; a text sends each bucket one list.
    """

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for nid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.unique(shingle_hashes(words_of(text), size))
            at = (values % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            found, starts = np.unique(at[order], return_index=True)
            for bucket, part in zip(found.tolist(), np.split(values[order], starts[1:]), strict=True):
                for column, x in zip(out, (bucket, nid, part.view(np.int64)), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["bucket", "nid", "values"])

    def counted(rows: pa.Table) -> pa.Table:
        lists = rows.column("values").combine_chunks()
        _, place, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        dfs = pa.ListArray.from_arrays(lists.offsets, pa.array(times[place].astype(np.int32)))
        return pa.table({"nid": rows.column("nid"), "values": lists, "dfs": dfs})

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, parities, places, kept = [], [], [], []
        for parts in batch.column(1).to_pylist():
            values = np.concatenate([p["values"] for p in parts])
            dfs = np.concatenate([p["dfs"] for p in parts])
            n = len(values)
            order = np.lexsort((values, dfs))[: n - ceil(Fraction(percent * n, 100)) + 1]
            met = np.flatnonzero(dfs[order] > 1)
            sizes.append(n)
            parities.append(np.packbits((np.bincount(values.view(np.uint64) % np.uint64(PARITY), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64))
            places.append(met)
            kept.append(values[order[met]])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(parities, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))], ["nid", "n", "parity", "i", "value"])

    lists = arrow_map(texts.select("nid", "text"), dealt, "bucket long, nid long, values array<long>")
    dfs = lists.groupBy("bucket").applyInArrow(counted, "nid long, values array<long>, dfs array<int>")
    whole = dfs.groupBy("nid").agg(F.collect_list(F.struct("values", "dfs")).alias("parts"))
    return arrow_map(whole, prefixes, "nid long, n long, parity array<long>, i array<long>, value array<long>").select("nid", "n", "parity", F.inline(F.arrays_zip("i", "value")))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = (texts.select(F.col("nid").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")


def links(nodes: DataFrame, docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """(a, b): links between nodes (nid, text_hash, n_shingles, sketch) that connect all that are similar.

    What is joined by a value is a written table on either side, so that a value of very many texts is a
    skewed partition, which adaptive execution splits, and never one task's work.
    """
    return outcome(nodes.sparkSession, "links", lambda: _links(nodes, docs, size, percent, text_col))


def _links(nodes: DataFrame, docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    k, shared = SKETCH, least_shared(percent)
    n, held = F.col("n_shingles"), F.size("sketch")
    # what a sketch shares with any similar text's, from the sizes both can have
    exact = F.ceil(n * percent / 100)
    needed = F.when(n * 100 <= k * percent, exact).when(n <= k, F.least(exact, F.lit(shared))).otherwise(shared)
    values = nodes.select("nid", F.explode("sketch").alias("value"))
    lists = cut(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "lists")
    postings = cut(values.join(lists, "value"), "postings")

    # a node's rarest values: those that no other has come first, so their number shifts the places
    own = postings.join(nodes.select("nid", "n_shingles", held.alias("held"), needed.alias("needed")), "nid")
    order = Window.partitionBy("nid").orderBy("df", "value")
    place = F.row_number().over(order) + F.col("held") - F.count("*").over(Window.partitionBy("nid"))
    hot = F.sum((F.col("df") > SHORT).cast("int")).over(Window.partitionBy("nid"))
    ranked = cut(own.withColumn("place", place).withColumn("hot", hot).withColumn("rare", F.col("place") <= F.col("held") - F.col("needed") + 1).select("value", "nid", "n_shingles", "df", "hot", "rare"), "ranked")

    few = ranked.where((F.col("df") <= SHORT) & F.col("rare"))
    one, two = (few.select("value", F.col("nid").alias(x), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    alike = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") < F.col("b"))
    pairs = one.join(two, "value").where(alike).select("a", "b").distinct()
    sketch_a, sketch_b = (nodes.select(F.col("nid").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    # hashes are in unsigned order: flipping the sign bit makes array_sort agree
    flip = lambda s: F.transform(s, lambda v: v.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    union = F.slice(F.array_sort(flip(F.array_union("s_a", "s_b"))), 1, k)
    both = F.size(F.array_intersect(flip(F.array_intersect("s_a", "s_b")), union))
    whole = F.greatest("n_a", "n_b") <= k  # then sketches are the sets
    common = F.size(F.array_intersect("s_a", "s_b"))
    likely = F.when(whole, common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).otherwise(both >= F.least(F.size(union), F.lit(shared)))
    pairs = pairs.join(sketch_a, "a").join(sketch_b, "b").where(likely).select("a", "b")

    long_lists = ranked.where(F.col("df") > SHORT)
    leaders = cut(long_lists.groupBy("value").agg(F.max(F.struct("hot", -F.col("nid"))).alias("lead")).select("value", (-F.col("lead.col2")).alias("a")), "leaders")
    families = long_lists.where("rare").join(leaders, "value").select("a", F.col("nid").alias("b"))
    pairs = cut(pairs.unionByName(families).distinct(), "pairs")
    members = cut(families.select(F.col("b").alias("nid")).distinct(), "members")
    wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    texts = cut(_texts(docs, nodes.select("nid", "text_hash").join(wanted, "nid"), text_col), "texts")
    found = cut(_compare(_with_texts(pairs.where("a != b"), texts), size, percent), "found")

    roots = components(found)
    held_all = members.join(nodes, "nid").agg(F.sum("n_shingles")).first()[0] or 0
    entries = _rare_first(texts.join(members, "nid", "left_semi"), size, percent, max(16, held_all // BUCKET))
    entries = cut(entries.join(roots.select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("root", F.coalesce("root", "nid")), "entries")
    # a list whose texts are all connected, or whose sizes no entry can reach, need not be paired
    spread = cut(entries.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least")).where("r0 != r1").drop("r0", "r1"), "spread")
    open_ = entries.join(spread, "value")
    reach = (F.col("n") - F.col("i")) * (100 + percent) - F.col("n") * percent  # at least percent times the other's size
    open_ = cut(open_.where(reach >= F.col("least") * percent), "open")
    small = open_.where(reach >= F.col("n") * percent)  # what the smaller of two needs
    b, a = (x.select("value", F.col("nid").alias(y), F.col("n").alias(f"n_{y}"), F.col("parity").alias(f"parity_{y}"), reach.alias(f"reach_{y}"), F.col("root").alias(f"root_{y}")) for x, y in ((small, "b"), (open_, "a")))
    fits = (F.struct("n_b", "b") < F.struct("n_a", "a")) & (F.col("root_a") != F.col("root_b")) & (F.col("n_b") * 100 >= F.col("n_a") * percent) & (F.col("reach_a") >= F.col("n_b") * percent) & (F.col("reach_b") >= F.col("n_a") * percent)
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    rest = a.join(b, "value").where(fits & near).select("a", "b").distinct()
    more = _compare(_with_texts(rest, texts), size, percent)
    return found.unionByName(more)


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (of the group; null without words) and component_id of every row."""
    settle(docs.sparkSession)
    rows = cut(signatures(docs, size, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(first, F.min_by(F.struct("text_hash", "n_shingles", "sketch"), "text_hash").alias("one"))
    nodes = cut(nodes.select("node", F.col("first.doc_id").alias("first"), "one.*", F.monotonically_increasing_id().alias("nid")), "nodes")
    roots = components(links(nodes, docs, size, percent, text_col))
    ids = nodes.select("node", "nid", "first").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    named = ids.join(least, "root").select("node", "root", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "root", component.alias("component_id"))


def cluster(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of near-duplicates.

    Texts whose sets of distinct ``size``-word shingles (words in lower case, A-Z only; with fewer words the
    whole sequence is the one shingle) have a Jaccard similarity of ``percent`` or more are linked; groups
    are what links connect.  Returns id, ``n_shingles``, ``component_id`` (the least id in the group) and
    ``kept`` (id = component_id).  Without words, text or both, the set is empty and the row is a group of
    its own.  Rows that repeat, also with the same id, are in one group and agree in ``kept``.  A null id
    never counts as least unless a group has no other; then component_id is null and the rows are kept.
    An empty table gives an empty one; other columns are ignored.
    """
    out = _grouped(docs, size, percent, id_col, text_col)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of :func:`cluster`, in the columns of ``docs``.

    It has the group's least id; where that id has several texts, the one with the least hash, and of rows
    that repeat id and text one stays.  Rows without words stay, once for each id and text.  Only rows that
    repeat are shuffled with their texts beyond the join with what stays.
    """
    rows = _grouped(docs, size, percent, id_col, text_col).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    keys = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    best = keys.where("root is not null").groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "times")).alias("one")).select("one.*")
    kept = cut(keys.where("root is null").select("text_hash", "doc_id", "times").unionByName(best).withColumnRenamed("doc_id", "kept id"), "kept")
    mine = lambda some: docs.join(some, docs[id_col].eqNullSafe(some["kept id"]) & (F.xxhash64(docs[text_col]) == some["text_hash"]), "left_semi")
    again = kept.where("times > 1")
    if again.isEmpty():
        return mine(kept)
    return mine(kept.where("times = 1")).unionByName(mine(again).dropDuplicates([id_col, text_col]))
