"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words.  The expected copies of its documents are prefix-summed in a fixed order,
one random offset is added per source, and a document is emitted once for each integer boundary that its
step of the sum crosses.  Long documents come first; what they take too much or too little changes the expected
copies of the shorter ones after them, so that the words of all come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, word_count
from .components import BROADCAST_ROWS

#: The offset has this many equally likely values, so sums with it stay exact up to 2**37 documents.
OFFSETS = 1 << 16
#: Tiers of a source: documents longer than this share of the target, then the rest.  The first ones are few
#: (their number is at most source size over share and target), whatever the source's size.
TIERS = (1 / 20, 1 / 400)
#: Rows of a cell, which one task sorts, where a class has a fiftieth of all rows.
CELL_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size), which add up to all sizes.

    Sources in code-point order, null last, weigh ``weights``, repeating.  No target exceeds ``most``
    times its source's size; what is over is shared again by weight until none does.  That fixed point
    is found in one pass: in order of size / weight, a source is full while its limit is below its share
    of what the full ones before it leave.
    The window is over one row per source.
    """
    own = F.col("source_size").cast("double") * most
    by_name, by_need = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("need", F.col("source").asc_nulls_last())
    before, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    place = F.row_number().over(by_name)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(place - 1, F.lit(len(weights))) + 1))
    shared = (
        weighed.withColumn("limit", own)
        .withColumn("need", own / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("need") <= F.col("level"))
        .withColumn("common", F.min(F.when(~F.col("full"), F.struct("need", "level"))).over(everything)["level"])
    )
    return shared.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("common"))).alias("target"))


def copies(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 0, keep: str | None = None) -> DataFrame:
    """Every document with its number of copies in the mix: systematic sampling within each source.

    Returns id, ``source``, ``size`` (words; none in a null or empty text), ``source_size``, ``target``,
    ``copies`` (0 to ``most``) and, as ``kept``, the column ``keep``.  A source without words has target 0 and no
    copies.  Rows that repeat count as documents of their own; null sources are one source, null ids are
    allowed.  An empty table gives an empty one.

    The order of the prefix sum is by tier, longest documents first, then size class (exact below 64 words, then
    sixteenths of an octave), a hash of the row, size, id: neighbours are alike in size.  A tier's expected
    copies are what is left of the target over what is left of the source, so the last tier makes up for the first
    ones.  No source needs a sort of its own: rows are ranked in cells of a source, class and hash, some CELL_ROWS
    rows of a large class each, and the cells' row counts give each cell's first rank.  A source is off its target
    by about its longest document, or by a document of its last tier where that can make up for the rest.
    """
    size = word_count(F.col("text") if text is None else text)
    step = F.when(F.col("size") < 64, F.col("size")).otherwise(F.floor(16 * F.log2(F.col("size").cast("double"))) - 32)
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("-"))  # joins on plain equality, null included
    rows = cut(
        docs.select(F.col(id_col).alias("id"), name.alias("name"), size.alias("size"), *([F.col(keep).alias("kept")] if keep else []))
        .withColumn("class", step.cast("int"))
        .withColumn("hash", F.xxhash64("id", "size", F.lit(seed))),
        "mixing",
    )
    rows = rows.withColumn("cell", F.pmod("hash", F.lit(max(64, rows.count() // (50 * CELL_ROWS)))).cast("int"))
    cells = cut(rows.groupBy("name", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("size_sum"), F.max("size").alias("longest")), "mixing-cells")
    source = F.when(F.col("name") != "-", F.substring("name", 2, 1 << 30)).alias("source")
    targets = source_targets(cells.groupBy("name").agg(F.sum("size_sum").alias("source_size")).select(source, "source_size"), weights, most)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")))
    draw = (F.pmod(F.xxhash64("name", F.lit(seed + 1)), F.lit(OFFSETS)) + 0.5) / OFFSETS
    targets = cut(targets.withColumn("offset", draw), "mixing-targets")
    # a whole class is of one tier
    longest = F.max("longest").over(Window.partitionBy("name", "class"))
    tier = sum((F.when(longest <= share * F.col("target"), 1).otherwise(0) for share in TIERS), F.lit(0))
    tiers = cells.join(targets.select("name", "target"), "name").withColumn("tier", tier)
    first = F.sum("n").over(Window.partitionBy("name", "tier").orderBy("class", "cell")) - F.col("n")
    tiers = cut(tiers.select("name", "class", "cell", "n", "size_sum", "tier", first.alias("first")), "mixing-tiers")
    left = targets.select("name", "source", "source_size", "target", "offset", F.col("target").alias("open"), F.col("source_size").alias("rest"), F.lit(0.0).alias("base"))
    within = F.row_number().over(Window.partitionBy("name", "class", "cell").orderBy("size", "id"))
    rates = None
    for t in range(len(TIERS) + 1):
        rate = F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.col("open") / F.col("rest"), F.lit(float(most))))).otherwise(0.0)
        now = cut(left.withColumn("rate", rate).withColumn("tier", F.lit(t)), "mixing-rates")
        kept = now.select("name", "tier", "source", "source_size", "target", "offset", "base", "rate")
        rates = kept if rates is None else rates.union(kept)
        if t < len(TIERS):
            own = tiers.where(F.col("tier") == t)
            few = own.count() <= BROADCAST_ROWS  # their cells, as a rule a small part of all
            sent = own.select("name", "class", "cell", "first")
            # first rows, by their cells; then what they take
            ranked = rows.select("name", "class", "cell", "size", "id").join(F.broadcast(sent) if few else sent, ["name", "class", "cell"]).withColumn("rank", F.col("first") + within)
            took = ranked.join(now.select("name", "base", "rate", "offset"), "name").groupBy("name").agg(F.sum(F.col("size") * _crossed(most)).alias("took"))
            held = own.groupBy("name").agg(F.sum("n").alias("rows"), F.sum("size_sum").alias("words"))
            zero = lambda c: F.coalesce(F.col(c), F.lit(0))
            left = now.join(took, "name", "left").join(held, "name", "left").select("name", "source", "source_size", "target", "offset", (F.col("open") - zero("took")).alias("open"), (F.col("rest") - zero("words")).alias("rest"), (F.col("base") + zero("rows") * F.col("rate")).alias("base"))
    placed = tiers.select("name", "class", "cell", "tier", "first").join(rates, ["name", "tier"])
    ranked = rows.withColumn("within", within).join(placed, ["name", "class", "cell"]).withColumn("rank", F.col("first") + F.col("within"))
    return ranked.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _crossed(most).cast("int").alias("copies"), *(["kept"] if keep else []))


def _crossed(most: int) -> Column:
    """How many integers lie in a document's step of the prefix sum, moved by the offset."""
    upto = lambda rank: F.floor(F.col("base") + rank * F.col("rate") + F.col("offset"))
    return F.least(upto(F.col("rank")) - upto(F.col("rank") - 1), F.lit(most))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`copies` says."""
    quoted = lambda c: F.col(f"`{c}`")
    own = docs.select(quoted(id_col), quoted(source_col), quoted(options.pop("text_col", "text")).alias("text"), F.struct(*map(quoted, docs.columns)).alias("whole row"))
    taken = copies(own, id_col=id_col, source_col=source_col, keep="whole row", **options)
    return taken.where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("kept.*")
