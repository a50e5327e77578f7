"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule goes to the source on whose share of [0, 1) the point
frac(k * golden ratio) falls. Slots are ranked within their source, and the
r-th takes the source's r-th block of ``block_words`` words, the documents of a
source being laid end to end in shuffled order. After its last block a source
begins anew, ``max_epochs`` times at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums
from .scratch import Scratch

#: floor(2**32 / golden ratio) made odd: multiples of it modulo 2**32 are the golden-ratio points, exact in integers.
GOLDEN = 2654435769
RING = 1 << 32
#: Cells of [0, 1) by which points and shares meet.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and empty count 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn. Targets share
    the total by weight; one over ``max_epochs`` times its source's size stops
    there and the excess goes to the others by weight. In the order of
    size / weight the stopped ones come first, so one pass of running sums finds
    the level at which the rest share. Sizes all 0 give targets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    level = F.try_divide(
        F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), zero),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero),
    )
    rows = rows.withColumn("_level", level)
    free = F.min(F.when(F.col("cap") / F.col("weight") > F.col("_level"), F.struct(F.col("cap") / F.col("weight"), F.col("_level")))).over(everything)
    share = free["_level"]
    return rows.withColumn("target", F.when(share.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * share))).select("source", "source_size", "weight", "target")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**32, in two halves of 16 bits so that no product passes 2**49."""
    low = F.pmod(slot, F.lit(RING))
    high = F.pmod(F.shiftright(low, 16) * GOLDEN, F.lit(1 << 16))
    return F.pmod(high * (1 << 16) + F.pmod(low, F.lit(1 << 16)) * GOLDEN, F.lit(RING))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(source, slot, rank) of ``slots`` slots over (source, target): rank counts from 0 within a source in slot order.

    Points and shares meet by equality of a cell of [0, 1), then by range, so
    that neither side is broadcast or crossed.
    """
    spark = shares.sparkSession
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    edge = F.round(F.sum("target").over(up_to) / total * RING).cast("long")
    spans = shares.where("target > 0").withColumn("_hi", edge).withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0).cast("long")))
    width = RING // CELLS
    spans = spans.where("_lo < _hi").select("source", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    drawn = points.join(spans, "cell").where("u >= _lo and u < _hi").select("source", "slot")
    chunk = F.floor(F.col("slot") / CELLS)
    return running_sums(drawn, ["source"], F.floor(chunk / 1024), chunk, [F.col("slot")], F.lit(1), "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, block_words: int = 64, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: id_col, source, size, source_size, target, taken.

    ``size`` counts words (null text: 0), ``taken`` those that the mix takes,
    repeats counted: at most ``max_epochs`` times the size. A source's taken
    words differ from its target by a few blocks. Null is a source of its own.
    Rows equal in id and text lie next to each other in the shuffled order and
    each keep a row. The order comes from a seeded hash, so reruns agree.
    An empty table gives an empty table; further columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    at = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), at.alias("at")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = scratch.save(targets(sizes, weights, max_epochs))
    # a source's last block may be short: slots are shared by the blocks that the target takes, not by its words
    blocks = F.ceil(F.col("source_size") / block_words)
    by_blocks = shares.where("source_size > 0").select("source", (F.col("target") * blocks / F.col("source_size")).alias("target"))
    slots = int(round(by_blocks.agg(F.sum("target")).first()[0] or 0.0))

    high = F.shiftrightunsigned("at", 54)
    low = F.shiftrightunsigned("at", 44)
    numbered = sized.groupBy("id", "source", "size", "at").agg(F.count(F.lit(1)).alias("copies"))
    laid = running_sums(numbered, ["source"], high, low, [F.col("at"), F.col("id"), F.col("size")], F.col("size") * F.col("copies"), "start")
    laid = laid.select("id", "source", "size", "at", F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth", "_"), "start")
    laid = scratch.save(laid.withColumn("start", F.col("start") + F.col("nth") * F.col("size")).drop("_"))

    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    pieces = laid.where("size > 0").select("id", "source", "at", "nth", "size", "start", F.explode(F.sequence(first, last)).alias("block"))
    words_in = F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = pieces.select("id", "source", "at", "nth", "size", "block", words_in.alias("words"))

    ranked = schedule(by_blocks, slots).alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    taken_blocks = ranked.where(F.col("rank") < blocks * max_epochs).select(F.col("s.source").alias("source"), F.pmod(F.col("rank"), blocks).alias("block")).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    met = pieces.alias("p").join(taken_blocks.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    per_doc = met.groupBy(*[F.col(f"p.{c}").alias(c) for c in ("id", "source", "at", "nth", "size")]).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))

    key = ["id", "source", "at", "nth", "size"]
    all_docs = laid.alias("a").join(per_doc.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    all_docs = all_docs.select(*[F.col(f"a.{c}").alias(c) for c in key], F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    out = all_docs.alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select(F.col("id").alias(id_col), F.col("d.source").alias("source"), F.col("size"), F.col("source_size").cast("long").alias("source_size"), "target", "taken", F.col("at").alias("at"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as the mix takes it: its taken words over its size, rounded.

    Rows without words never appear. Of rows equal in id, source and text each
    appears as often as the others, by what is taken of them together. An empty table gives an
    empty table; any further columns, whatever their names, stay as they are.
    """
    id_col, text_col, seed = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("seed", 42)
    source_col = how.get("source_col", "source")
    plan = mix(docs, **how).where("taken > 0").groupBy(F.col(id_col).alias("id"), "source", "size", "at").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    times = plan.select("id", "source", "at", F.round(F.col("taken") / (F.col("size") * F.col("rows"))).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("at"))
    met = rows.alias("d").join(times.alias("t"), (F.col("d.at") == F.col("t.at")) & F.col("d.id").eqNullSafe(F.col("t.id")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    return met.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
