"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are
sorted into integer names; then adjacent names are paired and the distinct
pairs sorted into names, until each document has a single one. Equal names mean
equal texts, with no chance of a collision: a 64-bit hash only routes blocks,
and the blocks that share one are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cells into which names are dealt; a name is rank * CELLS + cell.
CELLS = 1 << 16


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty. ``lower`` does just that where all is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def _blocks(data: Column, size: int) -> Column:
    """The blocks of a binary column, one empty block if it is empty."""
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(d) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(d, i * size + 1, F.lit(size)))
    return F.element_at(F.transform(F.array(data), cut), 1)  # data is computed once


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows of ``by`` with an integer ``name`` over 0: sorted within cells of the key's hash, so no task sees all."""
    cell = F.pmod(F.xxhash64(*by), F.lit(CELLS))
    ranked = keys.withColumn("_cell", cell).withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*by)))
    return ranked.select(*by, (F.col("_rank").cast("long") * CELLS + F.col("_cell")).alias("name"))


def exact_classes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """(id_col, text_sha256, level, name, copies): equal (level, name) if and only if the normalised texts are equal.

    Null texts count as empty, null ids stay. Rows equal in id and text are one
    row with their number in ``copies``. Other columns of ``docs`` are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).cast("binary").alias("data"))
    cut = _blocks(F.col("data"), block_bytes)

    # 1. the distinct blocks, with those that share a hash told apart by their place in sorted order
    by_hash = source.select(F.explode(cut).alias("block")).groupBy(F.xxhash64("block").alias("h")).agg(F.collect_set("block").alias("blocks"))
    distinct = by_hash.select("h", F.posexplode(F.sort_array("blocks")).alias("nth", "block"), (F.size("blocks") > 1).alias("shared"))
    distinct = scratch.save(distinct.select("h", "nth", F.when(F.col("shared"), F.col("block")).alias("told_by")))
    names = _named(distinct.select("h", "nth"), ["h", "nth"])

    # 2. the documents as sequences of names
    hashed = source.select("id", F.sha2("data", 256).alias("sha"), F.transform(cut, lambda b: F.xxhash64(b)).alias("hs"))
    docs_of = scratch.save(hashed.groupBy("id", "sha").agg(F.first("hs").alias("hs"), F.count(F.lit(1)).alias("copies")))
    items = docs_of.select("id", "sha", "copies", F.size("hs").alias("len"), F.posexplode("hs").alias("pos", "h"))
    alone = distinct.where("told_by is null").join(names, ["h", "nth"]).select("h", "name")
    seq = items.join(alone, "h").select("id", "sha", "copies", "len", "pos", "name")
    if not distinct.where("told_by is not null").isEmpty():
        told = distinct.where("told_by is not null").join(names, ["h", "nth"]).select("h", F.col("told_by").alias("block"), "name")
        placed = source.select("id", F.sha2("data", 256).alias("sha"), F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block"))
        at = placed.join(told, ["h", "block"]).select("id", "sha", "pos", "name").distinct()
        same = (items["sha"] == at["sha"]) & (items["pos"] == at["pos"]) & items["id"].eqNullSafe(at["id"])
        seq = seq.unionByName(items.join(at, same).select(items["id"], items["sha"], "copies", "len", items["pos"], "name"))
    seq = scratch.save(seq)

    # 3. pairs of names to names, until one is left
    longest = seq.agg(F.max("len")).first()[0] or 1
    done, level = seq.where("len = 1").select("id", "sha", "copies", F.lit(0).alias("level"), "name"), 0
    finished, live, spent = [done], seq.where("len > 1"), [distinct, docs_of]
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(0))
        pairs = live.groupBy("id", "sha", "copies", F.floor((F.col("len") + 1) / 2).cast("int").alias("len"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("left"), side(1).alias("right"))
        pairs = scratch.save(pairs)
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"])
        live = scratch.save(pairs.join(names, ["left", "right"]).select("id", "sha", "copies", "len", "pos", "name"))
        scratch.drop(pairs)
        finished.append(live.where("len = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name"))
        live = live.where("len > 1")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    scratch.drop(*spent)
    return out.select(F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), "level", "name", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest id
    stays. Of rows equal in id and text one stays. A null id never stays where
    its group holds another; in a group of null ids alone keep_id is null and
    one row stays. An empty table gives an empty table; further columns of
    ``docs`` do not matter.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "exact")
    classes = exact_classes(docs, scratch, id_col, text_col, block_bytes)
    # written, so that both sides of the join are plain shuffles and a large group can be split among tasks
    groups = scratch.save(classes.groupBy("level", "name").agg(F.max(id_col).alias("keep_id"), F.sum("copies").alias("group_size")))
    rows = classes.join(groups, ["level", "name"]).select(id_col, "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_nth"))
    return rows.select(id_col, "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col("_nth") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with their columns: one row for each group of equal texts, that of the largest id.

    A null text counts as empty, a null id stays only where its group holds no
    other; of rows equal in id and text one stays. An empty table gives an empty
    table; any further columns, whatever their names, stay as they are.
    """
    found = exact_dedup(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias("id"), "keep_id", "kept", F.col("text_sha256").alias("sha"))
    sha = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), sha.alias("sha"))
    rows = rows.alias("r").join(found.where("kept").alias("f"), (F.col("r.sha") == F.col("f.sha")) & F.col("r.id").eqNullSafe(F.col("f.id")), "left_semi")
    if not found.where(~F.col("kept") & F.col("id").eqNullSafe(F.col("keep_id"))).isEmpty():
        rows = rows.dropDuplicates(["sha"])  # rows equal in id and text
    return rows.select("doc.*")
