"""Embedding near-dedup by NN-descent.

Equal vectors are one node. A neighbour list starts from neighbours in a few
sorted orders of random-hyperplane codes and is refined by joining the
neighbours of each node with each other: a list keeps its best ``k``. Where a
list is saturated, all of its entries being at or above the threshold, it is
enlarged by the best ``k`` of other groups of linked nodes; every link found
joins its groups, whether the lists keep it or not, and rounds go on until
none joins two. The links within a group are counted whole, in blocks. An
audit of a bounded set of nodes of every group size against all rows measures
recall by node; while it is under the target the search is widened by further
orders with longer windows, and in the end all rows of a label are compared in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _grouped(batches, key_of):
    """Joins sorted batches so that each yielded one holds whole groups; a list column stays a list column."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = key_of(table)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if not len(change):
            held = table
            continue
        cut = int(change[-1]) + 1
        yield table.slice(0, cut).combine_chunks(), keys[:cut]
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), key_of(held)


def valid_nodes(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, dim, v, node, copies): distinct unit vectors of the rows that may link; ``node`` is the least id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    fine = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(label_col).alias("label"), v.alias("raw"), F.col(id_col).alias("id")).withColumn("top", F.aggregate("raw", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).where("top > 0")
    return rows.groupBy("label", "raw").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("top").alias("top"))


def _unit(rows: DataFrame) -> DataFrame:
    scaled = F.transform("raw", lambda x: x / F.col("top"))  # so that squares neither overflow nor vanish
    rows = rows.select("label", "node", "copies", scaled.alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("label", F.size("s").alias("dim"), "node", "copies", F.transform("s", lambda x: x / F.col("norm")).alias("v"))


def _seeded_edges(nodes: DataFrame, orders: int, reach: int, seed: int, code_bits: int = 20) -> DataFrame:
    """(a, b, cos) of nodes near each other in sorted orders of hyperplane codes, of the same label and length."""

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, vs = batch.column(1).to_numpy(), batch.column(3)
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                m = _matrix(vs.take(pa.array(pick)))
                if d not in planes:
                    planes[d] = np.random.default_rng(seed + int(d)).standard_normal((int(d), orders * code_bits))
                bits = (m @ planes[d] > 0).reshape(len(pick), orders, code_bits)
                codes = bits @ (1 << np.arange(code_bits - 1, -1, -1, dtype=np.int64))
                part = batch.take(pa.array(pick))
                for t in range(orders):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(np.full(len(pick), t, np.int32)), pa.array(codes[:, t])], ["label", "dim", "node", "v", "t", "code"])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    codes = nodes.select("label", "dim", "node", "v").mapInArrow(coded, f"label {kinds['label']}, dim int, node {kinds['node']}, v array<double>, t int, code long")
    lined = codes.repartitionByRange("t", "label", "dim", "code", F.xxhash64("node")).sortWithinPartitions("t", "label", "dim", "code", F.xxhash64("node"))

    def near(batches):
        tail = None  # the last rows seen, so that windows cross batches and no more than a batch is held
        for batch in batches:
            table, old = pa.Table.from_batches([batch]), 0 if tail is None else tail.num_rows
            table = (table if tail is None else pa.concat_tables([tail, table])).combine_chunks()
            node, v = table.column("node").to_numpy(), table.column("v").combine_chunks()
            for s, e in _bounds(_ids(table.column("t"), table.column("label"), table.column("dim"))):
                m, ids = _matrix(v.slice(s, e - s)), node[s:e]
                for step in range(1, min(reach, len(ids) - 1) + 1):
                    lo = max(step, old - s)  # pairs whose second row is new
                    if lo < len(ids):
                        cos = np.einsum("ij,ij->i", m[lo - step : len(ids) - step], m[lo:])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo - step : len(ids) - step]), pa.array(ids[lo:]), pa.array(cos)], ["a", "b", "cos"])
            tail = table.slice(max(0, table.num_rows - reach))

    return lined.mapInArrow(near, f"a {kinds['node']}, b {kinds['node']}, cos double")


def _orders_for(nodes: DataFrame, threshold: float, orders: int, reach: int, code_bits: int = 20, missed: float = 0.002) -> tuple[int, int]:
    """(orders, bits of a code) for the largest label: a bit parts a pair at the threshold by its angle over pi.

    Such a pair meets in a window if its codes share the bits that leave about ``reach`` rows; so many orders leave ``missed`` of the pairs.
    """
    n = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    shared = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** max(0.0, math.log2(n / reach))
    need = math.ceil(math.log(missed) / math.log(1 - shared)) if 0 < shared < 1 else orders
    return max(orders, need), min(62, max(code_bits, math.ceil(math.log2(n + 1)) + 6))


def _ids(*columns) -> np.ndarray:
    """An integer for each run of equal rows."""
    change = None
    for c in columns:
        x = c.to_numpy()
        d = x[1:] != x[:-1]
        change = d if change is None else change | d
    return np.concatenate([[0], np.cumsum(change)]) if len(columns[0]) else np.empty(0, np.int64)


def _bounds(keys: np.ndarray):
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False)) if len(keys) else []


def _lists(edges: DataFrame, k: int, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cos, ra, rb, other, kept) of the edges taken both ways, with the groups of both ends.

    ``kept`` are the k nearest of each node and, if all of these link, the k
    nearest of other groups too; links to another group stay whether kept or not.
    """
    both = edges.select("a", "b", "cos").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).where("a <> b")
    both = both.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    both = both.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").withColumn("other", F.col("ra") != F.col("rb"))
    near = lambda *by: F.row_number().over(Window.partitionBy("a", *by).orderBy(F.desc("cos"), "b")) <= k
    full = F.sum((F.col("cos") >= threshold).cast("long")).over(Window.partitionBy("a")) >= k
    kept = near() | (near("other") & F.col("other") & full)
    return both.withColumn("kept", kept).where(F.col("kept") | (F.col("other") & (F.col("cos") >= threshold)))


def _merged(found: DataFrame, roots: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """(node, root) after the links found between groups join these; None if there is no such link."""
    links = scratch.save(found.where(F.col("other") & (F.col("cos") >= threshold)).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if links.isEmpty():
        return None
    joined = connected_components(links, scratch).withColumnRenamed("node", "root")
    kind = dict(roots.dtypes)["root"]
    return scratch.save(roots.join(joined, "root", "left").select("node", F.coalesce("component", "root").cast(kind).alias("root")))


def _descend(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(a, b, cos) of pairs of neighbours of the same node; a pivot meets its list and as many of those that list it, of its own group and of others."""
    lists = lists.where("kept")
    back = lists.select(F.col("b").alias("pivot"), F.col("a").alias("x"), "cos", "other")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("pivot", "other").orderBy(F.desc("cos"), "x"))).where(F.col("r") <= k).select("pivot", "x")
    member = lists.select(F.col("a").alias("pivot"), F.col("b").alias("x")).union(back).distinct()
    rows = member.join(nodes.select(F.col("node").alias("x"), "v"), "x").repartition("pivot").sortWithinPartitions("pivot", "x")
    kind = dict((f.name, f.dataType.simpleString()) for f in nodes.schema)["node"]

    def joined(batches):
        for table, keys in _grouped(batches, lambda t: t.column("pivot").to_numpy()):
            x, m = table.column("x").to_numpy(), None
            v = table.column("v").combine_chunks()
            widths = np.diff(v.offsets.to_numpy())
            for w in np.unique(widths):
                pick = np.flatnonzero(widths == w)
                m, ids, pivots = _matrix(v.take(pa.array(pick))), x[pick], keys[pick]
                out_a, out_b, out_c = [], [], []
                for step in range(1, 4 * k):
                    same = np.flatnonzero(pivots[step:] == pivots[:-step]) if step < len(pivots) else np.empty(0, np.int64)
                    if not len(same):
                        break
                    cos = np.einsum("ij,ij->i", m[same], m[same + step])
                    out_a.append(ids[same])
                    out_b.append(ids[same + step])
                    out_c.append(cos)
                if out_a:
                    frame = pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "cos": np.concatenate(out_c)}).drop_duplicates(["a", "b"])
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return rows.select("pivot", "x", "v").mapInArrow(joined, f"a {kind}, b {kind}, cos double")


def _in_blocks(nodes: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(root, lo, hi, part, node, copies, v): the nodes of each group in pairs of blocks, each pair together and in order."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    rows = roots.join(sizes, "root").join(nodes.select("node", "copies", "v"), "node")
    # blocks grow with the root of the group, so that neither one task nor the number of copies of a row does more
    parts = F.ceil(F.col("n") / F.least(F.greatest(F.sqrt(F.col("n") * 16), F.lit(128)), F.lit(block))).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.col("mine").alias("part"), "node", "copies", "v")
    return rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "part", "node")


def _all_links(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): links with the same components as all pairs of a label and length at or above the threshold; a forest for each pair of blocks."""
    least = nodes.groupBy("label", "dim").agg(F.min("node").alias("root"))
    dealt = _in_blocks(nodes, nodes.join(least, ["label", "dim"]).select("node", "root"), block)
    kind = dict((f.name, f.dataType.simpleString()) for f in nodes.schema)["node"]

    def linked(batches):
        for table, keys in _grouped(batches, lambda t: _ids(t.column("root"), t.column("lo"), t.column("hi"))):
            part, node, lo = table.column("part").to_numpy(), table.column("node").to_numpy(), table.column("lo").to_numpy()
            v = table.column("v").combine_chunks()
            for s, e in _bounds(keys):
                m, ids, left = _matrix(v.slice(s, e - s)), node[s:e], part[s:e] == lo[s]
                near = np.zeros((e - s, e - s), bool)
                if left.all():
                    near = m @ m.T >= threshold
                    np.fill_diagonal(near, False)
                else:
                    across = m[left] @ m[~left].T >= threshold
                    near[np.ix_(left, ~left)], near[np.ix_(~left, left)] = across, across.T
                waiting = near.any(axis=1)
                heads, tails = [], []
                while waiting.any():
                    front = np.flatnonzero(waiting)[:1]
                    waiting[front] = False
                    while len(front):
                        met = np.flatnonzero(near[front].any(axis=0) & waiting)
                        if len(met):
                            heads.append(ids[front[near[np.ix_(front, met)].argmax(axis=0)]])
                            tails.append(ids[met])
                            waiting[met] = False
                        front = met
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], ["a", "b"])

    return dealt.mapInArrow(linked, f"a {kind}, b {kind}")


def _counts_in_groups(nodes: DataFrame, roots: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links) for nodes of a group: the copies of the other nodes at or above the threshold; in pairs of blocks."""
    dealt = _in_blocks(nodes, roots, block)
    kind = dict((f.name, f.dataType.simpleString()) for f in nodes.schema)["node"]

    def compared(batches):
        for table, keys in _grouped(batches, lambda t: _ids(t.column("root"), t.column("lo"), t.column("hi"))):
            part, node, copies = table.column("part").to_numpy(), table.column("node").to_numpy(), table.column("copies").to_numpy()
            v, lo = table.column("v").combine_chunks(), table.column("lo").to_numpy()
            ids, links = [], []
            for s, e in _bounds(keys):
                m, own = _matrix(v.slice(s, e - s)), copies[s:e]
                left = part[s:e] == lo[s]
                if left.all():
                    near = m @ m.T >= threshold
                    np.fill_diagonal(near, False)
                    ids.append(node[s:e])
                    links.append(near @ own)
                else:
                    near = m[left] @ m[~left].T >= threshold
                    ids += [node[s:e][left], node[s:e][~left]]
                    links += [near @ own[~left], near.T @ own[left]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])

    return dealt.mapInArrow(compared, f"node {kind}, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit_recall(nodes: DataFrame, roots: DataFrame, threshold: float, sample: int) -> float:
    """The least recall of any class of nodes, 1 if no node asked has links; classes are by the power of two of the true links.

    A node's recall is the share of its true links, each distinct vector once,
    that lie in its group; a class's the mean over its nodes that have links.
    About ``sample`` nodes of each power of two of the group size found are
    asked, by hash, each weighted by how many it stands for; their vectors go
    to every task, which counts against its own rows.
    """
    placed = nodes.join(roots, "node").join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").withColumn("stratum", F.floor(F.log2("n")).cast("int"))
    totals = {r["stratum"]: r["count"] for r in placed.groupBy("stratum").count().collect()}
    ring, some = 1 << 30, F.lit(False)
    for stratum, n in totals.items():
        some = some | ((F.col("stratum") == stratum) & (F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(ring)) < int(ring * min(1.0, sample / n))))
    asked = placed.where(some).select("node", "label", "dim", "v", "root", "stratum").collect()
    if not asked:
        return 1.0
    taken: dict = {}
    groups: dict = {}
    for r in asked:
        taken[r["stratum"]] = taken.get(r["stratum"], 0) + 1
        for held, x in zip(groups.setdefault((r["label"], r["dim"]), ([], [], [])), (r["node"], r["v"], r["root"]), strict=True):
            held.append(x)
    groups = {k: tuple(map(np.array, x)) for k, x in groups.items()}
    kind = dict((f.name, f.dataType.simpleString()) for f in nodes.schema)["node"]

    def count(batches):
        for batch in batches:
            t = batch.to_pandas()
            for key, own in t.groupby(["label", "dim"]):
                if key in groups:
                    ids, vs, of = groups[key]
                    links, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    for at in range(0, len(own), 1024):
                        some_rows = own.iloc[at : at + 1024]
                        near = np.stack(some_rows["v"].to_numpy()) @ vs.T >= threshold
                        near &= some_rows["node"].to_numpy()[:, None] != ids[None, :]
                        links += near.sum(axis=0)
                        found += (near & (some_rows["root"].to_numpy()[:, None] == of[None, :])).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(found)], ["node", "links", "found"])

    rows = nodes.join(roots, "node").select("label", "dim", "node", "v", "root")
    got = {r[0]: (r[1], r[2]) for r in rows.mapInArrow(count, f"node {kind}, links long, found long").groupBy("node").agg(F.sum("links"), F.sum("found")).collect()}
    share: dict = {}
    for r in asked:
        links, found = got.get(r["node"], (0, 0))
        if links:
            weight, held = totals[r["stratum"]] / taken[r["stratum"]], share.setdefault(links.bit_length(), [0.0, 0.0])
            held[0] += weight * found / links
            held[1] += weight
    return min((a / b for a, b in share.values()), default=1.0)


def embedding_dedup(rows: DataFrame, threshold: float = 0.98, k: int = 8, rounds: int = 2, most_rounds: int = 6, orders: int = 8, reach: int = 6, block: int = 2048, audit: int = 256, target_recall: float = 0.95, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of ``rows``.

    Vectors of one label with cosine >= ``threshold`` in double precision link;
    those of another label, without label, or that are null, empty, zero or hold
    null or non-finite components link with nothing: n_links 0, their own id as
    component. Vectors of different length do not link. A null id links with nothing and is kept.
    Equal vectors link at cosine 1 and are one node with a number of copies.
    Links found are true; the search may miss some, which the audit measures by
    node and group size. Under ``target_recall`` the search is widened, with
    twice the window each time and fresh orders, up to ``most_rounds`` -
    ``rounds`` times; if that is not enough all pairs of a label are compared.
    Repeated rows count as vectors of their own; an empty table gives an empty table.
    """
    scratch = Scratch(rows.sparkSession, "embed")
    classes = scratch.save(valid_nodes(rows, id_col, vec_col, label_col))
    nodes = scratch.save(_unit(classes))
    roots = scratch.save(nodes.select("node", F.col("node").alias("root")))
    orders, bits = _orders_for(nodes, threshold, orders, reach)
    lists = scratch.save(_lists(_seeded_edges(nodes, orders, reach, seed, bits), k, roots, threshold))
    joined = _merged(lists, roots, threshold, scratch)
    roots = roots if joined is None else joined
    wider = 0
    while True:
        done = 0
        while True:
            fresh = scratch.save(_lists(_descend(nodes, lists, k).union(lists.where("kept").select("a", "b", "cos")), k, roots, threshold))
            scratch.drop(lists)
            lists, done = fresh, done + 1
            joined = _merged(lists, roots, threshold, scratch)
            if joined is not None:
                roots = joined
            elif done >= (1 if wider else rounds):
                break
        if audit_recall(nodes, roots, threshold, audit) >= target_recall:
            break
        if wider >= most_rounds - rounds:
            exact = connected_components(_all_links(nodes, threshold, block), scratch)
            kind = dict(nodes.dtypes)["node"]
            roots = scratch.save(nodes.select("node").join(exact, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("root")))
            break
        wider += 1
        more = _seeded_edges(nodes, orders, reach << wider, seed + 1_000_003 * wider, bits)
        fresh = scratch.save(_lists(more.union(lists.where("kept").select("a", "b", "cos")), k, roots, threshold))
        scratch.drop(lists)
        lists = fresh
        joined = _merged(lists, roots, threshold, scratch)
        roots = roots if joined is None else joined
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = scratch.save(roots.join(sizes, "root").select("node", "root"))
    counts = scratch.save(_counts_in_groups(nodes, linked, threshold, block))
    about = nodes.select("node", F.col("copies")).join(linked, "node", "left").join(counts, "node", "left")
    about = about.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    about = scratch.save(classes.select("label", "raw", "node").join(about, "node").drop("node"))
    keyed = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("l"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("r"))
    met = keyed.join(about, (keyed["l"] == about["label"]) & (keyed["r"] == about["raw"]) & keyed["id"].isNotNull(), "left")
    comp = F.coalesce("component_id", "id")
    return met.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
