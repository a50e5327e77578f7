"""Moran statistics over an edge list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trend import benjamini_hochberg


def row_standardised(edges: DataFrame, ids: DataFrame | None = None, unit: str = "unit_id") -> DataFrame:
    """(i, j, w): weight 1 over the number of neighbours within the retained ids; an island has no row."""
    e = edges
    if ids is not None:
        k = ids.select(F.col(unit).alias("_k"))
        e = e.join(k, e.i == k["_k"], "left_semi").join(k, e.j == k["_k"], "left_semi")
    return e.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("i")))


def global_moran(values: DataFrame, weights: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: n, s0, I and its expectation; I is NULL for constant values or no weights."""
    mean = values.agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    z = values.join(F.broadcast(mean)).select(F.col(unit).alias("u"), (F.col(value) - F.col("_m")).alias("z"))
    a, b = z.select(F.col("u").alias("i"), F.col("z").alias("zi")), z.select(F.col("u").alias("j"), F.col("z").alias("zj"))
    top = weights.join(a, "i").join(b, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0"))
    den = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.count(F.lit(1)).alias("n"))
    out = top.join(F.broadcast(den))
    i = F.when((F.col("s0") > 0) & (F.col("den") > 0), F.col("n") / F.col("s0") * F.col("num") / F.col("den"))
    return out.select("n", "s0", i.alias("moran_i"), (-1.0 / (F.col("n") - 1)).alias("expected"))


def local_moran(values: DataFrame, weights: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, z, lag, local_i, quadrant): z by the population deviation, lag the weighted mean of the neighbours; islands have NULL lag."""
    s = values.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = values.join(F.broadcast(s)).select(F.col(unit).alias("u"), F.try_divide(F.col(value) - F.col("_m"), F.col("_s")).alias("z"))
    lag = weights.join(z.select(F.col("u").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    out = z.join(lag, z.u == lag.i, "left").drop("i")
    side = lambda c: F.when(F.col(c) > 0, "H").otherwise("L")
    return out.select(F.col("u").alias(unit), "z", "lag", (F.col("z") * F.col("lag")).alias("local_i"), F.when(F.col("lag").isNotNull(), F.concat(side("z"), side("lag"))).alias("quadrant"))


def _dense(values: pd.DataFrame, edges: pd.DataFrame, unit: str, value: str):
    v = values.sort_values(unit).reset_index(drop=True)
    at = {u: k for k, u in enumerate(v[unit])}
    near: list[list[int]] = [[] for _ in at]
    for i, j in zip(edges["i"], edges["j"], strict=True):
        if i in at and j in at:
            near[at[i]].append(at[j])
    return v[unit].tolist(), v[value].to_numpy(float), [sorted(x) for x in near]


def _within(edges: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """The edges between the units."""
    out = edges.select("i", "j")
    for end in ("i", "j"):
        out = out.join(units.select(F.col(unit).alias(end)), end, "left_semi")
    return out


def moran_permutation(values: DataFrame, edges: DataFrame, unit: str, value: str, permutations: int = 9999, seed: int = 20260822, most_units: int = 5000, most_degree: int = 100) -> dict:
    """Global I with a two-sided permutation p about its expectation. Units are a dimension: more than ``most_units``, or than ``most_degree`` neighbours a unit, raise."""
    got = values.select(unit, value).limit(most_units + 1).toPandas()
    if len(got) > most_units:
        raise ValueError(f"over {most_units} units")
    pairs = _within(edges, values.select(unit), unit).limit(most_units * most_degree + 1).toPandas()
    if len(pairs) > most_units * most_degree:
        raise ValueError(f"over {most_degree} neighbours a unit")
    _, x, near = _dense(got, pairs, unit, value)
    n, keep = len(x), [k for k, v in enumerate(near) if v]
    z = x - x.mean()
    if not keep or not (z**2).sum():
        return {"moran_i": None, "p": None, "status": "undefined"}
    rows = np.concatenate([[k] * len(near[k]) for k in keep])
    cols = np.concatenate([near[k] for k in keep])
    w = np.concatenate([[1 / len(near[k])] * len(near[k]) for k in keep])
    stat = lambda y: n / len(keep) * (w * y[rows] * y[cols]).sum() / (y @ y)
    i0, e = stat(z), -1 / (n - 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    hit = sum(abs(stat(rng.permutation(z)) - e) >= abs(i0 - e) - 1e-15 for _ in range(permutations))
    return {"moran_i": float(i0), "p": float((1 + hit) / (1 + permutations)), "status": "ok"}


def local_moran_permutation(values: DataFrame, edges: DataFrame, unit: str, value: str, permutations: int = 9999, seed: int = 20260822, alpha: float = 0.05, most_units: int = 5000) -> DataFrame:
    """Adds raw_p, bh_q and class to the local statistic; more than ``most_units`` units raise, since every task draws from all of them.

    Neighbours are drawn without replacement from the others; p is that of the
    smaller tail plus one, not doubled. Each unit has a stream of its own, seeded by
    (seed, its rank), so units are independent tasks.
    """
    w = row_standardised(edges)
    loc = local_moran(values, w, unit, value)
    degree = edges.groupBy(F.col("i").alias(unit)).agg(F.count(F.lit(1)).alias("degree"))
    order = [r for r in loc.select(unit, "z").orderBy(unit).limit(most_units + 1).collect()]
    if len(order) > most_units:
        raise ValueError(f"over {most_units} units")
    zs = np.array([r["z"] for r in order], float)
    ranks = loc.sparkSession.createDataFrame([(r[unit], k) for k, r in enumerate(order)], f"`{unit}` {dict(loc.dtypes)[unit]}, _rank long")
    ranked = loc.join(degree, unit, "left").join(ranks, unit)
    kind = dict(values.dtypes)[unit]

    def run(batches):
        for b in batches:
            p = []
            for r in b.itertuples():
                if not r.degree or np.isnan(r.degree):
                    p.append(None)
                    continue
                rng = np.random.Generator(np.random.PCG64([seed, int(r._2)]))
                others = np.delete(zs, int(r._2))
                k = int(r.degree)
                above, left, most = 0, permutations, 1 + 2_000_000 // len(others)  # at a time, so that memory is bounded; the stream is the same
                while left:
                    draws = np.argpartition(rng.random((min(left, most), len(others))), k - 1, axis=1)[:, :k]
                    above += int((r.z * others[draws].mean(axis=1) >= r.local_i).sum())
                    left -= min(left, most)
                p.append((1 + min(above, permutations - above)) / (1 + permutations))
            yield pd.DataFrame({"u": b["u"], "raw_p": pd.Series(p, dtype="float64", index=b.index)})

    ps = ranked.select(F.col(unit).alias("u"), "_rank", "z", "local_i", "degree").mapInPandas(run, f"u {kind}, raw_p double")
    both = loc.join(ps, loc[unit] == ps["u"], "left").drop("u")
    tested = benjamini_hochberg(both.where("raw_p is not null"), "raw_p", alpha=alpha).select(F.col(unit).alias("_u"), "bh_q", "bh_rejected")
    out = both.join(tested, both[unit] == tested["_u"], "left").drop("_u")
    return out.withColumn("class", F.when(F.col("lag").isNull(), "island").when(F.col("bh_rejected"), F.col("quadrant")).otherwise("NS"))


def lisa_class(local: DataFrame, p: str = "raw_p", unit: str = "unit_id", alpha: float = 0.05) -> DataFrame:
    """Class of each unit from given p values: HH, LL, HL, LH only if BH rejects; islands are labelled."""
    tested = benjamini_hochberg(local.where(F.col(p).isNotNull()), p, alpha=alpha).select(F.col(unit).alias("_u"), "bh_q", "bh_rejected")
    out = local.join(tested, local[unit] == tested["_u"], "left").drop("_u")
    return out.withColumn("class", F.when(F.col("lag").isNull(), "island").when(F.col("bh_rejected"), F.col("quadrant")).otherwise("NS"))
