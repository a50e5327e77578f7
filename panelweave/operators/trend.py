"""Sen slopes, studentised Mann-Kendall permutation, autocorrelation, false discovery rate."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_slopes(series: DataFrame, unit: list[str], x: str, y: str) -> DataFrame:
    """All pairs i < j of a unit's points with their slope and sign; a series is short by nature (years)."""
    a, b = series.select(*unit, F.col(x).alias("x1"), F.col(y).alias("y1")), series.select(*unit, F.col(x).alias("x2"), F.col(y).alias("y2"))
    met = a.join(b, unit).where("x1 < x2")
    return met.select(*unit, "x1", "x2", ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"), F.signum(F.col("y2") - F.col("y1")).alias("sign"))


def sen_slope(series: DataFrame, unit: list[str], x: str, y: str) -> DataFrame:
    return pair_slopes(series, unit, x, y).groupBy(*unit).agg(F.percentile("slope", 0.5).alias("sen_slope"), F.count(F.lit(1)).alias("pairs"))


def mk_components(series: DataFrame, unit: list[str], x: str, y: str, floor: float = 1e-12) -> DataFrame:
    """Mann-Kendall U, long-run variance, bandwidth and the studentised T of each unit.

    U is the mean sign over pairs; g the centred ECDF, 1 - 2 F(y); the variance
    4/9 + 8/(3n) sum over lags k <= b of g_i g_(i+k), with b the floor of n to the 1/3.
    """
    u = pair_slopes(series, unit, x, y).groupBy(*unit).agg(F.avg("sign").alias("u"))
    w = Window.partitionBy(*unit)
    ecdf = F.count(F.lit(1)).over(w.orderBy(y).rangeBetween(Window.unboundedPreceding, Window.currentRow)) / F.count(F.lit(1)).over(w)
    n = F.count(F.lit(1)).over(w)
    g = series.select(*unit, F.col(x).alias("x"), (1 - 2 * ecdf).alias("g"), n.alias("n")).withColumn("i", F.row_number().over(w.orderBy("x"))).withColumn("b", F.floor(F.pow(F.col("n"), F.lit(1.0 / 3))).cast("int"))
    lagged = g.select(*unit, F.col("i").alias("j"), F.col("g").alias("h"))
    prods = g.join(lagged, unit).where("j > i and j - i <= b").groupBy(*unit).agg(F.sum(F.col("g") * F.col("h")).alias("s"))
    sizes = g.groupBy(*unit).agg(F.max("n").alias("n"), F.max("b").alias("bandwidth"))
    out = u.join(sizes, unit).join(prods, unit, "left")
    var = F.lit(4.0 / 9) + 8.0 / (3 * F.col("n")) * F.coalesce("s", F.lit(0.0))
    return out.select(*unit, "n", "u", "bandwidth", var.alias("variance"), (F.sqrt("n") * F.col("u") / F.sqrt(F.greatest(var, F.lit(floor)))).alias("t"))


def studentised(y: np.ndarray, bandwidth: int, floor: float) -> np.ndarray:
    """T of each row of a matrix of series."""
    m, n = y.shape
    i, j = np.triu_indices(n, 1)
    u = np.sign(y[:, j] - y[:, i]).mean(axis=1)
    order = np.sort(y, axis=1)
    ecdf = np.stack([np.searchsorted(order[k], y[k], side="right") for k in range(m)]) / n
    g = 1 - 2 * ecdf
    s = sum((g[:, :-k] * g[:, k:]).sum(axis=1) for k in range(1, bandwidth + 1)) if bandwidth else 0.0
    var = 4.0 / 9 + 8.0 / (3 * n) * s
    return np.sqrt(n) * u / np.sqrt(np.maximum(var, floor))


def mk_permutation(series: DataFrame, unit: list[str], x: str, y: str, replications: int = 9999, seed: int = 20260822, floor: float = 1e-12) -> DataFrame:
    """Two-sided permutation p of each unit: (1 + those at least as extreme) / (1 + replications), studentised afresh each time.

    A permutation sorts random keys. Series with ties give a NULL p and status ties.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x)
        v = rows[y].to_numpy(float)
        n = len(v)
        b = int(math.floor(n ** (1.0 / 3)))
        key = {k: rows[k].iloc[0] for k in unit}
        if n < 3 or len(np.unique(v)) < n:
            return pd.DataFrame([{**key, "t": None, "extreme": None, "p": None, "status": "ties" if n >= 3 else "short"}])
        t0 = studentised(v[None, :], b, floor)[0]
        rng, hit, left = np.random.Generator(np.random.PCG64(seed)), 0, replications
        while left:
            k = min(left, 2048)
            t = studentised(v[np.argsort(rng.random((k, n)), axis=1, kind="stable")], b, floor)
            hit += int((np.abs(t) >= abs(t0)).sum())
            left -= k
        return pd.DataFrame([{**key, "t": t0, "extreme": hit, "p": (1 + hit) / (1 + replications), "status": "ok"}])

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.select(*unit, x, y).groupBy(*unit).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in unit) + ", t double, extreme long, p double, status string")


def mk_permutation_by_hash(series: DataFrame, unit: list[str], x: str, y: str, replications: int = 9999, seed: int = 20260822) -> DataFrame:
    """(unit, score, extreme, p): Mann-Kendall scores under permutations that sort an md5 of seed, replicate, unit and x.

    The same draws can be had in any engine. Replicates are tasks of their own,
    so the work of one unit is spread; a series is short by nature.
    """
    signs = lambda arr: F.aggregate(F.transform(arr, lambda v, i: F.aggregate(F.slice(arr, i + 2, F.size(arr)), F.lit(0), lambda acc, z: acc + F.signum(z - v).cast("int"))), F.lit(0), lambda a, b: a + b)
    text = lambda c: F.col(c).cast("string")
    in_order = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, y))), lambda z: z[y])
    keyed = series.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    keyed = keyed.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), text("_rep"), *map(text, unit), text(x)).cast("binary")))
    drawn = keyed.groupBy(*unit, "_rep").agg(signs(in_order("_key")).alias("_drawn"))
    seen = series.groupBy(*unit).agg(signs(in_order(x)).alias("score"))
    got = drawn.join(seen, unit).groupBy(*unit, "score").agg(F.count_if(F.abs("_drawn") >= F.abs("score")).alias("extreme"))
    return got.withColumn("p", (1 + F.col("extreme")) / F.lit(float(1 + replications)))


def sen_with_interval(series: DataFrame, unit: list[str], x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Median slope, intercept from medians, and the rank interval with the variance corrected for ties."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x)
        a, v = rows[x].to_numpy(float), rows[y].to_numpy(float)
        i, j = np.triu_indices(len(v), 1)
        slopes = np.sort((v[j] - v[i]) / (a[j] - a[i]))
        n, slope = len(v), float(np.median(slopes))
        _, ties = np.unique(v, return_counts=True)
        var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
        half = z * math.sqrt(var)
        up, low = min(int(round((len(slopes) + half) / 2)), len(slopes) - 1), max(int(round((len(slopes) - half) / 2)) - 1, 0)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in unit}, "sen_slope": slope, "intercept": float(np.median(v) - slope * np.median(a)), "low": slopes[low], "high": slopes[up]}])

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.select(*unit, x, y).groupBy(*unit).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in unit) + ", sen_slope double, intercept double, low double, high double")


def autocorrelation(series: DataFrame, unit: list[str], x: str, y: str, max_lag: int = 5, alpha: float = 0.05, detrend: bool = False, rank: bool = False) -> DataFrame:
    """(unit, lag, acf, exceeds): biased autocorrelation, of Sen residuals and of average ranks if asked; the bound is z over the root of n."""
    w = Window.partitionBy(*unit)
    rows = series.select(*unit, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if detrend:
        rows = rows.join(sen_slope(rows, unit, "x", "y").select(*unit, "sen_slope"), unit).withColumn("y", F.col("y") - F.col("sen_slope") * F.col("x")).drop("sen_slope")
    if rank:
        lo = F.rank().over(w.orderBy("y"))
        rows = rows.withColumn("y", (lo + (F.count(F.lit(1)).over(Window.partitionBy(*unit, "y")) - 1) / 2.0).cast("double"))
    centred = rows.withColumn("d", F.col("y") - F.avg("y").over(w))
    lags = [F.sum(F.col("d") * F.col(f"l{k}")) for k in range(1, max_lag + 1)]
    got = centred.withColumns({f"l{k}": F.lag("d", k).over(w.orderBy("x")) for k in range(1, max_lag + 1)}).groupBy(*unit).agg(F.sum(F.col("d") * F.col("d")).alias("v"), F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(s, F.lit(0.0)) for s in lags]).alias("c"))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    out = got.select(*unit, "n", F.posexplode(F.transform("c", lambda s: F.try_divide(s, F.col("v")))).alias("k", "acf"))
    return out.select(*unit, (F.col("k") + 1).alias("lag"), "acf", (F.abs("acf") > z / F.sqrt("n")).alias("exceeds"))


#: Cells to a doubling of p, by which a family is dealt out.
CELLS = 1024


def benjamini_hochberg(rows: DataFrame, p: str, family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds bh_q and bh_rejected within each family; NULL p stays out. Equal p have the same q, that of the last of them.

    A family is never one task: its distinct p are counted, dealt into cells by
    the logarithm, ranked within a cell, and a window over the cells' sums gives
    what comes before and after. Cells are about a thousand for each doubling of p, whatever the rows.
    """
    fam = list(family or [])
    key = [F.col(c).alias(f"_f{i}") for i, c in enumerate(fam)]
    keys = [f"_f{i}" for i in range(len(fam))]
    cell = F.when(F.col(p) > 0, F.floor(F.log2(F.col(p).cast("double")) * CELLS)).otherwise(F.lit(-(1 << 31)))
    known = rows.where(F.col(p).isNotNull())
    counts = known.groupBy(*key, F.col(p).alias("_p"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    here = Window.partitionBy(*keys, "_cell")
    counts = counts.withColumn("_within", F.sum("_n").over(here.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))

    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_s"))
    over = Window.partitionBy(*keys)
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_s").over(over.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_m": F.sum("_s").over(over)})
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    ranked = counts.alias("a").join(cells.alias("b"), same("a", "b", [*keys, "_cell"])).select(*[F.col(f"a.{c}").alias(c) for c in [*keys, "_p", "_cell"]], (F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_within"))).alias("_raw"))
    ranked = ranked.withColumn("_least", F.min("_raw").over(here.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)))
    after = ranked.groupBy(*keys, "_cell").agg(F.min("_raw").alias("_raw")).withColumn("_after", F.min("_raw").over(over.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)))
    q = ranked.alias("a").join(after.alias("b"), same("a", "b", [*keys, "_cell"])).select(*[F.col(f"a.{c}").alias(c) for c in [*keys, "_p"]], F.least("_least", "_after", F.lit(1.0)).alias("bh_q"))

    met = known.alias("r").join(q.alias("q"), [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{k}")) for c, k in zip(fam, keys, strict=True)] + [F.col(f"r.{p}") == F.col("q._p")])
    return met.select("r.*", "bh_q", (F.col("bh_q") <= alpha).alias("bh_rejected"))
