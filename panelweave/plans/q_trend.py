"""Trend operators, on annual rates by nation."""

from pyspark.sql import functions as F

from ..operators import trend as T
from .q_rates import ANNUAL, annual
from .registry import out, query

SERIES = ANNUAL + """,
s AS (SELECT unit_id, year, rate FROM r WHERE status = 'ok'),
pairs AS (SELECT a.unit_id, (b.rate - a.rate) / (b.year - a.year) AS slope, sign(b.rate - a.rate) AS sg FROM s a JOIN s b ON a.unit_id = b.unit_id AND a.year < b.year),
g AS (SELECT unit_id, year, 1 - 2 * cume_dist() OVER (PARTITION BY unit_id ORDER BY rate) AS g, count(*) OVER (PARTITION BY unit_id) AS n, row_number() OVER (PARTITION BY unit_id ORDER BY year) AS i FROM s),
lag AS (SELECT a.unit_id, sum(a.g * b.g) AS s FROM g a JOIN g b ON a.unit_id = b.unit_id AND b.i > a.i AND b.i - a.i <= CAST(floor(pow(a.n, 1.0::DOUBLE / 3)) AS INT) GROUP BY 1),
mk AS (SELECT unit_id, avg(sg) AS u FROM pairs GROUP BY 1),
k AS (SELECT mk.unit_id, n, u, CAST(floor(pow(n, 1.0::DOUBLE / 3)) AS BIGINT) AS bandwidth, 4.0 / 9 + 8.0 / (3 * n) * coalesce(lag.s, 0) AS variance FROM mk JOIN (SELECT DISTINCT unit_id, n FROM g) USING (unit_id) LEFT JOIN lag USING (unit_id))
"""


def series(spark, d):
    return annual(spark, d).where("status = 'ok'").select("unit_id", "year", "rate")


@query("q_sen_slope", SERIES + "SELECT unit_id, round(median(slope), 6) AS sen_slope, count(*) AS pairs FROM pairs GROUP BY unit_id")
def sen(spark, d):
    return out(T.sen_slope(series(spark, d), ["unit_id"], "year", "rate"))


@query("q_mk_components", SERIES + "SELECT unit_id, n, round(u, 6) AS u, bandwidth, round(variance, 6) + 0.0 AS variance, round(sqrt(n) * u / sqrt(greatest(variance, 1e-12)), 6) AS t FROM k")
def mk(spark, d):
    return out(T.mk_components(series(spark, d), ["unit_id"], "year", "rate"))


@query("q_acf", SERIES + ", d AS (SELECT unit_id, year, rate - avg(rate) OVER (PARTITION BY unit_id) AS d, count(*) OVER (PARTITION BY unit_id) AS n FROM s), l AS (SELECT *, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY year)), c AS (SELECT unit_id, max(n) AS n, sum(d * l1) / sum(d * d) AS a1, sum(d * l2) / sum(d * d) AS a2 FROM l GROUP BY 1), x AS (SELECT unit_id, n, unnest([1, 2]) AS lag, unnest([a1, a2]) AS a FROM c) SELECT unit_id, CAST(lag AS BIGINT) AS lag, round(a, 6) AS acf, abs(a) > 1.959963984540054 / sqrt(n) AS exceeds FROM x")
def acf(spark, d):
    return out(T.autocorrelation(series(spark, d), ["unit_id"], "year", "rate", 2))


@query("q_bh", "WITH p AS (SELECT event_id, user_id % 3 AS family, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, event_id) AS r, count(*) OVER (PARTITION BY family) AS m FROM p), q AS (SELECT *, least(min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM r) SELECT event_id, CAST(family AS BIGINT) AS family, round(q, 6) AS bh_q, q <= 0.05 AS bh_rejected FROM q")
def bh(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = e.select("event_id", (F.col("user_id") % 3).alias("family"), (F.col("event_id") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    return out(T.benjamini_hochberg(p, "p", ["family"]).select("event_id", "family", "bh_q", "bh_rejected"))


@query("q_mk_perm_pcg64")
def mk_perm(spark, d):
    return out(T.mk_permutation(series(spark, d), ["unit_id"], "year", "rate"))


@query("q_sen_ci", SERIES + """,
t AS (SELECT unit_id, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT unit_id, rate, count(*) AS c FROM s GROUP BY ALL) GROUP BY 1),
n AS (SELECT unit_id, count(*) AS n, median(rate) AS my, median(year) AS mx FROM s GROUP BY 1),
b AS (SELECT unit_id, list(slope ORDER BY slope) AS l, median(slope) AS slope, count(*) AS k FROM pairs GROUP BY 1),
h AS (SELECT *, 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) AS half FROM b JOIN n USING (unit_id) JOIN t USING (unit_id))
SELECT unit_id, round(slope, 6) AS sen_slope, round(my - slope * mx, 6) AS intercept, round(l[greatest(CAST(round_even((k - half) / 2, 0) AS BIGINT) - 1, 0) + 1], 6) AS low, round(l[least(CAST(round_even((k + half) / 2, 0) AS BIGINT), k - 1) + 1], 6) AS high FROM h""")
def sen_ci(spark, d):
    return out(T.sen_with_interval(series(spark, d), ["unit_id"], "year", "rate"))


@query("q_mk_perm_hash", SERIES + """,
reps AS (SELECT CAST(unnest(range(9999)) AS BIGINT) AS rep),
perm AS (SELECT unit_id, rep, rate, row_number() OVER (PARTITION BY unit_id, rep ORDER BY md5('20260822|' || rep || '|' || unit_id || '|' || year)) AS i FROM s, reps),
sg AS (SELECT a.unit_id, a.rep, CAST(sum(sign(b.rate - a.rate)) AS BIGINT) AS score FROM perm a JOIN perm b ON a.unit_id = b.unit_id AND a.rep = b.rep AND a.i < b.i GROUP BY ALL),
o AS (SELECT unit_id, CAST(sum(sg) AS BIGINT) AS score FROM pairs GROUP BY 1)
SELECT unit_id, o.score, count(*) FILTER (abs(sg.score) >= abs(o.score)) AS extreme, round((1 + count(*) FILTER (abs(sg.score) >= abs(o.score))) / 10000.0, 6) AS p FROM o JOIN sg USING (unit_id) GROUP BY unit_id, o.score""")
def mk_perm_hash(spark, d):
    return out(T.mk_permutation_by_hash(series(spark, d), ["unit_id"], "year", "rate"))
