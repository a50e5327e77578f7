"""Penalised logistic estimating equations with independence working structure.

Every sum over rows, the score, the information and the cluster scores, is one Spark
aggregate; only p x p matrices and one row a cluster reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    iterations: int
    n: int
    clusters: int
    detail: dict = field(default_factory=dict)


def dummies(rows: DataFrame, factor: str, prefix: str, reference=None) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the sorted levels of a factor but its reference (the first unless given)."""
    levels = sorted(r[0] for r in rows.select(factor).distinct().collect())
    if reference is not None and reference not in levels:
        raise ValueError(f"{factor}: no level {reference!r}")
    ref = levels[0] if reference is None else reference
    names = {f"{prefix}_{v}": v for v in levels if v != ref}
    return rows.withColumns({n: (F.col(factor) == F.lit(v)).cast("double") for n, v in names.items()}), list(names)


def population(rows: DataFrame, count: str, presence: str) -> DataFrame:
    """Rows with a positive count; the outcome y is 1 - presence."""
    return rows.where(F.col(count) > 0).withColumn("y", (1 - F.col(presence)).cast("double"))


def _eta(terms: list[str], beta) -> Column:
    out = F.lit(0.0)
    for t, b in zip(terms, beta, strict=True):
        out = out + F.col(t) * F.lit(float(b))
    return out


def _mu(eta: Column) -> Column:
    return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))


def _sums(rows: DataFrame, exprs: list[Column]) -> np.ndarray:
    return np.array(rows.agg(*[F.sum(e) for e in exprs]).first(), float)


def evaluate(rows: DataFrame, terms: list[str], beta) -> tuple[float, np.ndarray]:
    """(penalised log likelihood, information) at beta, in one aggregate."""
    p = len(terms)
    eta = _eta(terms, beta)
    mu = _mu(eta)
    r = rows.withColumns({"_w": mu * (1 - mu), "_l": F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))})
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = _sums(r, [F.col("_l"), *[F.col("_w") * F.col(terms[i]) * F.col(terms[j]) for i, j in pairs]])
    info = np.zeros((p, p))
    for (i, j), v in zip(pairs, got[1:], strict=True):
        info[i, j] = info[j, i] = v
    sign, logdet = np.linalg.slogdet(info)
    return float(got[0] + (0.5 * logdet if sign > 0 else -math.inf)), info


def information(rows: DataFrame, terms: list[str], beta) -> np.ndarray:
    return evaluate(rows, terms, beta)[1]


def _residual(terms: list[str], beta, inverse: np.ndarray) -> Column:
    """y - mu + h (1/2 - mu), h being the leverage."""
    mu = _mu(_eta(terms, beta))
    quad = F.lit(0.0)
    for i, a in enumerate(terms):
        row = F.lit(0.0)
        for j, b in enumerate(terms):
            row = row + F.col(b) * F.lit(float(inverse[i, j]))
        quad = quad + F.col(a) * row
    return F.col("y") - mu + mu * (1 - mu) * quad * (0.5 - mu)


def adjusted_score(rows: DataFrame, terms: list[str], beta, info: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, information) at beta."""
    info = information(rows, terms, beta) if info is None else info
    u = rows.withColumn("_u", _residual(terms, beta, np.linalg.inv(info)))
    return _sums(u, [F.col("_u") * F.col(t) for t in terms]), info


def penalised_loglik(rows: DataFrame, terms: list[str], beta) -> float:
    return evaluate(rows, terms, beta)[0]


def fit_firth(rows: DataFrame, terms: list[str], cluster: str, tolerance: float = 1e-8, most_iterations: int = 250, most_halvings: int = 40) -> Fit:
    """Newton with step halving on the Jeffreys-penalised likelihood; raises without full rank or without an end."""
    rows = rows.select(*terms, "y", cluster).persist()
    try:
        beta = np.zeros(len(terms))
        best, info = evaluate(rows, terms, beta)
        if np.linalg.matrix_rank(info) < len(terms):
            raise ValueError("the design has no full rank")
        for step in range(1, most_iterations + 1):
            score, _ = adjusted_score(rows, terms, beta, info)
            if np.abs(score).max() < tolerance:
                break
            move = np.linalg.solve(info, score)
            for _ in range(most_halvings + 1):
                tried, tried_info = evaluate(rows, terms, beta + move)
                if tried >= best - 1e-12 * (1 + abs(best)):
                    break
                move = move / 2
            else:
                raise ValueError("no step improves the likelihood")
            beta, best, info = beta + move, tried, tried_info
            if np.abs(move).max() < tolerance:
                break
        else:
            raise ValueError("no convergence")
        cov, detail = morel_covariance(rows, terms, beta, cluster)
        n, k = rows.count(), detail["clusters"]
        return Fit(terms, beta, cov, step, n, k, detail)
    finally:
        rows.unpersist()


def morel_covariance(rows: DataFrame, terms: list[str], beta, cluster: str) -> tuple[np.ndarray, dict]:
    """Small-sample sandwich: B M B + phi delta B, from centred cluster scores.

    M is scaled by K/(K-1) * (n-1)/(n-p); delta = min(1/2, p/(K-p)); phi = max(1, tr(B M)/p).
    """
    bread = np.linalg.inv(information(rows, terms, beta))
    mu = _mu(_eta(terms, beta))
    scores = rows.withColumn("_r", F.col("y") - mu).groupBy(cluster).agg(*[F.sum(F.col("_r") * F.col(t)).alias(f"_s{i}") for i, t in enumerate(terms)], F.count(F.lit(1)).alias("_n"))
    p = len(terms)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = scores.agg(F.count(F.lit(1)), F.sum("_n"), *[F.sum(f"_s{i}") for i in range(p)], *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).first()
    k, n, total = got[0], got[1], np.array(got[2 : 2 + p], float)
    cross = np.zeros((p, p))
    for (i, j), v in zip(pairs, got[2 + p :], strict=True):
        cross[i, j] = cross[j, i] = v
    meat = (cross - np.outer(total, total) / k) * (k / (k - 1)) * ((n - 1) / (n - p))
    delta = min(0.5, p / (k - p)) if k > p else 0.5
    phi = max(1.0, float(np.trace(bread @ meat)) / p)
    cov = bread @ meat @ bread + phi * delta * bread
    cov = (cov + cov.T) / 2
    if np.linalg.eigvalsh(cov).min() <= 0:
        raise ValueError("the covariance is not positive definite")
    return cov, {"clusters": int(k), "delta": delta, "phi": phi}


def coefficients(fit: Fit, spark, confidence: float = 0.95) -> DataFrame:
    """term_order, term, beta, se, z, p and the odds ratio with its bounds."""
    nd = NormalDist()
    q = nd.inv_cdf(1 - (1 - confidence) / 2)
    rows = []
    for i, t in enumerate(fit.terms):
        b, se = float(fit.beta[i]), float(math.sqrt(fit.covariance[i, i]))
        z = b / se
        rows.append((i, t, b, se, z, math.erfc(abs(z) / math.sqrt(2)), math.exp(b), math.exp(b - q * se), math.exp(b + q * se)))
    return spark.createDataFrame(rows, "term_order int, term string, beta double, se double, z double, p double, odds_ratio double, or_low double, or_high double")


def covariance_long(fit: Fit, spark) -> DataFrame:
    return spark.createDataFrame([(i, j, a, b, float(fit.covariance[i, j])) for i, a in enumerate(fit.terms) for j, b in enumerate(fit.terms)], "i int, j int, term_i string, term_j string, value double")


def fit_summary(fit: Fit, spark) -> DataFrame:
    return spark.createDataFrame([(fit.n, fit.clusters, len(fit.terms), fit.iterations, fit.detail["delta"], fit.detail["phi"])], "n long, clusters long, terms int, iterations int, delta double, phi double")


def standardised_probability(rows: DataFrame, fit: Fit, term: str, value: float) -> DataFrame:
    """The mean probability with one column set to a value for all rows."""
    set_ = rows.withColumn(term, F.lit(float(value)))
    return set_.agg(F.avg(_mu(_eta(fit.terms, fit.beta))).alias("probability"))


#: estimator id -> (implementation); an id that is not here is not available.
REGISTRY = {"firth_pgee_independence": fit_firth}


def dispatch(method: str):
    if method not in REGISTRY:
        raise KeyError(f"no implementation for {method!r}")
    return REGISTRY[method]
