"""URL filters: rules by host and path, and boosted trees over lexical features where no rule fits.

The labelled URLs are those that a rule judges. Trees are grown level by level:
one grouped count over the labelled rows gives every histogram of a level; the
splits are chosen from those few sums, and the finished trees become one SQL
expression, so that judging URLs is a narrow scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, and paths that start with ``path`` (which begins with a slash)."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` to ``/ ? #`` with A-Z lower-cased, path from there to ``? #``; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), empty), F.coalesce(path, empty)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), null if none does; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):  # a later one goes before
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers of a URL's text; entropy is over its characters in bits."""
    u = F.coalesce(url, F.lit(""))
    digits = F.regexp_count(u, F.lit("[0-9]"))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    chars = F.split(u, "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n)
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p))
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_dots": F.regexp_count(host, F.lit(r"\.")).cast("double"),
        "host_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_length": F.length(path).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(digits.cast("double"), F.length(u)), F.lit(0.0)),
        "entropy": F.when(u == "", F.lit(0.0)).otherwise(entropy),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "https": u.startswith("https://").cast("double"),
        "html_end": path.endswith(".html").cast("double"),
    }


def _suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def _section(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), F.least(F.lit(2), F.size(F.split(path, "/"))))


@dataclass
class UrlModel:
    """Trees over ``names``: nodes are (feature, cut, left, right) or a leaf value; and the statistics by suffix and section."""

    names: list[str]
    trees: list
    base: float
    suffixes: dict[str, float]
    sections: dict[str, float]

    def stat(self, table: dict[str, float], key: Column) -> Column:
        if not table:
            return F.lit(self.base)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(self.base))

    def columns(self, url: Column, host: Column, path: Column) -> dict[str, Column]:
        return lexical_features(url, host, path) | {"suffix_rate": self.stat(self.suffixes, _suffix(host)), "section_rate": self.stat(self.sections, _section(path))}

    def margin(self) -> Column:
        """The sum of the trees over columns named as the features."""
        def walk(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(self.names[t[0]]) <= t[1], walk(t[2])).otherwise(walk(t[3]))
        out = F.lit(_logit(self.base))
        for t in self.trees:
            out = out + walk(t)
        return out


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _rates(rows: DataFrame, key: Column, base: float, most: int) -> dict[str, float]:
    """Smoothed share of block by key, of the ``most`` commonest keys."""
    got = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).where("k is not null").orderBy(F.desc("n"), "k").limit(most).collect()
    return {r["k"]: (r["b"] + 10 * base) / (r["n"] + 10) for r in got}


def fit(urls: DataFrame, rules: tuple[Rule, ...] = RULES, labelled_at_most: int = 20_000, trees: int = 8, depth: int = 2, bins: int = 12, rate: float = 0.4, suffixes_at_most: int = 200) -> UrlModel | None:
    """Trees from the (url) rows that a rule judges, block being 1; None if they are not of both kinds.

    ``labelled_at_most`` bounds the sample: where more are labelled, about that
    many are taken by a hash of the URL. Cuts are quantiles of each feature.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    host, path = url_parts(F.col("url"))
    labelled = urls.select("url", host.alias("host"), path.alias("path")).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules)).where("m is not null")
    n = labelled.count()
    ring = 1 << 30
    chosen = labelled.where(F.pmod(F.xxhash64("url"), F.lit(ring)) < int(ring * min(1.0, labelled_at_most / max(n, 1))))
    rows = scratch.save(chosen.select("url", "host", "path", (F.col("m.verdict") == "block").cast("int").alias("y")))
    total, blocked = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total or not blocked or blocked == total:
        scratch.drop(rows)
        return None
    base = blocked / total
    u, h, p = F.col("url"), F.col("host"), F.col("path")
    model = UrlModel([], [], base, _rates(rows, _suffix(h), base, suffixes_at_most), _rates(rows, _section(p), base, suffixes_at_most))
    feats = model.columns(u, h, p)
    model.names = list(feats)
    numbers = scratch.save(rows.select("y", *[c.alias(k) for k, c in feats.items()]))
    asked = [i / bins for i in range(1, bins)]
    found = numbers.agg(*[F.percentile(k, F.array(*map(F.lit, asked))).alias(k) for k in model.names]).first()
    cuts = {k: sorted(set(found[k])) for k in model.names}
    binned = scratch.save(
        numbers.select("y", F.array(*[sum((F.col(k) > c).cast("int") for c in cuts[k]) if cuts[k] else F.lit(0) for k in model.names]).alias("b")).groupBy("y", "b").agg(F.count(F.lit(1)).alias("w"))
    )
    scratch.drop(rows, numbers)
    for _ in range(trees):
        model.trees.append(_grow(binned, model, cuts, depth, rate))
    scratch.drop(binned)
    return model


def _grow(binned: DataFrame, model: UrlModel, cuts: dict, depth: int, rate: float):
    """One tree on the gradient of the log loss; each level is one grouped sum over (node, feature, bin)."""
    def binned_tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        below = sum(c <= t[1] for c in cuts[model.names[t[0]]])
        return F.when(F.col("b")[t[0]] < below, binned_tree(t[2])).otherwise(binned_tree(t[3]))

    margin = F.lit(_logit(model.base))
    for t in model.trees:
        margin = margin + binned_tree(t)
    prob = 1 / (1 + F.exp(-margin))
    rows = binned.select("b", "w", (F.col("w") * (F.col("y") - prob)).alias("g"), (F.col("w") * prob * (1 - prob)).alias("h"))
    splits: dict[int, tuple[int, float]] = {}  # node -> feature, cut; nodes are numbered as in a heap
    leaves: dict[int, float] = {}
    live = [1]
    for level in range(depth + 1):
        def place(node: int) -> Column:
            if node not in splits:
                return F.lit(node)
            j, cut = splits[node]
            below = sum(c <= cut for c in cuts[model.names[j]])
            return F.when(F.col("b")[j] < below, place(2 * node)).otherwise(place(2 * node + 1))
        placed = rows.withColumn("node", place(1)).where(F.col("node").isin(live))
        sums = placed.select("node", "g", "h", F.posexplode("b").alias("j", "bin")).groupBy("node", "j", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        nxt = []
        for node in live:
            mine = sorted((r["j"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == node)
            g, h = sum(x[2] for x in mine if x[0] == 0), sum(x[3] for x in mine if x[0] == 0)
            leaves[node] = rate * g / (h + 1.0)
            best = (1e-6, None)
            if level < depth:
                for j, name in enumerate(model.names):
                    lg = lh = 0.0
                    by_bin = {x[1]: x for x in mine if x[0] == j}
                    for k, cut in enumerate(cuts[name]):
                        if k in by_bin:
                            lg, lh = lg + by_bin[k][2], lh + by_bin[k][3]
                        gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, cut))
            if best[1] is not None:
                splits[node] = best[1]
                nxt += [2 * node, 2 * node + 1]
        live = nxt
        if not live:
            break

    def build(node: int):
        return (*splits[node], build(2 * node), build(2 * node + 1)) if node in splits else leaves[node]

    return build(1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """(id_col, host, path, rule, verdict, score), one row for each row of ``pages``.

    ``rule`` is the longest rule that fits (null if none) and gives the verdict;
    else the trees do: block at a score of one half or more. Where the labelled URLs
    are not of both kinds there are no trees, and a URL without a rule is allowed
    with a null score. Null URLs and those without ``://`` have empty host and path
    and are judged as the rest. Repeated rows each keep their row; an empty table gives an
    empty table; extra columns do not matter.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    model = fit(urls.select("url"), rules, **how)
    host, path = url_parts(F.col("url"))
    rows = urls.select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        score = F.lit(None).cast("double")
    else:
        rows = rows.withColumns({k: c for k, c in model.columns(F.col("url"), F.col("host"), F.col("path")).items()})
        score = 1 / (1 + F.exp(-model.margin()))
    verdict = F.coalesce(F.col("m.verdict"), F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
