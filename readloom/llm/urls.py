"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions. Trees are grown on the driver from one aggregate, the joint
histogram of a bounded sample of labelled urls, and the finished trees are one CASE expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kit

#: (rule, verdict): host, then path. A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Bound on the labelled rows that the trees are grown on.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 16, 3, 12, 0.3, 1.0
#: Up to so many rules are one expression; more are a table that meets the distinct hosts.
IN_LINE = 100
#: Folds of the labelled urls: the rate of a suffix leaves out the labels of the url's own fold.
FOLDS = 5
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_count")


def host_path(url):
    """Host and path columns. Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return kit.lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest rule that fits (of equally long ones the smaller), or null; and its verdict."""
    name = verdict = None
    for rule, what in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and by_rule to rows with host and path: the rule of rule_of() and its verdict, for any number of rules."""
    if len(rules) <= IN_LINE:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    table = rows.sparkSession.createDataFrame([(*r.partition("/")[::2], r, v) for r, v in rules], "h string, p string, rule string, by_rule string")
    hosts = rows.select(F.col("host").alias("of")).distinct()
    parts = F.split("of", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = hosts.select("of", F.explode(ends).alias("h")).join(table, "h").groupBy("of").agg(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "by_rule", F.concat(F.lit("/"), "p").alias("start"))).alias("fit"))
    fit = F.array_min(F.filter("fit", lambda x: F.startswith(F.col("path"), x["start"])))
    out = rows.join(kit.apart(found, "of"), F.col("host") == F.col("of"), "left").withColumn("best", fit)
    return out.withColumn("rule", F.col("best.rule")).withColumn("by_rule", F.col("best.by_rule")).drop("of", "fit", "best")


def lexical(url, host, path) -> dict:
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))))
    count = lambda col, pattern: F.regexp_count(col, F.lit(pattern)).cast("double")
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, r"[^.]+"),
        "depth": count(path, r"/"),
        "digits": count(url, r"[0-9]") / n,
        "entropy": entropy,
        "parameters": F.when(F.contains(url, F.lit("?")), count(url, "&") + 1).otherwise(F.lit(0.0)),
        "hyphens": count(host, "-"),
    }


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[dict, dict]:
    """One tree from the joint histogram: splits by heap position (feature, bin; above the bin goes right) and leaf values."""
    splits, values, open_ = {}, {}, {1: np.arange(len(bins))}
    while open_:
        leaf, rows = open_.popitem()
        g, h, best = grad[rows].sum(), hess[rows].sum(), (1e-6, None, None)
        for f in range(bins.shape[1]) if leaf < 1 << DEPTH else ():
            lg = np.bincount(bins[rows, f], grad[rows], BINS).cumsum()
            lh = np.bincount(bins[rows, f], hess[rows], BINS).cumsum()
            gain = np.where((lh >= 1) & (h - lh >= 1), lg**2 / (lh + SMOOTH) + (g - lg) ** 2 / (np.maximum(h - lh, 0) + SMOOTH) - g * g / (h + SMOOTH), 0)
            if gain.max() > best[0] + 1e-9:
                best = gain.max(), f, int(gain.argmax())
        if best[1] is None:
            values[leaf] = float(RATE * g / (h + SMOOTH))
        else:
            splits[leaf] = best[1:]
            right = bins[rows, best[1]] > best[2]
            open_[2 * leaf], open_[2 * leaf + 1] = rows[~right], rows[right]
    return splits, values


class Trees:
    """Boosted trees over binned features; each is a dict of splits by heap position (1 is the root) and one of leaf values."""

    def __init__(self, cuts: list[list[float]], bias: float) -> None:
        self.cuts, self.bias, self.trees = cuts, bias, []

    def value(self, splits: dict, values: dict):
        def below(k: int):
            if k not in splits:
                return F.lit(values.get(k, 0.0))
            f, b = splits[k]
            return F.when(F.col(FEATURES[f]) <= self.cuts[f][b], below(2 * k)).otherwise(below(2 * k + 1))

        return below(1)

    def score(self):
        """Probability of block, from columns named as FEATURES."""
        total = F.lit(self.bias)
        for splits, values in self.trees:
            total = total + self.value(splits, values)
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame) -> Trees | None:
    """Grow trees on (FEATURES, y, h) rows, y being 1 for block: on those that a hash h picks, about SAMPLE of them. None without rows.

    Two aggregates: the features' quantiles, then the joint histogram of their bins (at most a row per sampled row), from which the driver grows the trees.
    """
    n = rows.count()
    if not n:
        return None
    if n > SAMPLE:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    rows = kit.stage(rows.select(*FEATURES, "y"), "labelled")
    first = rows.agg(F.avg("y"), F.count("*"), *[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000) for f in FEATURES]).first()
    if not first[1]:
        return None
    p = min(max(first[0], 1e-3), 1 - 1e-3)
    cuts = [sorted(set(c)) for c in first[2:]]
    model = Trees(cuts, math.log(p / (1 - p)))
    if not 0 < first[0] < 1:
        return model
    binned = F.array(*[sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0)) for k, f in enumerate(FEATURES)])
    table = sorted((tuple(r[0]), r[1], r[2]) for r in rows.groupBy(binned.alias("bins")).agg(F.sum("y"), F.count("*")).collect())
    bins, bad, size = np.array([t[0] for t in table]), np.array([t[1] for t in table]), np.array([t[2] for t in table], float)
    total = np.full(len(table), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        splits, values = _grow(bins, bad - size * p, np.maximum(size * p * (1 - p), 1e-6))
        if not splits:
            break
        model.trees.append((splits, values))
        leaf = np.ones(len(table), int)
        for _ in range(DEPTH):
            for k in np.unique(leaf):
                if k in splits:
                    f, b = splits[k]
                    here = leaf == k
                    leaf = np.where(here, 2 * leaf + (bins[:, f] > b), leaf)
        total = total + np.array([values[k] for k in leaf])
    return model


def _described(rows: DataFrame) -> DataFrame:
    """Rows (url, host, path, suffix, by_rule) with their FEATURES. Suffixes are counted over all rows, their rate over labelled ones of other folds
    (repeated urls share a fold), so that no label explains itself."""
    bad, fold = F.when(F.col("by_rule") == "block", 1).otherwise(0), F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", fold)
    per = [F.struct(F.count(F.when(F.col("fold") == k, F.col("by_rule"))).alias("known"), F.sum(F.when(F.col("fold") == k, bad).otherwise(0)).alias("bad")) for k in range(FOLDS)]
    stats = rows.groupBy("suffix").agg(F.count("*").alias("all"), F.count("by_rule").alias("known"), F.sum(bad).alias("bad"), F.array(*per).alias("folds"))
    own = F.when(F.col("by_rule").isNotNull(), F.get("folds", F.col("fold")))
    rate = (F.col("bad") - F.coalesce(own["bad"], F.lit(0)) + 2.0) / (F.col("known") - F.coalesce(own["known"], F.lit(0)) + 4.0)
    full = rows.join(stats, "suffix").withColumn("suffix_rate", rate).withColumn("suffix_count", F.log1p("all"))
    return full.drop("all", "known", "bad", "folds").withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))


def _ruled(pages: DataFrame, rules, keep: list[str] | None) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in (keep or pages.columns)]).alias("row"), url.alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    return with_rules(rows, rules).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))


def held_out(pages: DataFrame, rules=RULES) -> tuple[int, int, int]:
    """How well trees that never saw a fifth of the labelled urls judge that fifth: (urls, right ones, those of the more frequent verdict)."""
    rows = _ruled(pages, rules, ["url"])
    aside = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0
    full = _described(rows.withColumn("truth", F.col("by_rule")).withColumn("by_rule", F.when(~aside, F.col("by_rule"))))
    model = fit(full.where("by_rule IS NOT NULL").select(*FEATURES, F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0).alias("y"), F.xxhash64("url").alias("h")))
    score = model.score() if model else F.lit(0.0)
    block = F.col("truth") == "block"
    n, right, bad = full.where(aside & F.col("truth").isNotNull()).agg(F.count("*"), F.count(F.when((score >= 0.5) == block, 1)), F.count(F.when(block, 1))).first()
    return n, right, max(bad, n - bad)


def judge(pages: DataFrame, rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Judge every url. Returns (row, host, path, rule, verdict, score); ``row`` is a struct of the input's columns (or of ``keep``).

    The longest rule that fits decides; else the trees, grown on the urls that rules decide, block at a score of 0.5. Null
    urls and urls without ``://`` have an empty host and path and go to the trees as they are (null as empty); if no
    url has a rule, or all those have one verdict, that verdict (or allow) holds. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    rows = _ruled(pages, rules, keep)
    full = _described(rows)
    known = full.where("by_rule IS NOT NULL").select(*FEATURES, F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0).alias("y"), F.xxhash64("url").alias("h"))
    model = fit(known)
    score = model.score() if model else F.lit(0.0)
    return full.withColumn("score", score).select("row", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op3(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict", "score")
