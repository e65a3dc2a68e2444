"""From classes to feature sets: strand conflicts, chemistry filters, coercion of mates, group rollup and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators.align import EMPTY, FORCE_FAILED, MATCH, MAX_HITS
from readloom.plans.config import FALLBACK, FORCE, UNION, Config

#: The states (R1 then R2; F forward, R reverse, U not hit) that each chemistry keeps.
KEPT = {
    "none": ("FU", "RU", "UF", "UR", "FF", "RR", "FR", "RF"),
    "unstranded": ("FU", "RU", "UF", "UR", "FR", "RF"),
    "fiveprime": ("FU", "UR", "FR"),
    "threeprime": ("RU", "UF", "RF"),
}


def states(calls: DataFrame, *carry: str) -> DataFrame:
    """(pair_id, feature, r1, r2) from (pair_id, mate, feature, is_rev) calls: F, R, U, or X for a mate that hits both strands."""

    def state(mate: int) -> Column:
        low = F.min(F.when(F.col("mate") == mate, F.col("is_rev").cast("int")))
        high = F.max(F.when(F.col("mate") == mate, F.col("is_rev").cast("int")))
        return F.when(low.isNull(), "U").when(low != high, "X").when(high == 1, "R").otherwise("F")

    return calls.groupBy("pair_id", "feature", *carry).agg(state(1).alias("r1"), state(2).alias("r2"))


def settled(found: DataFrame) -> DataFrame:
    """A feature that one mate hits on both strands is no hit of that mate."""
    rows = found.withColumns({m: F.when(F.col(m) == "X", "U").otherwise(F.col(m)) for m in ("r1", "r2")})
    return rows.where("r1 <> 'U' OR r2 <> 'U'")


def keeps(chemistry: str) -> Column:
    return F.concat("r1", "r2").isin(*KEPT[chemistry])


def strand_conflict(calls: DataFrame) -> DataFrame:
    """Calls without the features that their mate hits on both strands."""
    both = calls.groupBy("pair_id", "mate", "feature").agg(F.countDistinct("is_rev").alias("n")).where("n = 1")
    return calls.join(both.select("pair_id", "mate", "feature"), ["pair_id", "mate", "feature"], "left_semi")


def orient(calls: DataFrame, chemistry: str, *carry: str) -> DataFrame:
    """(pair_id, feature, r1, r2) of the features whose strands fit the chemistry."""
    return settled(states(calls, *carry)).where(keeps(chemistry))


def coerce(kept: DataFrame, level: int, name: str = "feature") -> DataFrame:
    """(pair_id, names, failed) from oriented features: the union of both mates' names, or what they share (by level with or without falling back)."""
    one, two = (F.array_sort(F.collect_set(F.when(F.col(m) != "U", F.col(name)))) for m in ("r1", "r2"))
    shared = F.array_sort(F.collect_set(F.when((F.col("r1") != "U") & (F.col("r2") != "U"), F.col(name))))
    rows = kept.groupBy("pair_id").agg(one.alias("one"), two.alias("two"), shared.alias("shared"), F.count(F.when((F.col("r1") != "U") & (F.col("r2") != "U"), 1)).alias("common"))
    all_ = F.array_sort(F.array_distinct(F.concat("one", "two")))
    names = {UNION: all_, FALLBACK: F.when(F.col("common") > 0, F.col("shared")).otherwise(all_), FORCE: F.col("shared")}[level]
    return rows.select("pair_id", names.alias("names"), ((F.col("common") == 0) & F.lit(level == FORCE)).alias("failed"))


def verdict(names: Column, failed: Column, cfg: Config) -> tuple[Column, Column]:
    """Features and triage reason of a pair: lists longer than discard_multi_hits are emptied, then too many or no features drop the pair."""
    if cfg.discard_multi_hits:
        names = F.when(F.size(names) > cfg.discard_multi_hits, F.array().cast("array<string>")).otherwise(names)
    why = F.when(failed, EMPTY if cfg.compat else FORCE_FAILED).when(F.size(names) > cfg.max_hits_to_report, MAX_HITS).when(F.size(names) == 0, EMPTY).otherwise(MATCH)
    return seq.natural_sort(names), why


def triage(sets: DataFrame, cfg: Config) -> DataFrame:
    """(pair_id, features, triage) from (pair_id, names, failed)."""
    features, why = verdict(F.col("names"), F.col("failed"), cfg)
    return sets.select("pair_id", features.alias("features"), why.alias("triage"))


def calls_of(aligned: DataFrame, library: DataFrame) -> DataFrame:
    """(pair_id, mate, feature, is_rev, grp) of aligned (pair_id, mate, cls) reads."""
    rows = aligned.select("pair_id", "mate", F.explode("cls").alias("ref_idx"))
    return rows.join(library.select("ref_idx", "feature", "is_rev", "grp"), "ref_idx").drop("ref_idx")


def feature_names(rows: DataFrame, library: DataFrame, column: str = "feature") -> DataFrame:
    """(id, names): each class of row numbers as sorted distinct names (or groups)."""
    flat = rows.select("id", F.explode("cls").alias("ref_idx")).join(library, "ref_idx")
    return flat.groupBy("id").agg(seq.natural_sort(F.collect_set(column)).alias("names"))


def unmap(names: DataFrame, library: DataFrame) -> DataFrame:
    """(name, ref_idx): the first library row of each name."""
    return names.join(library.groupBy(F.col("feature").alias("name")).agg(F.min("ref_idx").alias("ref_idx")), "name")
