"""The whole query: pairs and a library to counts, and the audit of every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import align, orient, screen
from readloom.plans import scratch
from readloom.plans.config import Config


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """One of the pairs with equal sequences stays, the last by pair_id: (pair_id, r1, r2, copies)."""
    return pairs.groupBy("r1", "r2").agg(F.max("pair_id").alias("pair_id"), F.count("*").alias("copies")).select("pair_id", "r1", "r2", "copies")


def mates(pairs: DataFrame) -> DataFrame:
    """(pair_id, mate, read_id, seq[, skip]) of pairs; an absent mate has no row."""
    extra = [F.struct(F.lit(m).alias("mate"), F.col(f"r{m}").alias("seq"), (F.coalesce(F.col(f"skip{m}"), F.lit(False)) if f"skip{m}" in pairs.columns else F.lit(False)).alias("skip")) for m in (1, 2)]
    rows = pairs.select("pair_id", F.explode(F.array(*extra)).alias("x")).where("x.seq IS NOT NULL")
    return rows.select("pair_id", "x.mate", F.struct("pair_id", F.col("x.mate").alias("mate")).alias("read_id"), "x.seq", "x.skip")


def valid_pair(a, b):
    """Both mates have the same, non-empty class."""
    return F.coalesce((F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b)), F.lit(False))


def trace(pairs: DataFrame, library: DataFrame, cfg: Config, found: DataFrame | None = None, hit_only: bool = False) -> DataFrame:
    """(pair_id, r1, r2, features, triage) of distinct pairs, whose ids may be of any type: r1 and r2 are structs of reason, norm, score, shown score (0 unless the read itself matched) and class, triage is null for pairs without a call. ``found`` may hold the alignment of the pairs' prepared mates. With ``hit_only``, mates without a hit are left out, and pairs without any: none of them has a call."""
    reads = mates(pairs)
    aligned = align.align_reads(reads.select("read_id", "seq", "skip"), library, cfg, found, hit_only)
    aligned = aligned.withColumn("pair_id", F.col("read_id.pair_id")).withColumn("mate", F.col("read_id.mate"))
    shown = F.when(F.col("cls").isNotNull(), F.col("score")).otherwise(0).alias("shown")
    side = lambda m: F.max(F.when(F.col("mate") == m, F.struct("reason", "norm", "score", shown, "cls")))
    both = aligned.groupBy("pair_id").agg(side(1).alias("r1"), side(2).alias("r2"))
    if cfg.require_valid_pair:
        ok = valid_pair(F.col("r1.cls"), F.col("r2.cls"))
        lost = lambda m: F.struct(F.lit(align.PAIR).alias("reason"), *[F.col(f"{m}.{c}").alias(c) for c in ("norm", "score", "shown")], F.lit(None).cast("array<bigint>").alias("cls"))
        drop = lambda m: F.when(F.col(m).isNull() | ok, F.col(m)).otherwise(lost(m))
        both = both.select("pair_id", drop("r1").alias("r1"), drop("r2").alias("r2"))
    if hit_only:  # few, and read twice: else they are aligned twice
        both = scratch.hold(both, "mates")
    flat = both.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("r1.cls").alias("cls")), F.struct(F.lit(2).alias("mate"), F.col("r2.cls").alias("cls")))).alias("x")).select("pair_id", "x.mate", "x.cls")
    calls = orient.calls_of(flat, library)
    kept = orient.settled(orient.states(calls, "grp")).where(orient.keeps(cfg.chemistry))
    full = both.join(orient.coerce(kept, cfg.intersect_level, "grp"), "pair_id", "left")
    called = (F.coalesce(F.size("r1.cls"), F.lit(0)) > 0) | (F.coalesce(F.size("r2.cls"), F.lit(0)) > 0)
    features, why = orient.verdict(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("failed", F.lit(cfg.intersect_level == 2)), cfg)
    return full.select("pair_id", "r1", "r2", F.when(called, features).alias("features"), F.when(called, why).alias("triage"))


def feature_counts(pairs: DataFrame, library: DataFrame, cfg: Config) -> DataFrame:
    """(features, score): how many distinct pairs call each feature set. pairs: (pair_id, r1, r2)."""
    return counted(trace(candidates(pairs, [library]), library, cfg, hit_only=True))


def candidates(pairs: DataFrame, libraries: list[DataFrame]) -> DataFrame:
    """The distinct pairs that may have a call, written once. The others go before equal pairs meet, so their letters aren't shuffled."""
    return scratch.hold(dedup_pairs(screen.screened(pairs, libraries)), "pairs")


def counted(traced: DataFrame) -> DataFrame:
    return traced.where(F.col("triage") == align.MATCH).groupBy("features").agg(F.count("*").alias("score"))


def sorted_counts(pairs: DataFrame, library: DataFrame, cfg: Config) -> DataFrame:
    return feature_counts(pairs, library, cfg).orderBy("features")


def audit(pairs: DataFrame, library: DataFrame, cfg: Config) -> DataFrame:
    """One row per distinct pair: each mate's reason and score, the triage reason and the features.

    The score of a filtered read is reported as 0, with its true score beside it. An absent mate has nulls.
    """
    found = trace(dedup_pairs(pairs), library, cfg)
    return found.select(
        "pair_id",
        F.col("r1.reason").alias("r1_filter_forward"), F.col("r1.shown").alias("r1_forward_score"), F.col("r1.score").alias("r1_true_score"),
        F.col("r2.reason").alias("r2_filter_forward"), F.col("r2.shown").alias("r2_forward_score"), F.col("r2.score").alias("r2_true_score"),
        F.coalesce("triage", F.lit("None")).alias("triage_reason"), F.array_join(F.coalesce("features", F.array().cast("array<string>")), ",").alias("features"),
    )


def counts_by_library(pairs: DataFrame, libraries: list[tuple[Config, DataFrame]]) -> list[DataFrame]:
    """(features, score) for each of several libraries with settings of their own. Pairs are read and aligned once for all of them."""
    if len(libraries) == 1:
        return [feature_counts(pairs, library, cfg) for cfg, library in libraries]
    distinct = candidates(pairs, [library for _, library in libraries])
    found = scratch.hold(align.pseudoalign_all(align.prepared(mates(distinct)), [library for _, library in libraries], fit=True), "aligned")
    return [counted(trace(distinct, library, cfg, found.where(F.col("lib") == n).drop("lib"), hit_only=True)) for n, (cfg, library) in enumerate(libraries)]


def many_libraries(pairs: DataFrame, libraries: list[tuple[str, DataFrame, Config]]) -> DataFrame:
    """(library, features, score) of several libraries, each with settings of its own."""
    out = None
    for (name, _, _), one in zip(libraries, counts_by_library(pairs, [(cfg, library) for _, library, cfg in libraries])):
        one = one.withColumn("library", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def threshold_percentage(scores: DataFrame, least: float) -> DataFrame:
    return scores.where(F.col("score") >= least)


def trim_pairs(reads: DataFrame, cfg: Config) -> DataFrame:
    """Clip adapters and trim (.., seq, quality array, reverse) reads, and add the clipped read as ``raw``; reads without qualities aren't trimmed (with compat: to nothing)."""
    q = seq.clip_quality(F.col("quality"), F.col("reverse"))
    reads = reads.withColumn("raw", seq.oriented(seq.clip_adapter(F.col("seq"), F.col("reverse")), F.col("reverse")))
    reads = reads.withColumn("quality", F.coalesce(q, F.array().cast("array<int>")) if cfg.compat else q)
    return reads.withColumn("seq", seq.trimmed(F.col("raw"), F.col("quality"), cfg.trim_target_length, cfg.trim_strictness))
