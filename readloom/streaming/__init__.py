"""Counts over arriving read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import align, counts
from readloom.plans import scratch
from readloom.plans.config import Config


def stream_counts(pairs: DataFrame, library: DataFrame, cfg: Config, sink):
    """Write the trace of each micro-batch of (pair_id, r1, r2) rows through sink(frame, batch number); start() the result.

    Distinct pairs are those of a batch; summing the batches counts a pair that comes again once per batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch.passing():
            found = counts.trace(counts.dedup_pairs(batch), library, cfg, hit_only=True).where(F.col("triage") == align.MATCH)
            sink(found.groupBy("features").agg(F.count("*").alias("score")), number)

    return pairs.writeStream.foreachBatch(each)
