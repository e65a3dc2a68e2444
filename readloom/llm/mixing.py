"""Mixing sources to target weights.

Every row gets a hash-random key, whose first digits name its range; sizes are summed per source and range, and distributed prefix
sums over the ranges tell in which one a source's budget ends. Ranges before it are taken whole and those after it not at all,
row by row; only the rows of that one range are sorted by key, and cut at the exact budget. Epochs repeat if the budget exceeds the source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import kit

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, "mix-1"
#: Rows aimed at in one key range.
RANGE_ROWS = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, target) of (source, n) rows. Sources go by code point, null last, with repeating weights.

    A target stops at ``most`` times its source; the excess is reshared by weight until none is above. Sources reach their
    limit in order of size over weight, so running sums in that order tell which do: one task takes the sources' rows in order, holding none.
    """
    by_name, everything = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    before = Window.orderBy(F.col("n") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("limit", most * F.col("n"))
    left, open_ = share * F.col("total") - past("limit"), F.col("weight") - past("w")
    rows = rows.withColumn("full", F.col("w") * left > F.col("limit") * open_)
    taken, free = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("w") * (share * F.col("total") - taken) / F.when(free > 0, free))
    return rows.select("source", "n", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Decide how much of each document the mix takes.

    Returns (row, size, source_size, target, taken, copies): ``row`` is a struct of the input's columns
    (or of ``keep``), so no column name can clash; ``taken`` counts words exactly up to the source's
    budget; ``copies`` is the same decision in whole documents (a document on the cut counts if at least
    half of it is inside). Null or empty text has size 0; null sources form one source; null doc_ids and
    repeated rows are rows like others; an empty table gives none.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("string").alias("id"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    digits = max(2, math.ceil(math.log(docs.count() / RANGE_ROWS + 1, 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    per = kit.stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "ranges")
    plan = targets(per.groupBy("source").agg(F.sum("n").alias("n")), weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(F.lit(1)).cast("long"))
    plan = plan.select(F.col("source").alias("of"), F.col("n").alias("source_size"), "target", "epochs", F.when(F.col("n") > 0, F.floor("target") - F.col("epochs") * F.col("n")).otherwise(F.lit(0)).cast("long").alias("rest"))
    ranges = per.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    ends = ranges.join(plan.select("of", "rest"), F.col("source").eqNullSafe(F.col("of"))).where("n > 0 AND base < rest").groupBy("source").agg(F.max(F.struct("bucket", "base")).alias("x"))
    ends = ends.select(F.col("source").alias("at"), F.col("x.bucket").alias("last"), F.col("x.base").alias("base"))
    plan = kit.stage(plan.join(ends, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "plan")
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))

    def taking(some: DataFrame, words, whole) -> DataFrame:
        return some.select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + words).alias("taken"), (F.col("epochs") + F.when(whole, 1).otherwise(0)).cast("int").alias("copies"))

    inside = F.coalesce(F.col("bucket") < F.col("last"), F.lit(False))
    whole = taking(known.where(~F.col("bucket").eqNullSafe(F.col("last"))), F.when(inside, F.col("size")).otherwise(0), inside)
    within = Window.partitionBy("source").orderBy("key", F.col("id").cast("long"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("rest") - (F.col("base") + F.col("upto") - F.col("size"))
    cut = taking(known.where(F.col("bucket") == F.col("last")).withColumn("upto", F.sum("size").over(within)), F.greatest(F.lit(0), F.least(room, F.col("size"))), 2 * room >= F.col("size"))
    return whole.unionByName(cut)


def op1(spark, sf_dir):
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
o AS (SELECT *, {SHARE} * sum(n) OVER () AS t,
             coalesce(sum({MOST} * n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
             sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS l FROM s),
f AS (SELECT *, w * (t - c) > {MOST} * n * l AS capped FROM o),
g AS (SELECT source, n, CASE WHEN capped THEN {MOST} * n ELSE
             w * (t - coalesce(sum({MOST} * n) FILTER (capped) OVER (), 0)) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 1 END AS e FROM g),
x AS (SELECT d.doc_id, d.size, p.n, p.target, p.e, floor(p.target) - p.e * p.n AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (e * size + greatest(0, least(rest - before, size)))::BIGINT AS taken FROM x
"""
