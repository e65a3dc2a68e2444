"""From documents to packed training sequences.

Every stage works on all rows that its predecessor kept, read back from Parquet in the shared folder:

1. language ID: documents without a letter, or whose best language scores under MIN_SCORE, go
2. n-gram Jaccard join: one document of each group of near copies stays, the one with the smallest doc_id
3. suffix-array dedup: passages of 200 bytes that still occur elsewhere are cut out; a document that loses all its text goes
4. mixing: sources are taken to their target weights in whole documents, repeated where the target asks for it
5. best-fit packing: every document that is left is packed into sequences of 2048 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import jaccard, kit, langid, mixing, packing, suffix_dedup

MIN_SCORE = 0.2
#: No SQL expresses the stages; they are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.strip(docs).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    text = F.coalesce("kept", "row.text")
    now = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[now[c].alias(c) if now.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, kit.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        kit.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
