"""Column functions on sequences."""

import math

import pytest
from pyspark.sql import functions as F

from readloom.functions import seq


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return row.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("s", "want"), [("ATGC", "GCAT"), ("CCGGTTAA", "TTAACCGG"), ("", ""), ("acgun", "Nacgt"), (None, None)])
def test_revcomp(spark, s, want):
    assert one(spark, seq.revcomp(F.col("s")), s=s) == want


def test_valid_bases(spark):
    assert one(spark, seq.valid_bases(F.col("s")), s="ACGTUNacgtun") and not one(spark, seq.valid_bases(F.col("s")), s="ATGX")


@pytest.mark.parametrize(("s", "want"), [("", 0), ("A", 0), ("AT", 1), ("ATCG", 2), ("AAAT", 0.811278), ("NNAT", 1.0)])
def test_entropy(spark, s, want):
    assert one(spark, seq.entropy(F.col("s")), s=s) == pytest.approx(want, abs=1e-6)


HIGH, LOW = [40] * 20, [0] * 20


@pytest.mark.parametrize(("quality", "target", "strictness", "want"), [(HIGH, 15, 0.5, 20), (LOW, 15, 0.9, 1), ([40] * 6 + [0] * 6 + [40] * 6, 15, 0.7, 6), (HIGH, 15, 1.0, 20), (HIGH, 15, 0.0, 20), ([], 15, 0.5, 0)])
def test_maxinfo(spark, quality, target, strictness, want):
    assert one(spark, seq.maxinfo(F.col("q"), target, strictness), q=quality) == want


def test_maxinfo_equals_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    for target, strictness in ((30, 0.8), (5, 0.2), (800, 0.4)):
        lengths, qualities = seq.trim_tables(target, strictness)
        rows = [[rng.choice((2, 10, 30, 41, 70)) for _ in range(rng.randrange(1, 90))] for _ in range(20)]
        df = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q array<int>")
        for r in df.select("i", seq.maxinfo(F.col("q"), target, strictness).alias("x")).collect():
            total, best, at = 0, -math.inf, 0
            for k, q in enumerate(rows[r["i"]]):
                total += qualities[min(q, 60)]
                if lengths[k] + total >= best:
                    best, at = lengths[k] + total, k + 1
            assert r["x"] == at


def test_trimming_and_clipping(spark):
    s = "".join("ACGT"[k % 4] for k in range(124))
    assert one(spark, seq.clip_adapter(F.col("s"), F.lit(False)), s=s) == s[13:]
    assert one(spark, seq.clip_adapter(F.col("s"), F.lit(True)), s=s) == s[:111]
    assert one(spark, seq.clip_adapter(F.col("s"), F.lit(True)), s=s[:100]) == s[:100]
    q = list(range(124))
    assert one(spark, seq.clip_quality(F.col("q"), F.lit(True)), q=q) == q[:111][::-1]
    assert one(spark, seq.clip_quality(F.col("q"), F.lit(False)), q=q) == q[13:]
    assert one(spark, seq.trimmed(F.col("s"), F.lit(None).cast("array<int>"), 15, 0.5), s=s) == s


def test_names_and_tags(spark):
    names = F.split(F.col("s"), ",")
    assert one(spark, seq.natural_sort(names), s="A10,A2,A1,B1,A2b") == ["A1", "A2", "A2b", "A10", "B1"]
    assert one(spark, seq.parse_call(F.col("s")), s="gene_rev").asDict() == {"feature": "gene", "is_rev": True}
    assert one(spark, seq.parse_call(F.col("s")), s="gene").asDict() == {"feature": "gene", "is_rev": False}
    assert one(spark, seq.cell_barcode(F.col("s")), s="ACGT-1") == "ACGT"
    assert one(spark, seq.umi_choice(F.lit(None).cast("string"), F.col("s")), s="TT") == "TT"
    with pytest.raises(Exception, match="UMI"):
        one(spark, seq.umi_choice(F.lit(None).cast("string"), F.when(F.lit(False), F.col("s"))), s="TT")
    assert one(spark, seq.kmers(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"] and one(spark, seq.kmers(F.col("s"), 3), s="AC") == []
    assert one(spark, seq.phred(F.col("s")), s="I!") == [40, 0]
