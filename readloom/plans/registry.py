"""The engine's own queries over the test tables, each with the SQL that gives the same rows.

Roles: documents are reads (their letters as bases, whole), benchmark passages are the library, lineitem rows are feature
calls of order pairs, events are records of molecules.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import align, counts, orient, pairs
from readloom.plans import jobs, scratch
from readloom.plans.config import CHEMISTRIES, REQUIRED, Config
from readloom.sources import bam, fastq, library, sinks
from readloom.sources.files import file_system

_MADE: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _MADE[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_MADE)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sequences ----------------------------------------------------------------------------------

_ABC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DNA = f"regexp_replace(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_ABC}', '{('ACGT' * 7)[:26] * 2}'), '[^ACGT]', '', 'g')"
_RC = "translate(reverse({}), 'ACGTUNacgtun', 'TGCAANtgcaaN')"


def dna(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", seq.dna_of_text(F.col("text")).alias("dna"))


_D = f"WITH d AS (SELECT doc_id, text, {_DNA} AS dna FROM documents) "


def _parts(base: str) -> str:
    p = f"((length(dna) - length(replace(dna, '{base}', ''))) / length(dna)::DOUBLE)"
    return f"CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0 END"


_ENTROPY = "CASE WHEN length(dna) = 0 THEN 0.0 ELSE " + " + ".join(f"({_parts(b)})" for b in "ACGT") + " END"
_QUALITY = "list_transform(string_split(dna, ''), lambda c: ascii(c) % 42)"


def quality():
    return F.transform(F.filter(F.split("dna", ""), lambda c: c != ""), lambda c: F.ascii(c) % 42)


@query("revcomp", _D + f"SELECT doc_id, {_RC.format('dna')} AS rc FROM d")
def _(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", seq.revcomp(F.col("dna")).alias("rc"))


@query("valid_bases", _D + "SELECT doc_id, regexp_full_match(dna, '[ACGTUNacgtun]*') AS dna_ok, regexp_full_match(text, '[ACGTUNacgtun]*') AS text_ok FROM d")
def _(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", seq.valid_bases(F.col("dna")).alias("dna_ok"), seq.valid_bases(F.col("text")).alias("text_ok"))


@query("rna_to_dna", "SELECT doc_id, translate(text, 'Uu', 'Tt') AS seq FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", seq.rna_to_dna(F.col("text")).alias("seq"))


@query("entropy", _D + f"SELECT doc_id, round({_ENTROPY}, 6) AS bits FROM d")
def _(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", F.round(seq.entropy(F.col("dna")), 6).alias("bits"))


@query("low_complexity", _D + f"SELECT doc_id FROM d WHERE length(dna) >= 40 AND {_ENTROPY} < 1.75")
def _(spark, sf_dir):
    return dna(spark, sf_dir).where((F.length("dna") >= seq.MIN_READ) & (seq.entropy(F.col("dna")) < seq.MIN_ENTROPY)).select("doc_id")


@query("orient_reads", _D + f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {_RC.format('dna')} ELSE dna END AS seq FROM d")
def _(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", seq.oriented(F.col("dna"), F.col("doc_id") % 2 == 1).alias("seq"))


@query("clip_adapter", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN substr(s, 1, 111) ELSE substr(s, 14, 111) END AS clipped, s AS kept FROM (SELECT c_custkey, rpad(c_name || c_mktsegment, 124, 'ACGT') AS s FROM customer)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.rpad(F.concat("c_name", "c_mktsegment"), 124, "ACGT").alias("s"))
    longer = F.concat("s", F.lit("A"))
    return rows.select("c_custkey", seq.clip_adapter(F.col("s"), F.col("c_custkey") % 2 == 1).alias("clipped"), F.substring(seq.clip_adapter(longer, F.col("c_custkey") % 2 == 1), 1, 124).alias("kept"))


@query("clip_quality", "SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 2 = 1 THEN list_reverse(q[1:111]) ELSE q[14:124] END, ',') AS q FROM (SELECT c_custkey, list_transform(string_split(rpad(c_name || c_mktsegment, 124, 'ACGT'), ''), lambda c: ascii(c) % 42) AS q FROM customer)")
def _(spark, sf_dir):
    text = F.rpad(F.concat("c_name", "c_mktsegment"), 124, "ACGT")
    q = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % 42)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(seq.clip_quality(q, F.col("c_custkey") % 2 == 1).cast("array<string>"), ",").alias("q"))


_LENGTHS, _QUALITIES = seq.trim_tables(40, 0.9)
_TRIM = (
    f", t AS (SELECT {_LENGTHS}::BIGINT[] AS l, {_QUALITIES}::BIGINT[] AS p), "
    f"u AS (SELECT doc_id, dna, unnest({_QUALITY}) AS q, generate_subscripts({_QUALITY}, 1) AS i FROM d WHERE dna <> ''), "
    "s AS (SELECT doc_id, dna, i, sum(p[least(q, 60) + 1]::HUGEINT) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(l[i], 0) AS score FROM u, t), "
    "b AS (SELECT doc_id, any_value(dna) AS dna, max(score) AS best, arg_max(i, score * 100000 + i) AS cut FROM s GROUP BY doc_id) "
)


@query("maxinfo", _D.rstrip() + _TRIM + "SELECT d.doc_id, CASE WHEN b.best IS NULL OR b.best = 0 THEN 0 ELSE cut END AS keep FROM d LEFT JOIN b USING (doc_id)")
def _(spark, sf_dir):
    return dna(spark, sf_dir).repartition("doc_id").select("doc_id", seq.maxinfo(quality(), 40, 0.9).alias("keep"))


@query("trim_reads", _D.rstrip() + _TRIM + "SELECT d.doc_id, substr(d.dna, 1, CASE WHEN b.best IS NULL OR b.best = 0 THEN 0 ELSE cut END) AS seq FROM d LEFT JOIN b USING (doc_id)")
def _(spark, sf_dir):
    return dna(spark, sf_dir).repartition("doc_id").select("doc_id", seq.trimmed(F.col("dna"), quality(), 40, 0.9).alias("seq"))


@query("norm_score", _D + "SELECT doc_id, CASE WHEN length(dna) > 0 THEN round(n_chars / length(dna)::DOUBLE, 6) ELSE 0 END AS norm FROM d JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", seq.dna_of_text(F.col("text")).alias("dna"))
    return rows.select("doc_id", F.round(seq.norm_score(F.col("n_chars"), F.col("dna")), 6).alias("norm"))


@query("read_key", _D + f"SELECT doc_id, md5(dna || CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_RC.format('dna')} END) AS key FROM d")
def _(spark, sf_dir):
    mate = F.when(F.col("doc_id") % 3 != 0, seq.revcomp(F.col("dna")))
    return dna(spark, sf_dir).select("doc_id", F.md5(seq.read_key(F.col("dna"), mate)).alias("key"))


@query("parse_calls", "SELECT p_partkey, p_brand AS feature, p_size % 2 = 0 AS is_rev FROM part")
def _(spark, sf_dir):
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "_rev").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", seq.parse_call(name).alias("c")).select("p_partkey", "c.feature", "c.is_rev")


@query("cell_barcode", "SELECT c_custkey, c_name AS cell FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", seq.cell_barcode(F.concat("c_name", F.lit("-1"))).alias("cell"))


@query("umi_choice", "SELECT event_id, coalesce(CASE WHEN user_id % 3 > 0 THEN event_type END, user_id::VARCHAR) AS umi FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", seq.umi_choice(F.when(F.col("user_id") % 3 > 0, F.col("event_type")), F.col("user_id").cast("string")).alias("umi"))


_NATURAL = "array_to_string(list_transform(regexp_extract_all({0}, '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '')"


@query("natural_sort", f"SELECT p_partkey, string_agg(x, ',' ORDER BY {_NATURAL.format('x')}, x) AS names FROM (SELECT p_partkey, unnest([p_brand, p_type, 'v' || p_size, 'v' || p_partkey]) AS x FROM part) GROUP BY p_partkey")
def _(spark, sf_dir):
    names = F.array("p_brand", "p_type", F.concat(F.lit("v"), "p_size"), F.concat(F.lit("v"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(seq.natural_sort(names), ",").alias("names"))


@query("threshold_percentage", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_quantity"))
    return counts.threshold_percentage(rows, 25).select("l_orderkey", "l_linenumber")


# ---- library and alignment ----------------------------------------------------------------------


def raw_library(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return rows.select(F.col("item_id").alias("row"), name("b", F.col("item_id")).alias("feature"), F.when(F.col("item_id") % 5 == 0, "").otherwise(name("g", F.col("item_id") % 7)).alias("grp"), seq.dna_of_text(F.col("text")).alias("sequence"))


def lib(spark, sf_dir, grouped: bool = False) -> DataFrame:
    rows = library.expand(raw_library(spark, sf_dir))
    return rows if grouped else rows.withColumn("grp", F.col("feature"))


_LIB = (
    f"b AS (SELECT item_id AS row, 'b' || item_id AS feature, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'g' || item_id % 7 END AS g, {_DNA} AS dna FROM benchmark), "
    f"lib AS (SELECT row * 2 AS ref_idx, feature, false AS is_rev, coalesce(nullif(g, ''), feature) AS grp, dna AS sequence FROM b UNION ALL SELECT row * 2 + 1, feature, true, coalesce(nullif(g, ''), feature), {_RC.format('dna')} FROM b), "
    "idx AS (SELECT ref_idx, p AS kpos, substr(sequence, p + 1, 30) AS kmer FROM (SELECT ref_idx, sequence, unnest(range(greatest(length(sequence) - 29, 0))) AS p FROM lib)) "
)


@query("library_scan", "WITH " + _LIB + "SELECT row, feature, g AS grp, dna AS sequence FROM b")
def _(spark, sf_dir):
    return raw_library(spark, sf_dir)


@query("library_expand", "WITH " + _LIB + "SELECT * FROM lib")
def _(spark, sf_dir):
    return lib(spark, sf_dir, True)


@query("kmer_index", "WITH " + _LIB + "SELECT kmer, string_agg(DISTINCT ref_idx::VARCHAR, ',' ORDER BY ref_idx::VARCHAR) AS refs, count(*) AS n FROM idx GROUP BY kmer")
def _(spark, sf_dir):
    rows = align.kmer_index(lib(spark, sf_dir))
    return rows.select("kmer", F.array_join(F.array_sort(F.col("colour").cast("array<string>")), ",").alias("refs"), F.size("places").cast("long").alias("n"))


def align_sql(reads: str) -> str:
    """CTEs: reads (read_id, seq) aligned as al (read_id, cls, score, mismatches), by the same rules."""
    return (
        f"reads AS ({reads}), "
        f"fit AS (SELECT * FROM reads WHERE length(seq) >= 40 AND {_ENTROPY.replace('dna', 'seq')} >= 1.75), "
        "rk AS (SELECT read_id, rpos, substr(seq, rpos + 1, 30) AS kmer FROM (SELECT read_id, seq, unnest(range(length(seq) - 29)) AS rpos FROM fit)), "
        "hit AS (SELECT rk.read_id, rk.rpos, idx.ref_idx, rk.rpos - idx.kpos AS diagonal FROM rk JOIN idx USING (kmer)), "
        "n AS (SELECT read_id, count(DISTINCT rpos) AS n FROM hit GROUP BY read_id), "
        "own AS (SELECT read_id, ref_idx FROM hit JOIN n USING (read_id) GROUP BY read_id, ref_idx, n.n HAVING count(DISTINCT rpos) = n.n), "
        "dg AS (SELECT DISTINCT read_id, ref_idx, diagonal FROM hit JOIN own USING (read_id, ref_idx)), "
        "ov AS (SELECT read_id, substr(seq, s + 1, e - s) AS x, substr(sequence, s - diagonal + 1, e - s) AS y, e - s AS n FROM (SELECT *, greatest(diagonal, 0) AS s, least(length(seq), length(sequence) + diagonal) AS e FROM dg JOIN reads USING (read_id) JOIN lib USING (ref_idx))), "
        "best AS (SELECT read_id, min((hamming(x, y)::BIGINT) * 100000000 - n) AS k FROM ov GROUP BY read_id), "
        "al AS (SELECT n.read_id, coalesce(c.cls, []) AS cls, coalesce((100000000 - k % 100000000) % 100000000, 0) AS score, coalesce(ceil(k / 100000000.0)::BIGINT, 0) AS mismatches FROM n "
        "LEFT JOIN (SELECT read_id, list(ref_idx ORDER BY ref_idx) AS cls FROM own GROUP BY read_id) c USING (read_id) LEFT JOIN best USING (read_id)) "
    )


_READS = "SELECT doc_id AS read_id, dna AS seq FROM d"


@query("pseudoalign", _D.rstrip() + ", " + _LIB.rstrip() + ", " + align_sql(_READS) + "SELECT read_id, array_to_string(cls, ',') AS cls, score, mismatches FROM al")
def _(spark, sf_dir):
    fit = dna(spark, sf_dir).select(F.col("doc_id").alias("read_id"), align.fitting(F.col("dna")).alias("seq"))
    return align.pseudoalign(fit, lib(spark, sf_dir)).select("read_id", F.array_join(F.col("cls").cast("array<string>"), ",").alias("cls"), F.col("score").cast("long").alias("score"), F.col("mismatches").cast("long").alias("mismatches"))


def reason_sql(cfg: Config) -> str:
    multiple = f"WHEN len(cls) > 1 THEN '{align.MULTIPLE}' " if cfg.discard_multiple_matches else ""
    nonzero = f"WHEN mismatches <> 0 THEN '{align.NONZERO}' " if cfg.discard_nonzero_mismatch else ""
    return (
        f"CASE WHEN length(seq) < 40 THEN '{align.SHORT}' WHEN {_ENTROPY.replace('dna', 'seq')} < 1.75 THEN '{align.COMPLEXITY}' WHEN al.read_id IS NULL THEN '{align.NO_MATCH}' {nonzero}"
        f"WHEN score < {cfg.score_threshold} OR score / length(seq)::DOUBLE < {cfg.score_percent} OR len(cls) = 0 THEN '{align.BELOW}' {multiple}WHEN mismatches > {cfg.num_mismatches} THEN '{align.ABOVE}' ELSE '{align.MATCH}' END"
    )


BASE = Config(score_threshold=60, score_percent=0.005, num_mismatches=0)


def _reasons(name: str, cfg: Config) -> None:
    @query(name, _D.rstrip() + ", " + _LIB.rstrip() + ", " + align_sql(_READS) + f"SELECT reads.read_id, {reason_sql(cfg)} AS reason, round(coalesce(score, 0) / greatest(length(seq), 1)::DOUBLE, 6) AS norm, coalesce(score, 0)::BIGINT AS score FROM reads LEFT JOIN al USING (read_id)")
    def _(spark, sf_dir):
        reads = dna(spark, sf_dir).select(F.col("doc_id").alias("read_id"), F.col("dna").alias("seq"))
        rows = align.align_reads(reads, lib(spark, sf_dir), cfg)
        return rows.select("read_id", "reason", F.round("norm", 6).alias("norm"), F.col("score").cast("long").alias("score"))


_reasons("reason_chain", BASE)
_reasons("reason_chain_multiple", Config(score_threshold=60, score_percent=0.005, num_mismatches=1, discard_multiple_matches=True))
_reasons("reason_chain_nonzero", Config(score_threshold=40, num_mismatches=3, discard_nonzero_mismatch=True))
_reasons("score_filter", Config(score_threshold=100, score_percent=0.08, num_mismatches=2))


def states_sql(calls: str) -> str:
    """CTE st (pair_id, feature, r1, r2), conflicts settled, from calls (pair_id, mate, feature, is_rev)."""
    state = "CASE WHEN count(*) FILTER (mate = {0}) = 0 OR count(DISTINCT is_rev) FILTER (mate = {0}) > 1 THEN 'U' WHEN bool_or(is_rev) FILTER (mate = {0}) THEN 'R' ELSE 'F' END"
    return f"calls AS ({calls}), st AS (SELECT * FROM (SELECT pair_id, feature, {state.format(1)} AS r1, {state.format(2)} AS r2 FROM calls GROUP BY pair_id, feature) WHERE r1 <> 'U' OR r2 <> 'U') "


def keeps_sql(chemistry: str) -> str:
    return "r1 || r2 IN (" + ", ".join(f"'{x}'" for x in orient.KEPT[chemistry]) + ")"


def sets_sql(cfg: Config, name: str = "feature") -> str:
    """CTEs down to tr (pair_id, features list, triage) from kept (pair_id, feature, r1, r2[, grp])."""
    shared = f"list_sort(list(DISTINCT {name}) FILTER (r1 <> 'U' AND r2 <> 'U'))"
    every = f"list_sort(list(DISTINCT {name}))"
    common = "count(*) FILTER (r1 <> 'U' AND r2 <> 'U')"
    names = {0: every, 1: f"CASE WHEN {common} > 0 THEN {shared} ELSE {every} END", 2: f"coalesce({shared}, [])"}[cfg.intersect_level]
    emptied = f"CASE WHEN len(names) > {cfg.discard_multi_hits} THEN [] ELSE names END" if cfg.discard_multi_hits else "names"
    key = _NATURAL.format("x")
    return (
        f"co AS (SELECT pair_id, {names} AS names, {common} = 0 AND {str(cfg.intersect_level == 2).lower()} AS failed FROM kept GROUP BY pair_id), "
        f"al2 AS (SELECT c.pair_id, coalesce({emptied}, []) AS names, coalesce(failed, {str(cfg.intersect_level == 2).lower()}) AS failed FROM called c LEFT JOIN co USING (pair_id)), "
        f"tr AS (SELECT a.pair_id, coalesce(s.f, '') AS features, CASE WHEN failed THEN '{align.FORCE_FAILED}' WHEN len(names) > {cfg.max_hits_to_report} THEN '{align.MAX_HITS}' WHEN len(names) = 0 THEN '{align.EMPTY}' ELSE '{align.MATCH}' END AS triage "
        f"FROM al2 a LEFT JOIN (SELECT pair_id, string_agg(x, ',' ORDER BY {key}, x) AS f FROM (SELECT pair_id, unnest(names) AS x FROM al2) GROUP BY pair_id) s USING (pair_id)) "
    )


def trace_sql(cfg: Config, paired: bool) -> str:
    mate = f"UNION ALL SELECT pair_id * 2 + 1, {_RC.format('dna')} FROM dd" if paired else ""
    pair = (
        ", vp AS (SELECT a.read_id // 2 AS pair_id FROM m a JOIN m b ON b.read_id = a.read_id + 1 AND a.read_id % 2 = 0 WHERE a.cls = b.cls AND len(a.cls) > 0) " if cfg.require_valid_pair else ""
    )
    only = " WHERE read_id // 2 IN (SELECT pair_id FROM vp)" if cfg.require_valid_pair else ""
    calls = f"SELECT read_id // 2 AS pair_id, read_id % 2 + 1 AS mate, feature, is_rev, grp FROM (SELECT read_id, unnest(cls) AS ref_idx FROM m{only}) JOIN lib USING (ref_idx)"
    return (
        _D.rstrip() + ", dd AS (SELECT max(doc_id) AS pair_id, dna FROM d GROUP BY dna), " + _LIB.rstrip() + ", "
        + align_sql("SELECT pair_id * 2 AS read_id, dna AS seq FROM dd " + mate).rstrip()
        + f", rs AS (SELECT reads.read_id, {reason_sql(cfg)} AS reason, coalesce(score, 0)::BIGINT AS score, cls FROM reads LEFT JOIN al USING (read_id)), m AS (SELECT * FROM rs WHERE reason = '{align.MATCH}')" + pair + ", "
        + states_sql(calls).rstrip()
        + f", called AS (SELECT DISTINCT pair_id FROM calls), kept AS (SELECT st.*, g.grp FROM st JOIN (SELECT DISTINCT feature, grp FROM lib) g USING (feature) WHERE {keeps_sql(cfg.chemistry)}), "
    )


def pairs_of(spark, sf_dir, paired: bool) -> DataFrame:
    rows = dna(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("pair_id"), F.col("dna").alias("r1"), (seq.revcomp(F.col("dna")) if paired else F.lit(None).cast("string")).alias("r2"))


def _counts(name: str, cfg: Config, paired: bool, grouped: bool) -> None:
    sql = trace_sql(cfg, paired) + sets_sql(cfg, "grp" if grouped else "feature") + f"SELECT features, count(*) AS score FROM tr WHERE triage = '{align.MATCH}' GROUP BY features"

    @query(name, sql)
    def _(spark, sf_dir):
        found = counts.sorted_counts(pairs_of(spark, sf_dir, paired), lib(spark, sf_dir, grouped), cfg)
        return found.select(F.array_join("features", ",").alias("features"), "score")


_counts("feature_counts", BASE, False, False)
_counts("sorted_counts", Config(score_threshold=40, num_mismatches=1), False, False)
_counts("counts_mismatch_2", Config(score_threshold=40, num_mismatches=2), False, False)
_counts("group_rollup", Config(score_threshold=40, num_mismatches=2), False, True)
for _chem in CHEMISTRIES:
    _counts(f"counts_paired_{_chem}", Config(score_threshold=40, num_mismatches=1, chemistry=_chem), True, False)
_counts("counts_paired_fallback", Config(score_threshold=40, num_mismatches=1, chemistry="unstranded", intersect_level=1), True, True)
_counts("counts_paired_force", Config(score_threshold=40, num_mismatches=1, chemistry="none", intersect_level=2, discard_multi_hits=1), True, False)
_counts("counts_valid_pair", Config(score_threshold=40, num_mismatches=1, require_valid_pair=True), True, False)


def _audit(name: str, cfg: Config) -> None:
    sql = (
        trace_sql(cfg, True) + sets_sql(cfg)
        + "SELECT a.read_id // 2 AS pair_id, a.reason AS r1_filter_forward, CASE WHEN a.reason = 'Successful Match' THEN a.score ELSE 0 END AS r1_forward_score, a.score AS r1_true_score, b.reason AS r2_filter_forward, "
        "CASE WHEN b.reason = 'Successful Match' THEN b.score ELSE 0 END AS r2_forward_score, b.score AS r2_true_score, coalesce(triage, 'None') AS triage_reason, coalesce(features, '') AS features "
        "FROM rs a JOIN rs b ON b.read_id = a.read_id + 1 AND a.read_id % 2 = 0 LEFT JOIN tr ON tr.pair_id = a.read_id // 2"
    )

    @query(name, sql)
    def _(spark, sf_dir):
        rows = counts.audit(pairs_of(spark, sf_dir, True), lib(spark, sf_dir), cfg)
        return rows.withColumns({c: F.col(c).cast("long") for c in rows.columns if c.endswith("score")})


_audit("audit_rows", Config(score_threshold=60, score_percent=0.005, chemistry="fiveprime"))


@query("multi_library", None)
def _(spark, sf_dir):
    p = pairs_of(spark, sf_dir, False)
    found = counts.many_libraries(p, [("plain", lib(spark, sf_dir), BASE), ("grouped", lib(spark, sf_dir, True), Config(score_threshold=40, num_mismatches=2))])
    return found.select("library", F.array_join("features", ",").alias("features"), "score")


_SQL["multi_library"] = f"SELECT 'plain' AS library, features, score FROM ({_SQL['feature_counts']}) UNION ALL SELECT 'grouped', features, score FROM ({_SQL['group_rollup']})"


@query("dedup_reads", _D + "SELECT max(doc_id) AS pair_id, count(*) AS copies FROM d GROUP BY dna")
def _(spark, sf_dir):
    return counts.dedup_pairs(pairs_of(spark, sf_dir, False)).select("pair_id", "copies")


@query("counts_tsv", f"SELECT features || chr(9) || score AS value FROM ({_SQL['feature_counts']})")
def _(spark, sf_dir):
    return sinks.counts_lines(counts.feature_counts(pairs_of(spark, sf_dir, False), lib(spark, sf_dir), BASE))


# ---- calls --------------------------------------------------------------------------------------

_CALLS = "SELECT l_orderkey AS pair_id, (l_linenumber - 1) % 2 + 1 AS mate, 'f' || l_partkey % 4 AS feature, l_suppkey % 2 = 1 AS is_rev FROM lineitem"


def calls(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("pair_id"), ((F.col("l_linenumber") - 1) % 2 + 1).alias("mate"), F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")).alias("feature"), (F.col("l_suppkey") % 2 == 1).alias("is_rev"))


@query("strand_conflict", f"WITH c AS ({_CALLS}) SELECT c.* FROM c JOIN (SELECT pair_id, mate, feature FROM c GROUP BY ALL HAVING count(DISTINCT is_rev) = 1) k USING (pair_id, mate, feature)")
def _(spark, sf_dir):
    return orient.strand_conflict(calls(spark, sf_dir)).select("pair_id", "mate", "feature", "is_rev")


def _orient(chemistry: str) -> None:
    @query(f"orient_{chemistry}", "WITH " + states_sql(_CALLS) + f"SELECT * FROM st WHERE {keeps_sql(chemistry)}")
    def _(spark, sf_dir):
        return orient.orient(calls(spark, sf_dir), chemistry)


for _chem in CHEMISTRIES:
    _orient(_chem)


def _sets(name: str, cfg: Config) -> None:
    sql = "WITH " + states_sql(_CALLS).rstrip() + f", called AS (SELECT DISTINCT pair_id FROM st WHERE {keeps_sql(cfg.chemistry)}), kept AS (SELECT * FROM st WHERE {keeps_sql(cfg.chemistry)}), " + sets_sql(cfg) + "SELECT pair_id, features, triage FROM tr"

    @query(name, sql)
    def _(spark, sf_dir):
        rows = orient.triage(orient.coerce(orient.orient(calls(spark, sf_dir), cfg.chemistry), cfg.intersect_level), cfg)
        return rows.select("pair_id", F.array_join("features", ",").alias("features"), "triage")


_sets("union_calls", Config())
_sets("intersect_fallback", Config(intersect_level=1))
_sets("force_intersect", Config(intersect_level=2))
_sets("max_hits", Config(max_hits_to_report=1))
_sets("multi_hit_discard", Config(discard_multi_hits=2, chemistry="unstranded"))
_sets("triage", Config(discard_multi_hits=3, max_hits_to_report=2, intersect_level=1))


@query("intersect_calls", "WITH " + states_sql(_CALLS) + "SELECT pair_id, feature FROM st WHERE r1 <> 'U' AND r2 <> 'U'")
def _(spark, sf_dir):
    rows = orient.coerce(orient.orient(calls(spark, sf_dir), "none"), 2)
    return rows.select("pair_id", F.explode("names").alias("feature"))


_CLS = "SELECT pair_id, mate, list_sort(list(DISTINCT feature)) AS cls FROM (" + _CALLS + ") GROUP BY pair_id, mate"


@query("valid_pair", f"WITH c AS ({_CLS}) SELECT a.pair_id, coalesce(a.cls = b.cls, false) AS ok FROM (SELECT * FROM c WHERE mate = 1) a LEFT JOIN (SELECT * FROM c WHERE mate = 2) b USING (pair_id)")
def _(spark, sf_dir):
    side = lambda m: F.collect_set(F.when(F.col("mate") == m, F.col("feature")))
    rows = calls(spark, sf_dir).groupBy("pair_id").agg(side(1).alias("a"), side(2).alias("b")).where(F.size("a") > 0)
    return rows.select("pair_id", counts.valid_pair(F.col("a"), F.col("b")).alias("ok"))


@query("feature_names", "WITH " + _LIB + "SELECT o_orderkey AS id, string_agg(DISTINCT grp, ',' ORDER BY grp) AS names FROM (SELECT o_orderkey, unnest([o_custkey % 40, o_orderkey % 40]) AS ref_idx FROM orders) JOIN lib USING (ref_idx) GROUP BY o_orderkey")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 40, F.col("o_orderkey") % 40).alias("cls"))
    named = orient.feature_names(rows, lib(spark, sf_dir, True), "grp")
    return named.select("id", F.array_join(F.array_sort("names"), ",").alias("names"))


@query("unmap_features", "WITH " + _LIB + "SELECT c.feature AS name, ref_idx, count(*) AS n FROM (SELECT 'b' || l_partkey % 40 AS feature FROM lineitem) c JOIN (SELECT feature, min(ref_idx) AS ref_idx FROM lib GROUP BY feature) USING (feature) GROUP BY ALL")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), (F.col("l_partkey") % 40).cast("string")).alias("name"))
    return orient.unmap(names, lib(spark, sf_dir)).groupBy("name", "ref_idx").agg(F.count("*").alias("n"))


# ---- records ------------------------------------------------------------------------------------

_EVENTS = (
    "SELECT event_id AS file_pos, 'f' || user_id % 9 AS file, CASE WHEN user_id % 13 = 5 THEN 'AAAAAAAAAA' ELSE event_type END AS umi, 'c' || user_id % 5 AS cell, 'q' || user_id % 50 AS qname, event_id % 2 = 0 AS first, user_id % 4 > 0 AS paired, "
    "CASE WHEN user_id % 11 > 0 THEN 'c' || user_id % 5 || '-1' END AS cb FROM events"
)


def records(spark, sf_dir) -> DataFrame:
    rows, text = table(spark, sf_dir, "events"), lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    return rows.select(F.col("event_id").alias("file_pos"), text("f", 9).alias("file"), F.when(F.col("user_id") % 13 == 5, pairs.POLY_A).otherwise(F.col("event_type")).alias("umi"), text("c", 5).alias("cell"), text("q", 50).alias("qname"), (F.col("event_id") % 2 == 0).alias("first"), (F.col("user_id") % 4 > 0).alias("paired"), F.when(F.col("user_id") % 11 > 0, F.concat(text("c", 5), F.lit("-1"))).alias("cb"))


@query("mate_join", _D + f"SELECT doc_id AS record_no, md5(dna || {_RC.format('dna')}) AS both FROM d")
def _(spark, sf_dir):
    rows = dna(spark, sf_dir).select(F.col("doc_id").alias("record_no"), F.col("dna").alias("seq"))
    found = pairs.mate_join(rows, rows.withColumn("seq", seq.revcomp(F.col("seq"))))
    return found.select("record_no", F.md5(F.concat("r1", "r2")).alias("both"))


@query("umi_filters", f"SELECT file_pos FROM ({_EVENTS}) WHERE cb IS NOT NULL AND umi <> 'AAAAAAAAAA' AND paired")
def _(spark, sf_dir):
    return pairs.umi_filters(records(spark, sf_dir), True).select("file_pos")


_RUNS = f"WITH r AS ({_EVENTS}), w AS (SELECT *, lag(umi) OVER o IS DISTINCT FROM umi OR lag(cell) OVER o IS DISTINCT FROM cell AS new FROM r WINDOW o AS (PARTITION BY file ORDER BY file_pos)) "


@query("umi_groups", _RUNS + "SELECT file_pos, max(CASE WHEN new THEN file_pos END) OVER (PARTITION BY file ORDER BY file_pos) AS grp FROM w")
def _(spark, sf_dir):
    return pairs.umi_groups(records(spark, sf_dir)).select("file_pos", "grp")


@query("dummy_mates", f"SELECT file_pos, false AS skip FROM ({_EVENTS}) UNION ALL SELECT file_pos, true FROM ({_EVENTS}) WHERE NOT paired")
def _(spark, sf_dir):
    return pairs.dummy_mates(records(spark, sf_dir)).select("file_pos", "skip")


@query(
    "pair_by_name",
    f"WITH r AS (SELECT *, row_number() OVER o AS n, lag(qname) OVER o AS prev FROM ({_EVENTS}) WINDOW o AS (PARTITION BY file, umi, cell ORDER BY file_pos)), "
    "s AS (SELECT *, max(CASE WHEN qname IS DISTINCT FROM prev THEN n END) OVER (PARTITION BY file, umi, cell ORDER BY n) AS start FROM r) "
    "SELECT file, umi, cell, qname, arg_min(file_pos, CASE WHEN first THEN 0 ELSE 1000000000 END + file_pos) AS pos1, arg_max(file_pos, CASE WHEN first THEN 0 ELSE 1000000000 END + file_pos) AS pos2 FROM s GROUP BY file, umi, cell, qname, start, (n - start) // 2 HAVING count(*) = 2",
)
def _(spark, sf_dir):
    return pairs.pair_by_name(records(spark, sf_dir))


@query("umi_counts", "SELECT 'lib' AS library, event_type AS umi, 'c' || user_id % 5 AS cell, 'v' || (user_id % 3) AS features, count(DISTINCT props) AS score FROM events GROUP BY ALL")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("lib").alias("library"), F.col("event_type").alias("umi"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("cell"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("features"), F.col("props").alias("read_key"))
    return pairs.umi_counts(rows)


_SCORED = f"SELECT DISTINCT umi, cell, qname FROM ({_EVENTS}) WHERE paired AND first"


@query("unscored_pairs", f"WITH p AS (SELECT DISTINCT umi, cell, qname FROM ({_EVENTS})), s AS ({_SCORED}) SELECT p.*, '' AS features, 0::BIGINT AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.umi = p.umi AND s.cell = p.cell AND s.qname = p.qname) AND EXISTS (SELECT 1 FROM s WHERE s.umi = p.umi AND s.cell = p.cell)")
def _(spark, sf_dir):
    rows = records(spark, sf_dir)
    keys = ["umi", "cell", "qname"]
    return pairs.unscored(rows.select(*keys).distinct(), rows.where("paired AND first").select(*keys).distinct()).select(*keys, "features", "score")


@query("audit_join", f"WITH a AS (SELECT umi, cell, qname AS read_key, max(file_pos) AS reason_score FROM ({_EVENTS}) WHERE paired GROUP BY ALL) SELECT r.file_pos, CASE WHEN a.umi IS NULL THEN 'None' ELSE 'Seen' END AS reason, coalesce(a.reason_score, 0) AS reason_score FROM ({_EVENTS}) r LEFT JOIN a ON a.umi = r.umi AND a.cell = r.cell AND a.read_key = r.qname")
def _(spark, sf_dir):
    rows = records(spark, sf_dir).withColumnRenamed("qname", "read_key")
    seen = rows.where("paired").groupBy("umi", "cell", "read_key").agg(F.max("file_pos").alias("reason_score")).withColumn("reason", F.lit("Seen"))
    return pairs.audit_join(rows, seen).select("file_pos", "reason", "reason_score")


@query("read_audit", f"SELECT qname AS read_key, arg_max(umi, file_pos) AS reason, max(file_pos) AS score FROM ({_EVENTS}) GROUP BY qname")
def _(spark, sf_dir):
    rows = records(spark, sf_dir).select(F.col("qname").alias("read_key"), F.col("umi").alias("reason"), F.col("file_pos").alias("score"), F.col("file_pos").alias("seq_no"))
    return pairs.last_reason(rows)


# ---- files --------------------------------------------------------------------------------------


@query("fastq_scan", _D + "SELECT 'd' || doc_id AS name, dna AS seq, length(dna)::BIGINT AS n FROM d")
def _(spark, sf_dir):
    out = scratch.path(spark, "fastq")
    rows = dna(spark, sf_dir)
    rows.select(F.concat(F.lit("@d"), F.col("doc_id").cast("string"), F.lit("\n"), "dna", F.lit("\n+\n"), F.translate("dna", "ACGT", "IJ!5")).alias("value")).write.text(out)
    return fastq.read_fastq(spark, out).select("name", "seq", F.length("qual").cast("long").alias("n"))


def _bam_file(folder: str, record):
    """Each task writes its rows as one file, named by its number, so that a repeated attempt replaces it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        system, base = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.bam"
        with system.open_output_stream(f"{base}/{name}") as f:
            for block in bam.encoded(x for b in batches for r in b.to_pylist() for x in record(r)):
                f.write(block)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return run


def written_bam(rows: DataFrame, record) -> DataFrame:
    """The alignments of BAM files that hold what record() makes of each row."""
    spark = rows.sparkSession
    out = scratch.path(spark, "bam")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows.mapInArrow(_bam_file(out, record), "file string").count()
    return bam.read_bam(spark, out)


def bam_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cell"), F.translate(F.lpad(F.col("c_custkey").cast("string"), 11, "0"), "0123456789", "ACGTACGTAC").alias("seq"))
    return written_bam(rows, lambda r: [(r["name"], 16 * (r["id"] % 2) + 4, -1, -1, 0, "", -1, -1, 0, r["seq"], [r["id"] % 40] * len(r["seq"]), {"CB": r["cell"], "UR": r["name"]})])


_BAM = "SELECT c_name AS qname, (16 * (c_custkey % 2) + 4)::INTEGER AS flag, translate(lpad(c_custkey::VARCHAR, 11, '0'), '0123456789', 'ACGTACGTAC') AS seq, c_mktsegment AS cb, c_custkey % 40 AS q FROM customer"


@query("bam_scan", f"SELECT qname, flag, seq, cb FROM ({_BAM})")
def _(spark, sf_dir):
    return bam_rows(spark, sf_dir).select("qname", "flag", "seq", F.col("tags")["CB"].alias("cb"))


@query("record_projection", f"SELECT qname AS \"QNAME\", seq AS \"SEQ\", cb AS \"CB\", qname AS \"UR\", '' AS \"UB\", CASE WHEN flag >= 16 THEN 'true' ELSE 'false' END AS \"REVERSE\", CASE WHEN flag >= 16 THEN '-' ELSE '+' END AS \"STRAND\", repeat(chr((q + 33)::INTEGER), length(seq)) AS \"QUAL\", length(seq)::VARCHAR AS \"SEQ_LEN\" FROM ({_BAM})")
def _(spark, sf_dir):
    return bam.project(bam_rows(spark, sf_dir)).select("QNAME", "SEQ", "CB", "UR", "UB", "REVERSE", "STRAND", "QUAL", "SEQ_LEN")


def library_file(spark, sf_dir, cfg: Config) -> tuple[Config, DataFrame]:
    """The benchmark's passages as a library file, written and loaded."""
    settings = {k: getattr(cfg, k) for k in REQUIRED} | {"group_on": "grp"}
    columns = raw_library(spark, sf_dir).orderBy("row").agg(*[F.collect_list(F.col(c).cast("string")) for c in ("feature", "grp", "sequence", "row")])
    text = columns.select(F.to_json(F.struct(F.array(*[F.lit(x) for x in ("sequence_name", "grp", "sequence", "number")]).alias("headers"), F.array(*[F.col(f"`{c}`") for c in columns.columns]).alias("columns"))).alias("t"))
    out = scratch.path(spark, "library")
    text.select(F.concat(F.lit("[" + json.dumps(settings) + ","), "t", F.lit("]")).alias("value")).coalesce(1).write.text(out)
    return library.load_library(spark, out, cfg.chemistry)


@query("library_file", "WITH " + _LIB + "SELECT ref_idx, feature, is_rev, grp, sequence, 60 AS score_threshold, 40 AS trim_target_length FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, item_id FROM benchmark) JOIN lib ON ref_idx // 2 = item_id")
def _(spark, sf_dir):
    cfg, rows = library_file(spark, sf_dir, BASE)
    number = F.regexp_extract("feature", "[0-9]+", 0).cast("long") * 2 + F.col("is_rev").cast("long")
    return rows.select(number.alias("ref_idx"), "feature", "is_rev", "grp", "sequence", F.lit(cfg.score_threshold).alias("score_threshold"), F.lit(cfg.trim_target_length).alias("trim_target_length"))


_BAM_CONFIG = Config(score_threshold=40, num_mismatches=1, chemistry="unstranded")
_SHOWN = "CASE WHEN {0}.reason = '" + align.MATCH + "' THEN {0}.score ELSE 0 END"


@query(
    "bam_audit",
    _D.rstrip() + ", " + _LIB.rstrip()
    + f", p AS (SELECT doc_id AS pair_id, 'U' || doc_id // 3 AS umi, 'c' || doc_id // 3 % 5 AS cell, 'q' || doc_id AS qname, doc_id % 4 = 0 AS lone, substr(dna, 1, 120) AS a, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {_RC.format('substr(dna, 61, 120)')} END AS b FROM (SELECT doc_id, dna FROM d UNION ALL SELECT 3000000 + row, dna FROM b) WHERE length(dna) >= 70), "
    + align_sql("SELECT pair_id * 2 AS read_id, a AS seq FROM p UNION ALL SELECT pair_id * 2 + 1, b FROM p WHERE NOT lone").rstrip()
    + f", rs AS (SELECT reads.read_id, {reason_sql(_BAM_CONFIG)} AS reason, coalesce(score, 0)::BIGINT AS score, cls FROM reads LEFT JOIN al USING (read_id)), m AS (SELECT * FROM rs WHERE reason = '{align.MATCH}'), "
    + states_sql("SELECT read_id // 2 AS pair_id, read_id % 2 + 1 AS mate, feature, is_rev, feature AS grp FROM (SELECT read_id, unnest(cls) AS ref_idx FROM m) JOIN lib USING (ref_idx)").rstrip()
    + f", called AS (SELECT DISTINCT pair_id FROM calls), kept AS (SELECT st.* FROM st WHERE {keeps_sql('unstranded')}), "
    + sets_sql(_BAM_CONFIG)
    + f", rep AS (SELECT umi, cell, a, b, max(pair_id) AS pair_id FROM p GROUP BY ALL), f AS (SELECT umi, cell, features, count(*) AS score, max(pair_id) AS pair_id FROM rep JOIN tr USING (pair_id) WHERE triage = '{align.MATCH}' GROUP BY ALL), "
    "x AS (SELECT features, score, pair_id, pair_id AS audited FROM f UNION ALL SELECT '', 0, p.pair_id, rep.pair_id FROM p JOIN rep USING (umi, cell, a, b) WHERE umi IN (SELECT umi FROM f) AND p.pair_id NOT IN (SELECT pair_id FROM f)) "
    "SELECT x.features, x.score, qname AS \"r1_QNAME\", cell || '-1' AS \"r1_CB\", umi AS \"r2_UB\", CASE WHEN lone THEN 'TRUE' ELSE 'FALSE' END AS \"r2_SKIP_ALIGN\", "
    f"r1.reason AS r1_filter_forward, {_SHOWN.format('r1')} AS r1_forward_score, CASE WHEN lone THEN '{align.DUMMY}' ELSE r2.reason END AS r2_filter_forward, coalesce({_SHOWN.format('r2')}, 0) AS r2_forward_score, "
    f"CASE WHEN coalesce(triage, '{align.MATCH}') = '{align.MATCH}' THEN 'None' ELSE triage END AS triage_reason, 'None' AS aligndirection "
    "FROM x JOIN p USING (pair_id) JOIN rs r1 ON r1.read_id = audited * 2 LEFT JOIN rs r2 ON r2.read_id = audited * 2 + 1 LEFT JOIN (SELECT pair_id AS audited, triage FROM tr) t USING (audited)",
)
def _(spark, sf_dir):
    passages = raw_library(spark, sf_dir).select((F.col("row") + 3_000_000).alias("doc_id"), F.col("sequence").alias("dna"))
    rows = dna(spark, sf_dir).select("doc_id", "dna").unionAll(passages).where(F.length("dna") >= 70).select("doc_id", F.substring("dna", 1, 120).alias("a"), F.substring("dna", 61, 120).alias("b"))
    rows = rows.repartition(F.floor(F.col("doc_id") / 3)).sortWithinPartitions("doc_id")

    def record(r):
        k = r["doc_id"]
        one = lambda flag, s: (f"q{k}", flag, -1, -1, 0, "", -1, -1, 0, s, None, {"CB": f"c{k // 3 % 5}-1", "UB": f"U{k // 3}"})
        return [one(0, r["a"])] if k % 4 == 0 else [one(65, r["a"]), one(145, r["b"])]

    found = jobs.bam_result(written_bam(rows, record), lib(spark, sf_dir), _BAM_CONFIG)
    shown = ("features", "score", "r1_QNAME", "r1_CB", "r2_UB", "r2_SKIP_ALIGN", "r1_filter_forward", "r1_forward_score", "r2_filter_forward", "r2_forward_score", "triage_reason", "aligndirection")
    return found.select(*[F.col(c).cast("long").alias(c) if c.endswith("score") else c for c in shown])
