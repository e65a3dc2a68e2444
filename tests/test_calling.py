"""Library files, alignment, orientation and counting against expectations stated by hand."""

import itertools
import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import align, counts, orient, pairs, screen
from readloom.plans import scratch
from readloom.plans.config import CHEMISTRIES, Config, trim_overrides
from readloom.sources import bam, fastq, library, sinks

CONFIG = {"score_percent": 0.33, "score_filter": 0, "score_threshold": 50, "num_mismatches": 0, "discard_multiple_matches": False, "require_valid_pair": False, "discard_multi_hits": 0, "intersect_level": 0, "max_hits_to_report": 10, "group_on": "", "trim_target_length": 40, "trim_strictness": 0.9, "data_type": "ignored"}
RNG = random.Random(11)
dna = lambda n: "".join(RNG.choice("ACGT") for _ in range(n))
RC = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
GENE = dna(180)
ONE = GENE[:90] + ("A" if GENE[90] != "A" else "C") + GENE[91:]
OTHER = dna(180)


def text(names, seqs, groups=None, **changes):
    return json.dumps([CONFIG | changes, {"headers": ["sequence_name", "sequence", "lineage"], "columns": [names, seqs, groups or [""] * len(names)]}])


def load(spark, tmp_path, *args, **changes):
    path = tmp_path / "library.json"
    path.write_text(text(*args, **changes))
    return library.load_library(spark, str(path))


def run(spark, reads, lib, cfg):
    rows = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r, None))) for k, r in enumerate(reads)], "pair_id long, r1 string, r2 string")
    return {tuple(r["features"]): r["score"] for r in counts.feature_counts(rows, lib, cfg).collect()}


def test_library_is_checked():
    cfg, rows = library.parse(text(["a", "b"], ["ACGU", "uuNn"], ["g", ""], group_on="lineage"))
    assert [r[3] for r in rows] == ["ACGT", "ttNn"] and [r[2] for r in rows] == ["g", ""] and cfg.group_on == "lineage"
    for broken in ("no json", "[]", text(["a", "a"], ["A", "C"]), text(["a"], ["XYZ"]), text(["a"], ["A"], score_percent=2), text(["a"], ["A"], intersect_level=3), text(["a"], ["A"], num_mismatches=-1), text(["a"], ["A"], group_on="none"), text(["a"], [5]), text(["a", "b"], ["A"]), json.dumps([{k: v for k, v in CONFIG.items() if k != "score_percent"}, {}])):
        with pytest.raises(ValueError):
            library.parse(broken)
    assert library.column_index(["x", "y", "x"], "x") == 0 and library.column_index([], "x") is None
    changed = trim_overrides("20:0.5,30:0.25", [Config(), Config()])
    assert [(c.trim_target_length, c.trim_strictness) for c in changed] == [(20, 0.5), (30, 0.25)]


def test_expansion_interleaves_both_strands(spark, tmp_path):
    _, lib = load(spark, tmp_path, ["a", "b"], [GENE, OTHER])
    got = [tuple(r) for r in lib.orderBy("ref_idx").collect()]
    assert got == [(0, "a", False, "a", GENE), (1, "a", True, "a", RC(GENE)), (2, "b", False, "b", OTHER), (3, "b", True, "b", RC(OTHER))]


def test_variants_overhangs_and_mismatch_caps(spark, tmp_path):
    _, lib = load(spark, tmp_path, ["v0", "v1", "w", "lc"], [GENE, ONE, OTHER, GENE.lower()])
    reads = [GENE[40:140], ONE[40:140], ONE[60:] + "ACCATTGACCATGG"[:12], GENE[:85]]
    assert run(spark, reads, lib, Config(score_threshold=50, score_percent=0.33)) == {("lc", "v0"): 1, ("v1",): 2, ("lc", "v0", "v1"): 1}
    changed = ONE[40:80] + "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in ONE[80:81]) + ONE[81:140]
    found = {n: run(spark, [ONE[40:140], changed], lib, Config(score_threshold=50, num_mismatches=n)) for n in (0, 1)}
    assert found[0] == {("v1",): 1} and found[1] == {("v1",): 2}
    assert run(spark, [RC(x) for x in reads[:2]], lib, Config(score_threshold=50)) == {("lc", "v0"): 1, ("v1",): 1}


def test_rollup_and_caps(spark, tmp_path):
    cfg, lib = load(spark, tmp_path, ["v0", "v1", "w"], [GENE, ONE, OTHER], ["g1", "g1", ""], group_on="lineage")
    assert run(spark, [GENE[:85], OTHER[:80]], lib, cfg) == {("g1",): 1, ("w",): 1}
    _, plain = load(spark, tmp_path, ["v0", "v1", "w"], [GENE, ONE, OTHER])
    assert run(spark, [GENE[:85]], plain, Config(discard_multi_hits=1)) == {} == run(spark, [GENE[:85]], plain, Config(max_hits_to_report=1)) == run(spark, [GENE[:85]], plain, Config(discard_multiple_matches=True))


def test_reasons(spark, tmp_path):
    _, lib = load(spark, tmp_path, ["v0", "w"], [GENE, OTHER])
    reads = [(0, GENE[:39]), (1, "A" * 60), (2, dna(60)), (3, GENE[:60]), (4, GENE[:40] + OTHER[:40]), (5, GENE[:100]), (6, "")]
    rows = spark.createDataFrame(reads, "read_id long, seq string").withColumn("skip", F.col("read_id") == 5)
    got = {r["read_id"]: (r["reason"], r["score"]) for r in align.align_reads(rows, lib, Config(score_threshold=50)).collect()}
    assert got == {0: (align.SHORT, 0), 1: (align.COMPLEXITY, 0), 2: (align.NO_MATCH, 0), 3: (align.MATCH, 60), 4: (align.BELOW, 0), 5: (align.DUMMY, 0), 6: (align.SHORT, 0)}


#: Kept states (R1 then R2) of each chemistry, from the table of the blueprint.
TABLE = {"none": {"FU", "RU", "UF", "UR", "FF", "RR", "FR", "RF"}, "unstranded": {"FU", "RU", "UF", "UR", "FR", "RF"}, "fiveprime": {"FU", "UR", "FR"}, "threeprime": {"RU", "UF", "RF"}}


@pytest.mark.parametrize("chemistry", CHEMISTRIES)
def test_orientation_table(spark, chemistry):
    rows, want = [], set()
    for k, (a, b) in enumerate(itertools.product("FRUX", repeat=2)):
        for mate, state in ((1, a), (2, b)):
            rows += [(k, mate, "f", s == "R") for s in {"F": "F", "R": "R", "U": "", "X": "FR"}[state]]
        settled = a.replace("X", "U") + b.replace("X", "U")
        if settled in TABLE[chemistry]:
            want.add((k, settled))
    calls = spark.createDataFrame(rows, "pair_id long, mate int, feature string, is_rev boolean")
    assert {(r["pair_id"], r["r1"] + r["r2"]) for r in orient.orient(calls, chemistry).collect()} == want


@pytest.mark.parametrize(("level", "want"), [(0, {0: ("a,b,c", align.MATCH), 1: ("a,b", align.MATCH)}), (1, {0: ("b", align.MATCH), 1: ("a,b", align.MATCH)}), (2, {0: ("b", align.MATCH), 1: ("", align.FORCE_FAILED)})])
def test_coercion(spark, level, want):
    kept = spark.createDataFrame([(0, "a", "F", "U"), (0, "b", "F", "R"), (0, "c", "U", "R"), (1, "a", "F", "U"), (1, "b", "U", "R")], "pair_id long, feature string, r1 string, r2 string")
    got = orient.triage(orient.coerce(kept, level), Config(intersect_level=level)).collect()
    assert {r["pair_id"]: (",".join(r["features"]), r["triage"]) for r in got} == want


def test_pairs_and_audit(spark, tmp_path):
    _, lib = load(spark, tmp_path, ["v0", "w"], [GENE, OTHER])
    made = [(GENE[:80], RC(GENE[100:])), (GENE[:80], RC(GENE[100:])), (GENE[:80], OTHER[:80]), (dna(80), dna(80)), (GENE[:70], None)]
    assert run(spark, made, lib, Config()) == {("v0",): 2, ("v0", "w"): 1}
    assert run(spark, made, lib, Config(chemistry="fiveprime", intersect_level=2)) == {("v0",): 1}
    same = [(GENE[:80], GENE[90:170]), (GENE[:80], RC(GENE[100:]))]
    assert run(spark, same, lib, Config(require_valid_pair=True)) == {("v0",): 1}
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(made)], "pair_id long, r1 string, r2 string")
    audit = {r["pair_id"]: r for r in counts.audit(rows, lib, Config()).collect()}
    assert set(audit) == {1, 2, 3, 4} and audit[3]["triage_reason"] == "None" and audit[3]["r1_filter_forward"] == align.NO_MATCH and audit[4]["r2_filter_forward"] is None and audit[1]["features"] == "v0"
    assert [r[0] for r in sinks.counts_lines(counts.sorted_counts(rows, lib, Config()), ragged=True).collect()] == ["v0\t2", "v0\tw\t1"]
    assert counts.many_libraries(rows, [("x", lib, Config()), ("y", lib, Config(num_mismatches=2))]).count() == 4


def test_molecules(spark):
    made = [("f", 0, "u", "c", "q1", False, True), ("f", 1, "u", "c", "q1", True, True), ("f", 2, "u", "c", "q2", True, True), ("f", 3, "v", "c", "q3", True, False), ("f", 4, "u", "c", "q2", False, True), ("g", 5, "u", "c", "q9", True, True)]
    rows = spark.createDataFrame(made, "file string, file_pos long, umi string, cell string, qname string, first boolean, paired boolean")
    assert [r["grp"] for r in pairs.umi_groups(rows).orderBy("file_pos").collect()] == [0, 0, 0, 3, 4, 5]
    assert {(r["qname"], r["pos1"], r["pos2"]) for r in pairs.pair_by_name(rows).collect()} == {("q1", 1, 0), ("q2", 2, 4)}
    assert pairs.dummy_mates(rows).where("skip").count() == 1
    one = rows.select(F.col("file_pos").alias("record_no"), F.col("umi").alias("seq"))
    with pytest.raises(Exception, match="fewer reads"):
        pairs.mate_join(one, one.limit(2)).collect()


def test_fastq_files(spark, tmp_path):
    lines = [f"@r{k}\n{dna(50)}\n+\n{'I' * 50}" for k in range(500)]
    (tmp_path / "a.fastq").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("record_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(f"@{r['name']}", r["seq"]) for r in got] == [tuple(x.split("\n")[:2]) for x in lines] and [r["record_no"] for r in got] == list(range(500))
    (tmp_path / "b.fastq").write_text("ACGT\n+\nIIII\n@x\n")
    with pytest.raises(Exception, match="bad FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_bam_round_trip(spark, tmp_path):
    rows = [(f"q{k}", 83 if k % 2 else 163, 0, 100 + k, 60, "10M2I38M", 0, 120, 70, dna(51), [k % 40] * 51 if k % 3 else None, {"CB": f"c{k}-1", "UR": "ACGT"}) for k in range(3000)]
    (tmp_path / "x.bam").write_bytes(bam.encode(rows, [("chr1", 1000)]))
    got = bam.read_bam(spark, str(tmp_path / "x.bam")).orderBy("file_pos").collect()
    assert [(r["qname"], r["flag"], r["pos"], r["cigar"], r["seq"], r["quality"], r["tags"]) for r in got] == [(a, b, d, f, s, q, t) for a, b, _, d, _, f, _, _, _, s, q, t in rows]
    shown = bam.project(bam.read_bam(spark, str(tmp_path / "x.bam"))).where("qname = 'q1'").first()
    assert shown["REVERSE"] == "true" and shown["CB"] == "c1-1" and shown["UB"] == "" and shown["PAIR_ORIENTATION"] == "R1F2" and shown["SEQ_LEN"] == "51"


def test_stretches_hold_each_kmer_once(spark):
    letters = "ACGTTGCAAGCTNé"
    texts = [None, *("".join(letters[i * i % 13 + i % 2] for i in range(n)) for n in (0, 4, 5, 6, 7, 13, 40, 41, 42, 43, 44, 45, 97))]
    for k, seed in ((5, 5), (5, 3), (30, 16)):
        step = k - seed + 1
        rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", seq.stretches(F.col("s"), k, seed).alias("x"))
        for r in rows.select("s", "x", F.transform("x", lambda x: seq.seed_of(x, k, seed)).alias("seeds")).collect():
            got = [(n * step + i, x[i : i + k], y) for n, (x, y) in enumerate(zip(r["x"] or [], r["seeds"] or [])) for i in range(len(x) - k + 1)]
            assert [g[:2] for g in got] == [(i, r["s"][i : i + k]) for i in range(len(r["s"] or "") - k + 1)]
            assert all(y in kmer and len(y) == seed for _, kmer, y in got)


def test_long_reads_cost_no_more_by_the_letter(spark):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    one, far = draw(80), draw(1_000_000)
    rows = spark.createDataFrame([(1, far[:500_007] + one[:70] + far[500_007:], None), (2, far, None), (3, draw(31) + one[10:], one)], "pair_id long, r1 string, r2 string")
    lib = spark.createDataFrame([(0, "a", "a", False, one)], "ref_idx long, feature string, grp string, is_rev boolean, sequence string")
    began = time.time()
    found = {r["read_id"]: (r["cls"], r["score"] > 0) for r in align.pseudoalign(rows.select(F.col("pair_id").alias("read_id"), F.col("r1").alias("seq")), lib).collect()}
    assert found == {1: ([0], True), 3: ([0], True)}
    assert [r["n"] for r in align.kmer_index(lib).agg(F.count("*").alias("n")).collect()] == [51]
    assert time.time() - began < 60  # each k-mer was cut from a copy of its whole read


@pytest.mark.parametrize("cfg", [Config(score_threshold=40, num_mismatches=1, chemistry="unstranded", intersect_level=1), Config(score_threshold=40, num_mismatches=1, require_valid_pair=True)], ids=["fallback", "valid_pair"])
def test_counts_need_no_reads_without_a_hit(spark, tmp_path, cfg):
    _, lib = load(spark, tmp_path, ["v0", "w"], [GENE, OTHER])
    far = random.Random(5)
    none = "".join(far.choices("ACGT", k=90))
    rows = spark.createDataFrame([(0, GENE[:85], RC(GENE[50:140])), (1, OTHER[:80], none), (2, none, None), (3, GENE[:90], GENE[20:110]), (4, GENE[:39], OTHER[:70])], "pair_id long, r1 string, r2 string")
    full, lean = ({r["pair_id"]: (r["features"], r["triage"]) for r in counts.trace(rows, lib, cfg, hit_only=only).collect()} for only in (False, True))
    assert set(full) == set(range(5)) and set(lean) == {0, 1, 3, 4} and lean == {n: full[n] for n in lean} and full[2] == (None, None)


@pytest.mark.parametrize("block", [60, screen.BLOCK])
def test_screen_finds_each_kmer_and_no_others(monkeypatch, block):
    monkeypatch.setattr(screen, "BLOCK", block)
    near = random.Random(block)
    some = lambda letters, n: "".join(near.choices(letters, k=n))
    sequences = [some("ACGT", near.choice([10, 29, 30, 45, 200])) for _ in range(40)] + ["ACGTN" * 20, ""]
    kmers = {x for s in sequences for i in range(len(s) - 29) if set(x := s[i : i + 30]) <= set("ACGT")}
    judge = screen.Screen(sequences)
    table = np.zeros(screen.SLOTS, bool)
    table[screen._slots(judge.words)] = True
    for _ in range(40):
        reads = []
        for _ in range(near.randint(0, 40)):
            s, one, at = some(near.choice(["ACGT", "ACGTN"]), near.randint(0, 120)), near.choice(sequences), near.randint(0, 60)
            s = s[:at] + one[at : at + near.choice([0, 25, 29, 30, 40])] + s[at:]
            reads.append(near.choice([s, s, s, s.lower(), None]))
        want = [any((r or "").upper()[i : i + 30] in kmers for i in range(len(r or "") - 29)) for r in reads]
        assert judge.judge(pa.array(["A" * 40, None, *reads], pa.string()).slice(2), table).tolist() == want
    assert judge.judge(pa.array(["\xdf" * 40, "A" * 40, None]), table).tolist() == [True, False, False]
    assert screen.Screen([]).judge(pa.array(["A" * 40]), table).tolist() == [False]


@pytest.mark.parametrize(("changes", "want"), [({"intersect_level": 1}, [(["v0"], 2), (["w"], 2)]), ({"require_valid_pair": True}, [(["v0"], 1)])], ids=["fallback", "valid_pair"])
def test_counts_write_no_reads_without_a_hit(spark, tmp_path, monkeypatch, changes, want):
    cfg, lib = load(spark, tmp_path, ["v0", "w"], [GENE, OTHER], **changes)
    far = random.Random(6)
    other = lambda n: "".join(far.choices("ACGT", k=n))
    # 29 letters of the library, so a seed of every k-mer around them but no k-mer
    none = [(k, other(40) + "N" + GENE[k : k + 29] + "N" + other(40), other(60) + "N" + RC(OTHER[k : k + 29]) + "N" + other(9)) for k in range(40)]
    held, hold = {}, scratch.hold
    monkeypatch.setattr(scratch, "hold", lambda df, name: held.setdefault(name, hold(df, name)))
    frame = lambda rows: spark.createDataFrame(rows, "pair_id long, r1 string, r2 string")
    assert counts.feature_counts(frame(none), lib, cfg).collect() == []
    assert {name: df.count() for name, df in held.items()} == dict.fromkeys(held, 0)
    held.clear()
    rows = frame([*none, (50, GENE[:85], RC(GENE[50:140])), (51, GENE[:85], RC(GENE[50:140])), (52, other(90), OTHER[:80].lower()), (53, OTHER[:80], None), (54, None, None), (55, GENE[:85], GENE[60:150])])
    lean = sorted(map(tuple, counts.feature_counts(rows, lib, cfg).collect()))
    assert {name: held[name].count() for name in ("pairs", "mates")} == {"pairs": 4, "mates": 4}  # pairs meet and are aligned once
    held.clear()
    monkeypatch.setattr(align, "BROADCAST_BASES", 0)  # nothing is screened
    assert sorted(map(tuple, counts.feature_counts(rows, lib, cfg).collect())) == lean == want
