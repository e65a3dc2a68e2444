"""The command line over FASTQ and BAM files."""

import gzip
import io
import json
import random
import zlib

import pytest

from readloom import cli
from readloom.operators.orient import triage
from readloom.plans.config import Config
from readloom.plans.jobs import bam_result, file_kind
from readloom.sources import bam
from readloom.sources.fastq import read_fastq, read_pairs
from readloom.sources.library import load_library
from tests.test_calling import CONFIG, RC

RNG = random.Random(3)
GENE = "".join(RNG.choice("ACGT") for _ in range(300))


@pytest.fixture
def files(tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps([CONFIG, {"headers": ["sequence_name", "sequence"], "columns": [["gene"], [GENE]]}]))
    return tmp_path


def test_fastq_counts(spark, files):
    (files / "r.fastq").write_text("".join(f"@r{k}\n{GENE[k : k + 90]}\n+\n{'I' * 90}\n" for k in range(5)))
    cli.main(["-r", str(files / "lib.json"), "-o", str(files / "out"), "-i", str(files / "r.fastq")], spark)
    got = spark.read.option("sep", "\t").option("header", True).csv(str(files / "out")).collect()
    assert [tuple(r) for r in got] == [("gene", "5")]


def test_several_libraries_in_one_pass(spark, files):
    other = "".join(RNG.choice("ACGT") for _ in range(200))
    (files / "two.json").write_text(json.dumps([CONFIG | {"score_threshold": 85}, {"headers": ["sequence_name", "sequence"], "columns": [["gene2", "other"], [GENE[:150], other]]}]))
    (files / "r.fastq").write_text("".join(f"@r{k}\n{s[k : k + 90]}\n+\n{'I' * 90}\n" for k in range(0, 100, 20) for s in (GENE, other)))
    args = [x for name in ("lib", "two") for x in ("-r", str(files / f"{name}.json"), "-o", str(files / f"out_{name}"))]
    cli.main([*args, "-i", str(files / "r.fastq")], spark)
    for name in ("lib", "two"):
        cli.main(["-r", str(files / f"{name}.json"), "-o", str(files / f"alone_{name}"), "-i", str(files / "r.fastq")], spark)
    read = lambda x: sorted(tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(files / x)).collect())
    assert read("out_lib") == read("alone_lib") == [("gene", "5")]
    assert read("out_two") == read("alone_two") == [("gene2", "4"), ("other", "5")]


def test_fastq_is_unpacked_by_content(spark, files):
    text = "".join(f"@r{k}\n{GENE[k : k + 90]}\n+\n{'I' * 90}\n" for k in range(5)).encode()
    (files / "in").mkdir()
    (files / "in" / "plain.fastq").write_bytes(text)
    (files / "in" / "packed.fastq.gz").write_bytes(gzip.compress(text))
    (files / "in" / "hidden.fastq").write_bytes(gzip.compress(text))
    (files / "in" / "members.fastq").write_bytes(gzip.compress(text[:700]) + gzip.compress(text[700:]))
    (files / "in" / "misnamed.fastq.gz").write_bytes(text)
    (files / "in" / "none.fastq").write_bytes(b"")
    rows = read_fastq(spark, str(files / "in")).collect()
    for name in ("plain.fastq", "packed.fastq.gz", "hidden.fastq", "members.fastq", "misnamed.fastq.gz"):
        assert [(r["record_no"], r["name"], r["seq"]) for r in sorted(rows, key=lambda r: r["record_no"]) if r["file"].endswith(f"/{name}")] == [(k, f"r{k}", GENE[k : k + 90]) for k in range(5)]
    assert len(rows) == 25 and read_fastq(spark, str(files / "in" / "none.fastq")).count() == 0
    assert read_fastq(spark, str(files / "in" / "hidden.fastq")).count() == 5


def mate_pair(name, umi, at, cell="AAAC-1", quality=40, **tags):
    """Two records of 90 bases, 100 apart; the reverse one is stored along the gene, as files do."""
    tags = {"CB": cell, "UB": umi, "AS": "x", **tags}
    q = None if quality is None else [quality] * 90
    return [(name, 99, 0, at, 60, "90M", 0, at + 100, 190, GENE[at : at + 90], q, tags), (name, 147, 0, at + 100, 60, "90M", 0, at, -190, GENE[at + 100 : at + 190], q, tags)]


def lone(name, umi, flag=0, seq=None, quality=None, cell="TTT-1"):
    seq = GENE[9:99] if seq is None else seq
    return [(name, flag, 0, 9, 60, "90M", -1, -1, 0, seq, quality, {"CB": cell, "UR": umi})]


def result(spark, files, *more, chemistry="none", path="x.bam"):
    out = str(files / f"out{len(list(files.iterdir()))}")
    cli.main(["-r", str(files / "lib.json"), "-o", out, "-i", str(files / path), "-f", chemistry, *more], spark)
    return spark.read.option("sep", "\t").option("header", True).csv(out).fillna("").collect()


def test_bam_result_has_the_whole_record(spark, files):
    rows = [r for k in range(3) for r in mate_pair(f"q{k}", "ACGTACGTAA", 5 * k)] + mate_pair("same", "ACGTACGTAA", 10) + mate_pair("q9", "CCCCCCCCCC", 50) + mate_pair("p", "A" * 10, 3)
    off = "".join(RNG.choice("ACGT") for _ in range(90))
    rows += lone("u", "GGGGGGGGGG") + lone("miss", "GGGGGGGGGG", seq=off) + lone("short", "GGGGGGGGGG", seq="ACGTA" * 5) + lone("dull", "GGGGGGGGGG", seq="A" * 90) + lone("nothing", "TTTTTTTTTT", seq=off) + [("n", 0, 0, 9, 60, "90M", -1, -1, 0, GENE[9:99], None, {})]
    (files / "x.bam").write_bytes(bam.encode(rows))
    got = result(spark, files)
    assert len(got[0]) == 84 and got[0].__fields__[:3] == ["features", "score", "r1_QNAME"]
    assert not {"r1_QUAL", "r1_SEQ", "r2_QUAL", "r2_SEQ"} & set(got[0].__fields__)
    shown = {(r["r1_UB"] or r["r1_UR"], r["features"], r["score"], r["r1_QNAME"]) for r in got}
    # four pairs, two of them equal: three calls, shown by the last; pairs of other names follow with score 0
    assert {x for x in shown if x[0] == "ACGTACGTAA"} == {("ACGTACGTAA", "gene", "3", "same"), *(("ACGTACGTAA", "", "0", f"q{k}") for k in range(3))}
    assert {x for x in shown if x[0] == "CCCCCCCCCC"} == {("CCCCCCCCCC", "gene", "1", "q9")}
    assert {x[0] for x in shown} == {"ACGTACGTAA", "CCCCCCCCCC", "GGGGGGGGGG"}
    q9 = next(r for r in got if r["r1_QNAME"] == "q9")
    assert (q9["r1_POS"], q9["r2_POS"], q9["r1_REVERSE"], q9["r2_REVERSE"], q9["r2_STRAND"], q9["r1_SKIP_ALIGN"], q9["r2_INSERT_SIZE"]) == ("50", "150", "false", "true", "-", "FALSE", "-190")
    assert [q9[c] for c in got[0].__fields__[-10:]] == ["Successful Match", "90", "None", "0", "Successful Match", "90", "None", "0", "None", "None"]
    reasons = {r["r1_QNAME"]: (r["features"], r["r1_filter_forward"], r["r1_forward_score"], r["r2_filter_forward"], r["r2_forward_score"], r["r2_SKIP_ALIGN"]) for r in got if r["r1_UR"] == "GGGGGGGGGG"}
    dummy = "SKipped Align Due To Unpaired Dummy Read"
    assert reasons == {"u": ("gene", "Successful Match", "90", dummy, "0", "TRUE"), "miss": ("", "No Match", "0", dummy, "0", "TRUE"), "short": ("", "Short Read", "0", dummy, "0", "TRUE"), "dull": ("", "Low Entropy", "0", dummy, "0", "TRUE")}
    assert not [r for r in result(spark, files, "-p") if r["r1_UR"] == "GGGGGGGGGG"]


def test_bam_chemistry_and_valid_pairs_show_in_the_result(spark, files):
    (files / "x.bam").write_bytes(bam.encode(mate_pair("q", "ACGTACGTAA", 5) + lone("a", "ACGTACGTAA", 16, cell="AAAC-1")))
    got = {r["r1_QNAME"]: (r["features"], r["triage_reason"]) for r in result(spark, files, chemistry="fiveprime")}
    assert got == {"q": ("gene", "None"), "a": ("", "Equivalence Class Empty After Filters")}
    (files / "lib.json").write_text(json.dumps([CONFIG | {"require_valid_pair": True}, {"headers": ["sequence_name", "sequence"], "columns": [["gene", "other"], [GENE, RC(GENE[::-1])]]}]))
    assert {r["r1_filter_forward"] for r in result(spark, files)} <= {"Successful Match", "Required Valid Pair Not Matching"}


def test_two_bam_files_keep_their_pairs_apart(spark, files):
    (files / "two").mkdir()
    (files / "two" / "a.bam").write_bytes(bam.encode(mate_pair("a", "ACGTACGTAA", 5) + mate_pair("b", "ACGTACGTAA", 9)))
    (files / "two" / "b.bam").write_bytes(bam.encode(mate_pair("c", "ACGTACGTAA", 20) + lone("d", "ACGTACGTAA", cell="AAAC-1")))
    rows = bam.read_bam(spark, str(files / "two"))
    config, lib = load_library(spark, str(files / "lib.json"), "none")
    got = sorted((r["features"], r["score"], r["r1_QNAME"], r["r2_QNAME"], r["r1_POS"]) for r in bam_result(rows, lib, config).collect())
    assert got == [("", 0, "a", "a", "5"), ("", 0, "c", "c", "20"), ("gene", 2, "b", "b", "9"), ("gene", 2, "d", "d", "9")]


def test_compat_reproduces_the_odd_cases(spark, files):
    (files / "x.bam").write_bytes(bam.encode(mate_pair("q", "ACGTACGTAA", 5) + lone("u", "GGGGGGGGGG", quality=[40] * 90) + lone("v", "GGGGGGGGGG", seq=GENE[20:110])))
    plain, odd = ({r["r1_QNAME"]: r for r in result(spark, files, *more)} for more in ((), ("--compat",)))
    assert (plain["q"]["r1_POS"], odd["q"]["r1_POS"]) == ("5", "105")  # mates are swapped
    # a lone read sits in the second slot, which is shown first
    assert plain["u"]["r2_SKIP_ALIGN"] == odd["u"]["r2_SKIP_ALIGN"] == "TRUE" and odd["u"]["features"] == "gene"
    assert plain["v"]["r1_filter_forward"] == "Successful Match" and odd["v"]["r1_filter_forward"] == "Short Read"  # no qualities
    config = Config(intersect_level=2, compat=True)
    sets = spark.createDataFrame([(1, [], True)], "pair_id long, names array<string>, failed boolean")
    assert [triage(sets, c).first()["triage"] for c in (config, Config(intersect_level=2))] == ["Equivalence Class Empty After Filters", "Force Intersect Failure"]


@pytest.mark.parametrize("size", [100, 900, 60000])
def test_ranges_of_a_file_hold_each_record_once(spark, files, size):
    rows = []
    for k in range(400):
        n = RNG.choice([0, 1, 36, 90, 250])
        rows.append((f"name{k}", RNG.choice([0, 99, 147]), RNG.choice([-1, 0, 1]), RNG.randrange(-1, 10**6), 60, f"{n}M" if n else "", RNG.choice([-1, 0, 1]), 7, 0, "".join(RNG.choice("ACGTN") for _ in range(n)), RNG.choice([None, [RNG.randrange(60)] * n]), {"CB": "AA-1", "UR": "x" * RNG.choice([1, 40, 3000])}))
    data = bam.encode(rows, [("one", 10**6), ("two", 10**6)], size)
    (files / "x.bam").write_bytes(data)
    whole = list(bam.records(io.BytesIO(data)))
    assert [r[1] for r in whole] == [r[0] for r in rows] and [r[0] for r in whole] == sorted({r[0] for r in whole})
    for split in (37, 1000, 5001, 10**6):
        parts = [r for low in range(0, len(data), split) for r in bam.records(io.BytesIO(data), low, low + split, len(data))]
        assert parts == whole
    got = bam.read_bam(spark, str(files / "x.bam"), 4000)
    assert got.rdd.getNumPartitions() == -(-len(data) // 4000)
    assert [tuple(r)[1:13] for r in got.orderBy("file_pos").collect()] == [r[:12] for r in whole]


def with_tags(rows, *more):
    """A BAM file of rows, the raw bytes of further tags added to each."""
    raw = b"".join(data for _, data in bam.blocks(io.BytesIO(bam.encode(rows))))
    new, at = raw[:12], 12
    for tag in more:
        size = int.from_bytes(raw[at : at + 4], "little")
        new += (size + len(tag)).to_bytes(4, "little") + raw[at + 4 : at + 4 + size] + tag
        at += 4 + size
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(new) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(data) + 25).to_bytes(2, "little") + data + zlib.crc32(new).to_bytes(4, "little") + len(new).to_bytes(4, "little")


def test_records_that_cannot_be_decoded_are_left_out(spark, files):
    (files / "t.bam").write_bytes(with_tags([*lone("a", "GG"), *lone("bad", "GG"), *lone("c", "GG")], b"", b"XXQ?", b""))
    assert [r["qname"] for r in bam.read_bam(spark, str(files / "t.bam")).orderBy("file_pos").collect()] == ["a", "c"]


def test_two_fastq_files_go_together_by_position(spark, files):
    for name, seqs in (("r1", [GENE[:90], GENE[10:100]]), ("r2", [RC(GENE[100:190]), RC(GENE[110:200])]), ("few", [RC(GENE[100:190])])):
        (files / f"{name}.fastq").write_text("".join(f"@{k}\n{s}\n+\n{'I' * 90}\n" for k, s in enumerate(seqs)))
    got = read_pairs(spark, str(files / "r1.fastq"), str(files / "r2.fastq")).orderBy("pair_id").collect()
    assert [tuple(r) for r in got] == [(k, GENE[10 * k : 90 + 10 * k], RC(GENE[100 + 10 * k : 190 + 10 * k])) for k in range(2)]
    with pytest.raises(Exception, match="fewer reads"):
        read_pairs(spark, str(files / "r1.fastq"), str(files / "few.fastq")).collect()


def test_tags_that_are_not_text(spark, files):
    (files / "t.bam").write_bytes(with_tags(lone("u", "GG"), b"NHi" + (5).to_bytes(4, "little")))
    rows = bam.read_bam(spark, str(files / "t.bam"))
    assert [(r["NH"], r["CB"]) for r in bam.project(rows).collect() + bam.project(rows, True).collect()] == [("5", "TTT-1"), ("", "TTT-1")]


def test_file_kinds():
    assert [file_kind(x) for x in ("a.fastq", "a.fastq.gz", "b.bam")] == ["fastq", "fastq", "bam"]
    with pytest.raises(ValueError):
        file_kind("a.FASTQ")
