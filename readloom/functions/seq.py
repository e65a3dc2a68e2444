"""Column functions on sequences, qualities and names. Everything is built-in expressions; nulls give nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sequencing run: reads of exactly this length carry an adapter of this many bases.
ADAPTER_READ, ADAPTER = 124, 13
MIN_READ, MIN_ENTROPY, KMER = 40, 1.75, 30
LENGTHS, TOP_QUALITY, MARGIN = 1000, 60, 2000
_INT64 = (1 << 63) - 1


def revcomp(seq: Column) -> Column:
    """Reverse complement; case is kept, N stays, U becomes A. Use valid_bases to reject other letters."""
    return F.translate(F.reverse(seq), "ACGTUNacgtun", "TGCAANtgcaaN")


def valid_bases(seq: Column) -> Column:
    return seq.rlike("^[ACGTUNacgtun]*$")


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits over A, C, G and T; other letters count in the length only; 0 for an empty sequence."""
    n = F.length(seq)
    # each count is made once: as a bound variable, since a column that stands thrice may be evaluated thrice
    found = F.array(*[(n - F.length(F.replace(seq, F.lit(base), F.lit("")))) / n for base in "ACGT"])
    bits = F.aggregate(found, F.lit(0.0), lambda total, p: total + F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.when(n == 0, F.lit(0.0)).otherwise(bits)


def oriented(seq: Column, reverse: Column) -> Column:
    return F.when(reverse, revcomp(seq)).otherwise(seq)


def clip_adapter(seq: Column, reverse: Column) -> Column:
    """Forward reads of the adapter length lose their first bases, reverse ones their last."""
    n = ADAPTER_READ - ADAPTER
    return F.when(F.length(seq) != ADAPTER_READ, seq).when(reverse, F.substring(seq, 1, n)).otherwise(F.substring(seq, ADAPTER + 1, n))


def clip_quality(quality: Column, reverse: Column) -> Column:
    """The same clip on an array of qualities, which is then reversed for reverse reads."""
    n = ADAPTER_READ - ADAPTER
    q = F.when(F.size(quality) != ADAPTER_READ, quality).when(reverse, F.slice(quality, 1, n)).otherwise(F.slice(quality, ADAPTER + 1, n))
    return F.when(reverse, F.reverse(q)).otherwise(q)


def phred(text: Column, base: int = 33) -> Column:
    """Array of qualities of a quality string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - base)


def trim_tables(target: int, strictness: float) -> tuple[list[int], list[int]]:
    """Fixed-point length and quality scores. Degenerate settings stay finite: exponents are capped and a zero table gives no ratio."""
    by_length = [-math.log1p(math.exp(min(target - i - 1, 700))) + math.log(i + 1) * (1 - strictness) for i in range(LENGTHS)]
    by_quality = [math.log(1 - 10 ** (-(0.5 + q) / 10)) * strictness for q in range(TOP_QUALITY + 1)]
    ratio = max(_INT64 / (top * MARGIN) for t in (by_length, by_quality) if (top := max(map(abs, t))))
    fixed = lambda t: [max(-_INT64 - 1, min(_INT64, int(x * ratio))) for x in t]
    return fixed(by_length), fixed(by_quality)


def _table(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def maxinfo(quality: Column, target: int, strictness: float) -> Column:
    """How many bases to keep: the last position at which length score plus summed quality score is greatest; 0 without qualities or at a best score of 0.

    Scores are 64-bit numbers and their sums aren't: each is added in two halves of 32 bits, which is exact for any read
    (a sum of 2^31 lower halves fits in a long), and sums are compared as (upper, lower, position).
    """
    by_length, by_quality = trim_tables(target, strictness)
    halves = lambda t: (_table([v >> 32 for v in t]), _table([v & 0xFFFFFFFF for v in t]))
    (length_up, length_low), (quality_up, quality_low) = halves(by_length), halves(by_quality)
    none = F.lit(0).cast("bigint")
    best = F.lit(None).cast("struct<up:bigint,low:bigint,at:int>")
    start = F.struct(none.alias("up"), none.alias("low"), F.lit(0).alias("i"), best.alias("best"))

    def step(s: Column, q: Column) -> Column:
        at = F.greatest(F.lit(0), F.least(q, F.lit(TOP_QUALITY))).cast("int")
        up, low = s["up"] + F.get(quality_up, at), s["low"] + F.get(quality_low, at)
        with_length = low + F.coalesce(F.get(length_low, s["i"]), none)
        score = F.struct((up + F.coalesce(F.get(length_up, s["i"]), none) + F.shiftright(with_length, 32)).alias("up"), with_length.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), (s["i"] + 1).alias("at"))
        return F.struct(up.alias("up"), low.alias("low"), (s["i"] + 1).alias("i"), F.greatest(s["best"], score).alias("best"))

    return F.aggregate(quality, start, step, lambda s: F.when(s["best"].isNull() | ((s["best"]["up"] == 0) & (s["best"]["low"] == 0)), 0).otherwise(s["best"]["at"]))


def trimmed(seq: Column, quality: Column, target: int, strictness: float) -> Column:
    """The prefix that maxinfo keeps; a read without qualities isn't trimmed."""
    return F.when(quality.isNull(), seq).otherwise(F.substring(seq, F.lit(1), maxinfo(quality, target, strictness)))


def norm_score(score: Column, seq: Column) -> Column:
    return F.when(F.length(seq) > 0, score / F.length(seq)).otherwise(F.lit(0.0))


def read_key(r1: Column, r2: Column) -> Column:
    return F.concat(r1, F.coalesce(r2, F.lit("")))


def cell_barcode(tag: Column) -> Column:
    """Without its suffix of two characters."""
    return F.substring(tag, F.lit(1), F.greatest(F.length(tag) - 2, F.lit(0)))


def umi_choice(corrected: Column, raw: Column) -> Column:
    """The corrected tag, else the raw one; rows with neither are an error."""
    umi = F.coalesce(corrected, raw)
    return F.when(umi.isNull(), F.raise_error(F.lit("a record has neither a corrected nor a raw UMI"))).otherwise(umi)


def parse_call(name: Column) -> Column:
    """(feature, is_rev) of a textual call: a name that ends in a separator and ``rev`` is a reverse hit."""
    rev = F.endswith(name, F.lit("rev"))
    return F.struct(F.when(rev, F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0)))).otherwise(name).alias("feature"), rev.alias("is_rev"))


def natural_key(name: Column) -> Column:
    """A key under which digit runs sort by value: each is padded to twenty digits."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_sort(names: Column) -> Column:
    keyed = F.transform(names, lambda n: F.struct(natural_key(n).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def kmers(seq: Column, k: int = KMER) -> Column:
    """All substrings of k letters, by position; empty for shorter sequences.

    Letters of one byte are cut by bytes, since cutting a string by letters counts them from its start each time.
    """
    n, data = F.length(seq) - k, seq.cast("binary")
    at = F.sequence(F.lit(0), n)
    by_byte = F.transform(at, lambda i: F.substring(data, i + 1, F.lit(k)).cast("string"))
    by_letter = F.transform(at, lambda i: F.substring(seq, i + 1, F.lit(k)))
    return F.when(n < 0, F.array().cast("array<string>")).when(F.octet_length(seq) == F.length(seq), by_byte).otherwise(by_letter)


def stretches(seq: Column, k: int, seed: int) -> Column:
    """The k-mers of a sequence in groups of k - seed + 1 that follow each other, each as the stretch of letters they cover; the last may be shorter.

    All k-mers of a stretch share its ``seed`` letters from position k - seed on (see seed_of). One pass of a pattern, so that long
    sequences cost no more by the letter than short ones.
    """
    step = k - seed + 1
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k},{k + step - 1}}})).{{{step}}}"), F.lit(1))


def seed_of(stretch: Column, k: int, seed: int) -> Column:
    """The letters that all k-mers of a stretch share."""
    return F.substring(stretch, k - seed + 1, seed)


def dna_of_text(text: Column) -> Column:
    """Letters of a text as bases (a, e, i ... are A; b, f, j ... C; and so on); everything else goes."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = ("ACGT" * 7)[:26]
    return F.translate(F.regexp_replace(text, "[^A-Za-z]+", ""), low + up, bases * 2)
