"""K-mer index and pseudoalignment.

A read's hits are its positions whose 30-mer occurs in the library. Its class is the set of library rows that
every hit agrees on; each row of the class is compared with the read, ungapped, on the diagonals of the hits: the one
with the fewest mismatches, then the longest overlap, gives score (overlap in bases) and mismatches.
K-mers with letters other than A, C, G and T match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.plans import scratch
from readloom.plans.config import Config

#: Bases of a library up to which its index is broadcast (about 80 bytes a base); larger ones are joined by shuffle.
BROADCAST_BASES = 1 << 20
#: Letters of the words by which a read's stretches are looked up before their k-mers are.
SEED = 16
#: Row numbers of a library lie below 2 ** LIB; where several are aligned to at once, a library's number stands above.
LIB = 40

# Why a read or pair was dropped, as it is printed (spelling included).
MATCH, NO_MATCH, SHORT, COMPLEXITY = "Successful Match", "No Match", "Short Read", "Low Entropy"
BELOW, MULTIPLE, NONZERO, ABOVE = "Score Below Threshold", "Discarded Multiple Match", "Discarded Nonzero Mismatch", "Above Mismatch Threshold"
PAIR, FORCE_FAILED, MAX_HITS, EMPTY, DUMMY = "Required Valid Pair Not Matching", "Force Intersect Failure", "Max Hits Exceeded", "Equivalence Class Empty After Filters", "SKipped Align Due To Unpaired Dummy Read"


def sized(library: DataFrame, *indexes: DataFrame) -> tuple[DataFrame, ...]:
    """The indexes, marked for broadcast if their library's bases are few."""
    bases = library.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    return tuple(F.broadcast(x) for x in indexes) if bases <= BROADCAST_BASES else indexes


def places(library: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(kmer, ref_idx, at) for every k-mer of A, C, G and T of an expanded library."""
    found = F.transform(seq.kmers(F.upper("sequence"), k), lambda x, i: F.struct(x.alias("kmer"), i.alias("at")))
    # filtered inside the array: a filter on the column would be inferred for every k-mer of the reads too
    rows = library.select("ref_idx", F.explode(F.filter(found, lambda x: x["kmer"].rlike("^[ACGT]+$"))).alias("x"))
    return rows.select("x.kmer", "ref_idx", "x.at")


def kmer_index(library: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(kmer, lib, colour, places): the rows that hold each k-mer, and where; ``lib`` is the library's number, 0 for one."""
    rows = places(library, k).withColumn("lib", F.shiftright("ref_idx", LIB).cast("int"))
    return rows.groupBy("kmer", "lib").agg(F.array_sort(F.collect_set("ref_idx")).alias("colour"), F.collect_list(F.struct("ref_idx", "at")).alias("places"))


def seeds(library: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(seed): hashes of the words of an expanded library that a stretch of a read shares if one of its k-mers is in the library."""
    words = F.filter(seq.kmers(F.upper("sequence"), min(SEED, k)), lambda x: x.rlike("^[ACGT]+$"))
    return library.select(F.explode(words).alias("word")).select(F.xxhash64("word").alias("seed")).distinct()


def near(reads: DataFrame, words: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(read_id, n, stretch) of the stretches of k-mers, by number, whose shared letters are among the library's words.

    Without them in the library, none of a stretch's k-mers is there; equal hashes of different words cost time only.
    """
    seed = min(SEED, k)
    # outer: else a filter on the array would be inferred, made for every read and pushed below the exchange, which then isn't shared
    rows = reads.select("read_id", F.posexplode_outer(seq.stretches(F.col("seq"), k, seed)).alias("n", "stretch")).where("stretch IS NOT NULL")
    return rows.join(words, F.xxhash64(seq.seed_of(F.col("stretch"), k, seed)) == words["seed"], "left_semi")


def hits(reads: DataFrame, index: DataFrame, words: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(read_id, lib, at, colour, places) for each read position whose k-mer is in the index; the read itself stays behind."""
    seed = min(SEED, k)
    rows = near(reads, words, k).select("read_id", "n", F.posexplode_outer(seq.kmers(F.col("stretch"), k)).alias("i", "kmer")).select("read_id", (F.col("n") * (k - seed + 1) + F.col("i")).alias("at"), "kmer")
    return rows.join(index, "kmer").select("read_id", "lib", "at", "colour", "places")


def classes(found: DataFrame) -> DataFrame:
    """(read_id, lib, cls, diagonals) from hits: the rows common to all of a read's hits and the diagonals they lie on."""
    diagonals = F.transform("places", lambda p: F.struct(p["ref_idx"].alias("ref_idx"), (F.col("at") - p["at"]).alias("diagonal")))
    rows = found.groupBy("read_id", "lib").agg(F.collect_set("colour").alias("colours"), F.collect_set(diagonals).alias("d"))
    common = F.aggregate("colours", F.col("colours")[0], lambda a, b: F.array_intersect(a, b))
    rows = rows.withColumn("cls", F.array_sort(common))
    return rows.select("read_id", "lib", "cls", F.filter(F.array_distinct(F.flatten("d")), lambda x: F.array_contains(F.col("cls"), x["ref_idx"])).alias("diagonals"))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))


def compare(found: DataFrame, library: DataFrame) -> DataFrame:
    """(read_id, lib, cls, score, mismatches, length) from (read_id, lib, seq, cls, diagonals): the best diagonal of a class; an empty class scores 0."""
    pairs = found.select("read_id", "lib", "seq", "cls", F.explode_outer("diagonals").alias("x")).select("read_id", "lib", "seq", "cls", "x.ref_idx", "x.diagonal")
    rows = pairs.join(library.select("ref_idx", F.upper("sequence").alias("sequence")), "ref_idx", "left")
    start = F.greatest(F.col("diagonal"), F.lit(0))
    n = F.least(F.length("seq"), F.length("sequence") + F.col("diagonal")) - start
    differ = hamming(F.substring(F.col("seq"), start + 1, n), F.substring(F.col("sequence"), start - F.col("diagonal") + 1, n))
    best = F.min(F.when(F.col("ref_idx").isNotNull(), F.struct(differ.alias("mismatches"), (-n).alias("n"))))
    rows = rows.groupBy("read_id", "lib").agg(F.first("cls").alias("cls"), best.alias("x"), F.first(F.length("seq")).alias("length"))
    return rows.select("read_id", "lib", "cls", F.coalesce(-F.col("x.n"), F.lit(0)).alias("score"), F.coalesce(F.col("x.mismatches"), F.lit(0)).alias("mismatches"), "length")


def pseudoalign(reads: DataFrame, library: DataFrame, k: int = seq.KMER) -> DataFrame:
    """(read_id, cls, score, mismatches): (read_id, seq) reads aligned to an expanded library; reads without a sequence or a hit have no row."""
    return pseudoalign_all(reads, [library], k).drop("lib", "length")


def pseudoalign_all(reads: DataFrame, libraries: list[DataFrame], k: int = seq.KMER, fit: bool = False) -> DataFrame:
    """(read_id, lib, cls, score, mismatches, length): reads aligned to several libraries, by their number, in one pass; with ``fit``, only those that are long and varied enough.

    Reads are dealt out by read_id once; hits, classes and comparisons stay on that partitioning. Only reads with a stretch that
    shares its seed with a library go on, and only ids travel with the k-mers: a read's letters come back for those that have a class.
    """
    library = None
    for n, rows in enumerate(libraries):
        rows = rows.select((F.col("ref_idx") + (n << LIB)).alias("ref_idx"), "sequence")
        library = rows if library is None else library.unionByName(rows)
    reads = reads.select("read_id", F.upper("seq").alias("seq")).repartition("read_id")
    index, words = sized(library, kmer_index(library, k), seeds(library, k))
    reads = reads.join(near(reads, words, k).select("read_id").distinct(), "read_id", "left_semi")
    # written once: as part of one plan, what follows is pushed below the seeds and made for every read, several times
    reads = scratch.hold(reads, "near").repartition("read_id")
    if fit:
        reads = reads.where(fitting(F.col("seq")).isNotNull())
    found = compare(reads.join(classes(hits(reads, index, words, k)), "read_id"), library)
    return found.withColumn("cls", F.transform("cls", lambda x: x.bitwiseAND((1 << LIB) - 1)))


def fitting(sequence: Column, also: Column | None = None) -> Column:
    """The sequence if it is long and varied enough to be aligned, else null. As a column and not as a filter, so that it is made once."""
    fit = (F.length(sequence) >= seq.MIN_READ) & (seq.entropy(sequence) >= seq.MIN_ENTROPY)
    return F.when(fit if also is None else also & fit, sequence)


def rejected(sequence: Column, skip: Column) -> Column:
    """The first filter that a read fails before it is aligned, else null."""
    return F.when(skip, DUMMY).when(F.length(sequence) < seq.MIN_READ, SHORT).when(seq.entropy(sequence) < seq.MIN_ENTROPY, COMPLEXITY)


def reason(cfg: Config) -> Column:
    """The first filter that a read fails, or a match, from its columns: rejected, norm and, as aligned, cls (null without a hit), score and mismatches."""
    r = F.when(F.col("rejected").isNotNull(), F.col("rejected")).when(F.col("cls").isNull(), NO_MATCH)
    if cfg.discard_nonzero_mismatch:
        r = r.when(F.col("mismatches") != 0, NONZERO)
    r = r.when(score_below(cfg, F.col("score"), F.col("norm"), F.col("cls")), BELOW)
    if cfg.discard_multiple_matches:
        r = r.when(F.size("cls") > 1, MULTIPLE)
    return r.when(F.col("mismatches") > cfg.num_mismatches, ABOVE).otherwise(MATCH)


def score_below(cfg: Config, score: Column, norm: Column, cls: Column) -> Column:
    return (score < cfg.score_threshold) | (norm < cfg.score_percent) | (F.size(cls) == 0)


def prepared(reads: DataFrame) -> DataFrame:
    """(read_id, seq) of (read_id, seq[, skip]) reads, the sequence null where the read is skipped or too short; pseudoalign_all drops simple ones with ``fit``."""
    rows = reads.select("read_id", F.upper("seq").alias("seq"), *(["skip"] if "skip" in reads.columns else []))
    long = F.length("seq") >= seq.MIN_READ
    return rows.select("read_id", F.when(long & ~F.coalesce(F.col("skip"), F.lit(False)) if "skip" in reads.columns else long, F.col("seq")).alias("seq"))


def align_reads(reads: DataFrame, library: DataFrame, cfg: Config, found: DataFrame | None = None, hit_only: bool = False) -> DataFrame:
    """(read_id, reason, norm, score, mismatches, cls) for (read_id, seq[, skip]) reads; cls is null unless the read matched.

    Rejects come first, so short, skipped and simple reads never reach the index. ``found`` may hold what pseudoalign_all gives for the prepared reads, with ``fit``.
    With ``hit_only``, reads without a hit have no row. Sequences don't travel to the join with what was found.
    """
    if found is None:
        found = pseudoalign_all(prepared(reads), [library], fit=True).drop("lib")
    if hit_only:  # what was found is no reject
        rows = found.withColumn("rejected", F.lit(None).cast("string"))
    else:
        skip = F.coalesce(F.col("skip"), F.lit(False)) if "skip" in reads.columns else F.lit(False)
        rows = reads.select("read_id", rejected(F.upper("seq"), skip).alias("rejected")).join(found, "read_id", "left")
    norm = F.coalesce(F.col("score") / F.col("length"), F.lit(0.0))
    rows = rows.withColumn("norm", norm).select("read_id", reason(cfg).alias("reason"), "norm", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"), "cls")
    return rows.withColumn("cls", F.when(F.col("reason") == MATCH, F.col("cls")))
