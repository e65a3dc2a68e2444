"""What the operators share: scratch tables, connected components and byte-level hashing in numpy.

Scratch tables are Parquet in the shared folder of ``spark.checkpoint.dir``, so a lost executor
never takes an intermediate result with it and no lineage is recomputed across stages.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = "\\x20\\x09-\\x0D"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that stage() returned, once whatever was made from it has been written in turn."""
    for k, (spark, path) in enumerate(_made):
        if path == getattr(df, "_scratch", None):
            _delete(*_made.pop(k))
            return


def release(spark: SparkSession) -> None:
    """Let the driver notice that earlier frames are gone, so that their shuffle files leave the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def clear() -> None:
    """Remove the scratch tables of this process; frames that still read them become invalid."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the session has ended: the cluster's own clean-up takes over
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(run):
    """An Arrow function after whose tasks the worker hands freed memory back: workers stay, idle, while other stages use the executor's."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, n: int, number: str, *order: str) -> DataFrame:
    """Rows with equal small numbers together and in order, number k in partition k modulo n: as even as can be, which a hash of few numbers isn't."""
    return df.repartitionById(n, F.pmod(F.col(number), F.lit(n)).cast("int")).sortWithinPartitions(number, *order)


def lower_az(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(col):
    """The first 128 bits of SHA-256: a key by which equal texts meet."""
    return F.unhex(F.substring(F.sha2(col, 256), 1, 32))


def apart(df: DataFrame, key: str) -> DataFrame:
    """The same rows, the key as a new expression. A side of a join that was grouped by the key then gets an exchange of its own, without which
    Spark can't split a hot key of the other side."""
    col, kind = F.col(key), df.schema[key].dataType.typeName()
    return df.withColumn(key, col.bitwiseXOR(F.lit(0)) if kind == "long" else F.concat(col, F.lit("" if kind == "string" else b"")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns (node, comp) for every node of an edge, comp being the smallest node of its component.
    Each round is written to the shared folder; no link ever comes to the driver, only whether a node is left
    that has two neighbours below it, or one below and one above: without such a node, all components are stars.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = stage(e, "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high"), F.col("v").alias("to")).unionAll(e.select("v", F.lit(0), F.lit(1), F.lit(None).cast("long")))
        if not ends.groupBy("x").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.min("to").alias("a"), F.max("to").alias("b")).where("low = 1 AND (high = 1 OR a <> b)").head(1):
            break
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(apart(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, "u"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        before, e = e, stage(small, "edges")
        discard(before)
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out._scratch = e._scratch
    return out


# ---- bytes of Arrow columns -------------------------------------------------------------------

#: Bytes hashed at once, which bounds the temporaries of a task whatever the batch holds.
PIECE = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; nulls are empty."""
    import pyarrow as pa

    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def row_slices(offs: np.ndarray, limit: int = PIECE, rows: int = 1 << 16):
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, or of one row that is longer."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit sums over all bits, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA3B195354A39B70D)
    h ^= h >> np.uint64(32)
    return h


class Roller:
    """Polynomial hashes modulo 2**64 of substrings, by prefix sums over a table of random byte values."""

    def __init__(self, fold_case: bool = False) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.powers = self.inverse = np.ones(0, np.uint64)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) >= len(self.powers):
            n = max(PIECE + 1024, len(buf) + 1)
            base = 0x5851F42D4C957F2D
            self.powers, self.inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverse[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.inverse, out=self.inverse)
        out = np.empty(len(buf) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.table[buf] * self.powers[: len(buf)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(roller: Roller, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each row, words being runs without ASCII white space, and the rows' n + 1 word offsets.

    Works through pieces of PIECE bytes that end at white space or a row's end (a longer word makes a longer piece).
    """
    inner = offs[1:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    space = SPACE[buf]
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf) and not (space[end] or edge[end]):
            end += 1
        s, e = space[at:end], edge[at : end + 1]
        first = ~s
        last = first.copy()
        first[1:] &= s[:-1] | e[1:-1]
        last[:-1] &= s[1:] | e[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(roller.between(roller.prefix(buf[at:end]), a, b))
        starts.append(a + at)
        at = end
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    p = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return w, np.concatenate([[0], np.searchsorted(p, inner), [len(p)]]).astype(np.int64)
