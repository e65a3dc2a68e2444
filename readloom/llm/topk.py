"""Exact top-k inner product search over an impact-ordered, score-at-a-time index.

The index is a table of blocks of vectors, written once to the shared folder. Within a block every component is a posting with
a quantised impact, the binary order of its magnitude; the postings of one impact level are a segment. Each task holds its blocks and takes
the queries, read from their own table, in batches. A batch takes the segments of a block by falling impact and stops as
soon as the proof is there that nobody else gets in: what is left of a vector adds at most the product of the query's norm
and the norm of its postings not yet seen, and a query's bar is the k-th best of the blocks before and of the lower bounds here. Postings of
vectors that no query can take any more are dropped before the next segment. Possible members are then
scored exactly in integers. Neither blocks nor queries are shuffled; only each task's k best of a query are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import kit, warc

FACTOR, TOP, EVERY = 256, 5, 50
#: Components, and vectors, of an index block and of a batch of queries; components of the blocks that a task holds at once.
BLOCK, BATCH, HELD = (1 << 18, 4096), (1 << 15, 512), 1 << 22
#: Impact levels that have a segment of their own; all below are one.
LEVELS = 12
#: Pairs scored exactly at once.
PAIRS = 1 << 15
LONG = (1 << 63) - 1


def impacts(v: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """floor(factor * x) as whole numbers in double precision, or as Python integers if one of them is beyond its range."""
    with np.errstate(over="ignore"):
        y = np.floor(v * float(factor))
    if np.isfinite(y).all():
        return y
    return np.array([[math.floor(z) if math.isfinite(z) else int(x) * factor for x, z in zip(a, b)] for a, b in zip(v.tolist(), y.tolist())], object)


def scaled(y: np.ndarray) -> tuple[np.ndarray, int]:
    """y divided by a power of two so that no component is above 1, and that power's exponent."""
    if y.dtype == object:
        top = max(abs(int(x)) for x in y.ravel()).bit_length()
        return np.array([[int(x) / (1 << top) for x in row] for row in y]), top
    top = int(np.frexp(np.abs(y).max(initial=0))[1])
    return np.ldexp(y, -top), top


def products(q: np.ndarray, x: np.ndarray):
    """Exact inner products of rows: in doubles or longs where no partial sum can leave their exact range, else in Python integers."""
    if q.dtype != object and x.dtype != object and len(q):
        one, two = np.abs(q).max(), np.abs(x).max()
        if one * two * q.shape[1] < 2**53:
            return np.einsum("ij,ij->i", q, x).astype(np.int64)
        if max(one, two, one * two * q.shape[1]) < 2**62:
            return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q.tolist(), x.tolist())], object)


def share(n: int, exponent: int) -> float:
    """A lower bound of n / 2**exponent."""
    try:
        at = n / (1 << exponent)
    except OverflowError:
        return -math.inf
    return at - abs(at) * 1e-14 - 1e-250


class Block:
    """Vectors of one length by rising id, their postings' impact levels, and what is left of each vector after each level."""

    def __init__(self, ids: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.y = ids[order], y[order]
        self.x, self.exponent = scaled(self.y)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        level = np.frexp(np.abs(self.x))[1]  # the quantised impact: the binary order of the magnitude
        found = sorted(np.unique(level[self.x != 0]).tolist(), reverse=True)[:LEVELS]
        self.level = np.clip(level, found[-1], None).astype(np.int16) if found else level.astype(np.int16)
        self.rest = [(k, np.sqrt((np.where(self.level < k, self.x, 0) ** 2).sum(1))) for k in found]

    def segment(self, k: int, here: np.ndarray) -> np.ndarray:
        """The postings of impact k of some of the vectors."""
        return np.where(self.level[here] == k, self.x[here], 0)


class Best:
    """The k best of each query of a batch so far: by falling score, then by rising id."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, k: int) -> None:
        self.ids, self.y, self.k = ids, y, k
        self.x, self.exponent = scaled(y)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        self.bar = np.full(len(ids), -np.inf)  # below the k-th score, in units of 2**exponent
        self.postings = 0  # multiplied so far

    def possible(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) numbers of a block that may belong to the k best; nobody else can."""
        own = np.ones((len(self.ids), len(b.ids)), bool)
        lo, hi = np.searchsorted(b.ids, self.ids, "left"), np.searchsorted(b.ids, self.ids, "right")
        for i in np.flatnonzero(lo < hi):
            own[i, lo[i] : hi[i]] = False
        who, here, bar = np.arange(len(self.ids)), np.arange(len(b.ids)), np.ldexp(self.bar, -b.exponent)
        error = 1e-14 * (self.x.shape[1] + LEVELS)  # of a sum in doubles, in products of norms
        acc, alive = np.zeros(own.shape), own & (np.outer(self.norm, b.norm) * (1 + error) + 1e-250 >= bar[:, None])
        for k, rest in b.rest:
            if alive.sum() <= 4 * self.k * len(who):
                break
            rows, cols = alive.any(1), alive.any(0)
            if not (rows.all() and cols.all()):
                who, here, bar, acc, alive = who[rows], here[cols], bar[rows], acc[np.ix_(rows, cols)], alive[np.ix_(rows, cols)]
            acc += self.x[who] @ b.segment(k, here).T
            self.postings += len(who) * int((b.level[here] == k).sum())
            slack = np.outer(self.norm[who], rest[here] + error * b.norm[here]) + 1e-250
            if len(here) > self.k:
                low = np.where(alive, acc - slack, -np.inf)
                bar = np.maximum(bar, np.partition(low, len(here) - self.k, axis=1)[:, len(here) - self.k])
            alive &= acc + slack >= bar[:, None]
        i, j = np.nonzero(alive)
        return who[i], here[j]

    def meet(self, b: Block) -> None:
        i, j = self.possible(b)
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            score = products(self.y[p], b.y[q])
            order = np.lexsort((b.ids[q], -score, p)) if score.dtype != object else np.array(sorted(range(len(p)), key=lambda x: (p[x], -score[x], b.ids[q[x]])), int)
            p, q, score = p[order], q[order], score[order]
            top = np.arange(len(p)) - np.searchsorted(p, p) < self.k
            for w, v, s in zip(p[top].tolist(), b.ids[q[top]].tolist(), score[top].tolist()):
                self.found[w].append((-s, v))
        for w in np.unique(i).tolist():
            self.found[w] = sorted(self.found[w])[: self.k]
            if len(self.found[w]) == self.k:
                self.bar[w] = share(-self.found[w][-1][0], self.exponent)

    def rows(self) -> list[tuple]:
        """(query, vector, score within a long, the exact score as a sortable text if it isn't)."""
        return [(q, v, max(-LONG - 1, min(LONG, -s)), None if -LONG <= s <= LONG else _sortable(-s)) for q, found in zip(self.ids.tolist(), self.found) for s, v in found]


def _batch(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(cols)], names=[n for n, _ in cols])


_BLOB = "width int, ids binary, data binary"
_FOUND = "query_id long, vec_id long, score long, exact string"


def _blob(ids: list[int], data: list[np.ndarray]) -> tuple:
    return len(data[0]), np.array(ids, np.int64).tobytes(), np.stack(data).tobytes()


def _pack(components: int, vectors: int):
    """Rows of (id, values) to blobs of vectors of one length."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy()
                ids, data = held.setdefault(len(x), ([], []))
                ids.append(i), data.append(x)
                if len(ids) == vectors or len(ids) * len(x) >= components:
                    yield _batch([_blob(*held.pop(len(x)))], _BLOB)
        for ids, data in held.values():
            yield _batch([_blob(ids, data)], _BLOB)

    return run


def _unpacked(width: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, width)


def _asked(every: int):
    """The vectors of some blobs that are queries, one by one."""

    def run(batches):
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids, x = _unpacked(*row)
                pick = np.flatnonzero(ids % every == 0)
                yield _rows(ids[pick], x[pick])

    return run


def _rows(ids: np.ndarray, x: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["vec_id", "x"])


def _search(k: int, factor: int, files: list[str]):
    """Blocks in, each task's k best of every query out. ``files`` hold the queries, which a task reads batch by batch."""

    def queries():
        import pyarrow.parquet as pq

        for file in files:
            fs, path = warc.file_system(file)
            with fs.open_input_file(path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                    yield from zip(*(b.column(c).to_pylist() for c in ("width", "ids", "data")))

    def settle(blocks: dict[int, list[Block]]):
        for width, ids, data in queries():
            ids, x = _unpacked(width, ids, data)
            best = Best(ids, impacts(x, factor), k)
            for b in blocks.get(width, ()):
                best.meet(b)
            yield _batch(best.rows(), _FOUND)

    def run(batches):
        blocks, n = {}, 0
        for b in batches:
            for width, *blob in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids, x = _unpacked(width, *blob)
                blocks.setdefault(width, []).append(Block(ids, impacts(x, factor)))
                n += x.size
                if n >= HELD:
                    yield from settle(blocks)
                    blocks, n = {}, 0
        if blocks:
            yield from settle(blocks)

    return run


def _sortable(x: int) -> str:
    """A text that sorts like the integer: sign, number of digits, digits (each complemented below zero)."""
    digits = str(abs(x))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if x >= 0 else "0" + "".join(chr(ord("9") - ord(c) + ord("0")) for c in text)


def search(vectors: DataFrame, k: int = TOP, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the k best other rows by integer inner product of floor(factor * x).

    Returns (query_id, rank, vec_id, score), all rows if fewer. Vectors that are null or empty or hold null or non-finite
    components, or have no vec_id, take no part; all others do, however long they are and however large their components: ranks go by the exact
    integer score, and a score beyond the range of a long is shown as the nearest end of that range. Only vectors of equal length meet; ties go
    to the smaller vec_id. A vec_id is expected once; rows that repeat it with an equal vector count once, and none of them meets another.
    An empty table gives no rows.
    """
    e = F.col("embedding").cast("array<double>")
    sound = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("x")).distinct()
    blocks = kit.stage(rows.mapInArrow(kit.tidy(_pack(*BLOCK)), _BLOB), "blocks")
    asked = kit.stage(blocks.mapInArrow(kit.tidy(_asked(every)), "vec_id long, x array<double>").mapInArrow(kit.tidy(_pack(*BATCH)), _BLOB), "queries")
    found = blocks.mapInArrow(kit.tidy(_search(k, factor, asked.inputFiles())), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
