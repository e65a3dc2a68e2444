"""Embedding near-deduplication by lattice hashing.

Unit vectors go through several random projections to eight dimensions, each decoded to its nearest point of the
E8 lattice; a vector posts to that cell and to the neighbouring cells that its residual points at. Vectors that
share a cell are compared by cosine in double precision. A pair is counted in the first cell it shares only,
so counts need no list of pairs.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kit

COSINE = 0.93
#: Two unit vectors at cosine 0.93 share a cell of one table with chance 0.65, of any with 0.995; unrelated ones with 0.001 a table.
TABLES, PROBES, SCALE, SEED = 5, 4, 2.6, 17
#: Components of the vectors of a cell that one task compares with as many others.
BLOCK = 1 << 20
#: Rows of up to 64 components compared at once, fewer if they are longer; components that a task turns into units at once.
CHUNK, PIECE = 1 << 15, 1 << 21
#: Vectors of a cell beyond which pairs come from matrix products, of tiles of so many rows.
SMALL, TILE = 32, 512


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = s
            out.append(v)
    return np.array(out + [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


def _checkerboard(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of the checkerboard lattice and its copy shifted by a half."""
    a, b = _checkerboard(x), _checkerboard(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cell numbers, tables x (1 + probes) per row; salt keeps rows with different labels apart."""
    rng, near, out = np.random.default_rng(seed), neighbours(), []
    for t in range(tables):
        y = scale * unit @ (rng.normal(size=(unit.shape[1], 8)) / np.sqrt(8)) + rng.random(8)
        own = decode(y)
        best = np.argsort(-((y - own) @ near.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + near[best]], axis=1)
        h = kit.mix(salt.astype(np.uint64)[:, None] + np.full((1, 1 + probes), t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(8):
            h = kit.mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + (2 * points[:, :, k]).astype(np.int64).view(np.uint64))
        out.append(h.view(np.int64))
    return np.concatenate(out, axis=1)


def _units(col) -> np.ndarray:
    x = col.flatten().to_numpy().astype(float).reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_width(batch, col: int):
    import pyarrow.compute as pc

    width = pc.list_value_length(batch.column(col)).to_numpy()
    for w in np.unique(width):
        part, rows = batch.take(np.flatnonzero(width == w)) if len(np.unique(width)) > 1 else batch, max(1, PIECE // int(w))
        yield from (part.slice(lo, rows) for lo in range(0, len(part), rows))


def _cells(tables: int, probes: int, scale: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in _by_width(batch, 2) if len(batch) else ():
                x = _units(b.column(2))
                label = kit.mix(b.column(1).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1))
                found = cells(x, kit.mix(label + np.uint64(x.shape[1] * 0x9E3779B97F4A7C15 % 2**64)), tables, probes, scale)
                flat = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), flat, pa.array(np.full(len(b), x.shape[1]), pa.int32())], names=["node", "cells", "width"])

    return run


def _compare(cosine: float, tables: int, probes: int):
    """(node, links, root) within the cells of a partition: weighted counts of partners, and the smallest node it hangs together with."""
    per = 1 + probes

    def run(batches):
        import pyarrow as pa

        def settle(rows):
            group = np.cumsum(np.append(0, (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0) | (np.diff(rows["cell"]) != 0)))
            x, own, cell, side, node, weight = (rows[k] for k in ("x", "cells", "cell", "block", "node", "weight"))
            cross = rows["i"] != rows["j"]
            table = (own == cell[:, None]).argmax(1) // per
            n = len(group)
            count, root = np.zeros(n, np.int64), np.arange(n)

            def link(a, b):
                nonlocal root
                first = np.ones(len(a), bool)
                for t in range(tables):
                    u, v = own[a, t * per : (t + 1) * per], own[b, t * per : (t + 1) * per]
                    both = u[:, :, None] == v[:, None, :]
                    here = table[a] == t
                    least = np.where(both.any(2), u, np.iinfo(np.int64).max).min(1)
                    first &= np.where(here, least == cell[a], (table[a] < t) | ~both.any((1, 2)))
                a, b = a[first], b[first]
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                while True:  # the smallest position that hangs together
                    low = np.minimum(root[a], root[b])
                    if (root[a] == low).all() and (root[b] == low).all():
                        break
                    np.minimum.at(root, root[a], low)
                    np.minimum.at(root, root[b], low)
                    np.minimum.at(root, a, low)
                    np.minimum.at(root, b, low)
                    root = root[root]

            size = np.bincount(group)
            at, lag, chunk = np.flatnonzero(size[group] <= SMALL), 1, max(1, CHUNK * 64 // max(64, x.shape[1]))
            while len(at):  # small cells together: each row with the one so many places on
                at = at[at + lag < n]
                at = at[group[at] == group[at + lag]]
                for lo in range(0, len(at), chunk):
                    a = at[lo : lo + chunk]
                    b = a + lag
                    ok = ~(cross[a] & (side[a] == side[b]))
                    a, b = a[ok], b[ok]
                    ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                    link(a[ok], b[ok])
                lag += 1
            end = np.cumsum(size)
            for g in np.flatnonzero(size > SMALL):  # large ones by matrix products
                lo, hi = end[g] - size[g], end[g]
                sides = [np.arange(lo, hi)] * 2 if not cross[lo] else [lo + np.flatnonzero(side[lo:hi] == k) for k in (rows["i"][lo], rows["j"][lo])]
                for p in range(0, len(sides[0]), TILE):
                    for q in range(p if not cross[lo] else 0, len(sides[1]), TILE):
                        one, two = sides[0][p : p + TILE], sides[1][q : q + TILE]
                        a, b = np.nonzero(x[one] @ x[two].T >= cosine)
                        a, b = one[a], two[b]
                        ok = (a < b) | cross[lo]
                        link(a[ok], b[ok])
            root = root[root]
            some = count > 0
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[root[some]])], names=["node", "links", "root"])

        def table_of(b):
            get = lambda k: b.column(k).to_numpy()
            return {"cell": get(0), "i": get(1), "j": get(2), "block": get(3), "node": get(4), "weight": get(5), "cells": b.column(6).flatten().to_numpy().reshape(len(b), -1), "x": _units(b.column(7))}

        held = {}  # by width: rows of the last cell, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            for b in _by_width(batch, 7):
                new = table_of(b)
                w = new["x"].shape[1]
                if w in held:
                    new = {k: np.concatenate([held[w][k], new[k]]) for k in new}
                change = np.flatnonzero((np.diff(new["cell"]) != 0) | (np.diff(new["i"]) != 0) | (np.diff(new["j"]) != 0))
                cut = change[-1] + 1 if len(change) else 0
                if cut:
                    yield settle({k: v[:cut] for k, v in new.items()})
                held[w] = {k: v[cut:] for k, v in new.items()}
            end = tuple(batch.column(k)[len(batch) - 1].as_py() for k in range(3))
            for w in [w for w, x in held.items() if (x["cell"][-1], x["i"][-1], x["j"][-1]) != end]:
                yield settle(held.pop(w))
        for x in held.values():
            yield settle(x)

    return run


def near(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``cosine``.

    Returns (vec_id, n_links, component_id, kept). Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without label or vec_id, link with nothing (component_id is their own vec_id, n_links 0);
    vectors of different length never link. Equal vectors of a label are compared once and counted as often as they
    occur; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    n = kit.n_parts(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # then half as many bytes travel; all arithmetic is in doubles
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    sound = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"), F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    rows = rows.select("vec_id", "label", "e", "sound", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("e").cast("array<string>")), 256)).alias("same"))
    nodes = rows.where("sound").groupBy("same").agg(F.min("vec_id").alias("name"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("e").alias("e"))
    nodes = kit.stage(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    posts = kit.stage(nodes.select("node", "label", "e").mapInArrow(kit.tidy(_cells(tables, probes, scale)), "node long, cells array<long>, width int"), "cells")
    post = posts.select("node", "width", F.explode("cells").alias("cell"))
    full = post.groupBy("cell").agg(F.count("*").alias("m"), F.max("width").alias("w")).where("m > 1")
    full = full.select("cell", F.ceil(F.col("m") / F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("w")))).cast("int").alias("of"))
    post = post.select("node", "cell").join(kit.apart(full, "cell"), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    pair = F.when(F.col("of") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("of") - 1))
    post = post.withColumn("with", F.explode(pair)).select("cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node")
    sent = post.join(posts.drop("width"), "node").join(nodes.select("node", "weight", "e"), "node").select("cell", "i", "j", "block", "node", "weight", "cells", "e")
    found = sent.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(kit.tidy(_compare(cosine, tables, probes)), "node long, links long, root long")
    found = kit.stage(found, "found")
    comps = kit.components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "name", "same", "weight").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(kit.apart(named.groupBy("comp").agg(F.min("name").alias("least")), "comp"), "comp")
    named = named.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least")
    out = rows.select("vec_id", "same").join(named, "same", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6(spark, sf_dir):
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS comp FROM embeddings UNION SELECT l.b, c.comp FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, m.comp AS component_id, e.vec_id = m.comp AS kept
FROM embeddings e JOIN m ON m.node = e.vec_id
"""
