"""N-gram Jaccard join: a size-aware heavy-light self-join of shingle sets, by link components.

1. *Sets.* Each task hashes the distinct word shingles of its whole texts (64 bits; they travel as 48 bits beside the
   bucket's) and sends them to buckets, each with the number of its sets that hold it, so a common shingle is one entry of
   a task. Which sets hold it goes past the buckets. Equal sets of a task travel once.
2. *Counts.* A bucket adds up in how many sets each shingle occurs and returns those in two or more. A set can link
   only if three quarters of its shingles came back; nothing else goes on. Shingles are ordered from rare to common.
3. *Candidates.* Sets up to a boundary size are light: fixed-size subsets (pairs) of their first shingles are
   enumerated, and two sets that link share one. Larger sets are heavy: the inverted lists of their first shingles are scanned.
   The boundary is the size at which the two costs, summed over all sets, are least.
4. *Join.* Sets that a chain of common signatures connects form a cluster; clusters are joined exactly, in blocks
   of bounded size (each pair of blocks is one task, to which the sets go that have a partner there on some signature). Two sets that are linked already, over others, aren't compared again: that
   loses no component, and a group of near copies costs about its size, not its square.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import kit

#: Link if PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 5, 75
SUBSET = 2
#: Shingles that a task holds before it hands them on; shingles and subsets of the sets in a block.
FLUSH, BLOCK = 1 << 20, 1 << 20
#: Cost of meeting one entry of an inverted list, in signatures (each of those is shuffled, sorted and grouped).
ENTRY = 0.02
#: Sets that a task holds; with those of a piece of text still to come, fewer than AGAIN.
FLUSH_SETS = 16_000
#: Marks a set's number that belongs to the same shingle as the one before it.
AGAIN = 1 << 15

_SET = np.dtype([("key", "V12"), ("sig", "V16"), ("n", "<u4")])


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of k consecutive words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    if len(words) < k:
        h = np.full(1, len(words), np.uint64)
        for w in words:
            h = kit.mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
        return h
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[i : i + n] ^ (words[i : i + n] >> np.uint64(31)))
    return np.unique(kit.mix(h))


def room(n, percent: int = PERCENT):
    """How many elements of a set of n may be missing from a partner: the intersection is at least percent of n."""
    return n - -(-percent * n // 100)


def _batch(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(cols)], names=[n for n, _ in cols])


#: A flush sends its buckets the shingles and in how many of its sets each is; its own row holds, per shingle, those sets' numbers
#: (AGAIN marks further ones), the borders of the buckets, and its distinct sets, their sizes and its documents.
_REPORT = "bucket int, flush long, tokens binary, held binary, holders binary, cut binary, nodes binary, sizes binary, sets binary"
#: A bucket's answer to a flush: a bit for each shingle it sent, and the shingles that came back with their counts; own rows pass.
_BACK = "bucket int, flush long, tokens binary, df binary, alive binary, holders binary, cut binary, nodes binary, sizes binary, sets binary"


def _wide(tokens: bytes) -> np.ndarray:
    t = np.zeros((len(tokens) // 6, 8), np.uint8)
    t[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    return t.view("<u8").ravel()


def _report(k: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        roller, sets, tokens, seen = kit.Roller(fold_case=True), [], [], {}
        size, part, numbers = 0, TaskContext.get().partitionId(), count()

        def flush():
            table = np.array([x for x in sets], _SET)
            t = np.concatenate([np.zeros(0, np.uint64), *tokens])
            sizes = np.array([len(x) for x in tokens], "<u4")
            order = np.argsort(t, kind="stable")
            t, holders = t[order], np.repeat(np.arange(len(tokens), dtype=np.uint16), sizes)[order]
            del order
            new = np.append(True, t[1:] != t[:-1])[: len(t)]
            first = np.flatnonzero(new)
            held = np.diff(np.append(first, len(t))).astype("<u2")
            t = t[first]
            cut = np.searchsorted((t >> np.uint64(48)).astype(np.int64) * buckets >> 16, np.arange(buckets + 1))
            # partition and number tell flushes of equal content apart; a retry gives the same name
            flush_id = int.from_bytes(hashlib.blake2b(f"{part} {next(numbers)} ".encode() + table.tobytes(), digest_size=7).digest(), "big")
            low = t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out = [(b, flush_id, low[cut[b] : cut[b + 1]].tobytes(), held[cut[b] : cut[b + 1]].tobytes(), *[None] * 5) for b in range(buckets) if cut[b] < cut[b + 1]]
            holders[~new] |= AGAIN
            own = holders.astype("<u2"), cut.astype("<u4"), np.array(list(seen), "V16"), sizes, table
            out.append((flush_id % buckets, flush_id, None, None, *[x.tobytes() for x in own]))
            sets.clear(), tokens.clear(), seen.clear()
            return _batch(out, _REPORT)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            buf, offs = kit.column_bytes(batch.column(1))
            for lo, hi in kit.row_slices(offs, rows=FLUSH_SETS):
                w, at = kit.word_hashes(roller, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for d in range(hi - lo):
                    t = shingles(w[at[d] : at[d + 1]], k)
                    sig = hashlib.blake2b(t.tobytes(), digest_size=16).digest()
                    sets.append((keys[lo + d], sig, len(t)))
                    if len(t) and sig not in seen:
                        seen[sig] = None
                        tokens.append(t)
                        size += len(t)
                if size >= FLUSH or len(sets) >= FLUSH_SETS:
                    yield flush()
                    size = 0
        if sets:
            yield flush()

    return run


def _count(batches):
    """Per bucket: the shingles that are in two sets or more, with their counts, back to their flush."""

    def settle(bucket, rows):
        sent = [r for r in rows if r[1] is not None]
        yield _batch([(bucket, r[0], None, None, None, *r[3:]) for r in rows if r[1] is None], _BACK)
        if not sent:
            return
        t = np.concatenate([_wide(r[1]) for r in sent])
        _, back = np.unique(t, return_inverse=True)
        n = np.bincount(back, np.concatenate([np.frombuffer(r[2], "<u2") for r in sent])).astype("<u4")[back]
        low, cut = t.view(np.uint8).reshape(-1, 8)[:, :6], np.cumsum([0] + [len(r[2]) // 2 for r in sent])
        out = []
        for r, lo, hi in zip(sent, cut, cut[1:]):
            alive = n[lo:hi] > 1
            if alive.any():
                out.append((bucket, r[0], low[lo:hi][alive].tobytes(), n[lo:hi][alive].tobytes(), np.packbits(alive).tobytes(), *[None] * 5))
        yield _batch(out, _BACK)

    now, rows = None, []
    for b in batches:
        for k, *x in zip(*(b.column(c).to_pylist() for c in range(9))):
            if k != now and rows:
                yield from settle(now, rows)
                rows = []
            now = k
            rows.append(x)
    if rows:
        yield from settle(now, rows)


def _survivors(percent: int):
    """Per flush: the sets of which enough shingles came back, rare shingles first. A bucket's bits complete a shingle's 48."""

    def run(batches):
        import pyarrow as pa

        def settle(parts):
            (own,) = [p for p in parts if p[1] is None]  # a flush has one row of its own
            holders, cut, nodes, sizes = (np.frombuffer(x, t) for x, t in zip(own[4:8], ("<u2", "<u4", "V16", "<u4")))
            alive, t, df = np.zeros(cut[-1], bool), np.zeros(cut[-1], np.uint64), np.zeros(cut[-1], np.int64)
            for bucket, tokens, n, bits, *_ in parts:
                if tokens is not None:
                    lo, hi = cut[bucket], cut[bucket + 1]
                    at = lo + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(hi - lo)))
                    # the high bits only tell buckets apart: any that do so will serve
                    alive[at], t[at], df[at] = True, _wide(tokens) ^ (np.uint64(bucket) << np.uint64(48)), np.frombuffer(n, "<u4")
            which = np.cumsum(holders < AGAIN) - 1
            keep = alive[which]
            which, idx = which[keep], (holders & (AGAIN - 1))[keep].astype(np.int64)
            t, df = t[which], df[which]
            order = np.lexsort((t, df, idx))
            t, idx, df = t[order], idx[order], df[order]
            at = np.searchsorted(idx, np.arange(len(nodes) + 1))
            out = []
            for d in np.flatnonzero(np.diff(at) * 100 >= percent * sizes.astype(np.int64)):
                lo, hi, n = at[d], at[d + 1], int(sizes[d])
                gone = n - int(hi - lo)
                one, two = room(n, percent) + 1 - gone, room(n, percent) + SUBSET - gone
                out.append((nodes[d].tobytes(), n, t[lo:hi].view(np.int64), float(one + ENTRY * df[lo : lo + one].sum()), two * (two - 1) / 2.0))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.float64()), pa.array([x[4] for x in out], pa.float64())], names=["sig", "n", "tokens", "scan", "subsets"])

        now, parts = None, []
        for b in batches:
            for k, *x in zip(*(b.column(c).to_pylist() for c in range(9))):
                if k != now and parts:
                    yield from settle(parts)
                    parts = []
                now = k
                parts.append(x)
        if parts:
            yield from settle(parts)

    return run


def _members(batches):
    import pyarrow as pa

    for b in batches:
        for x in b.column(0).to_pylist():
            s = np.frombuffer(x, _SET)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in s["key"]], pa.binary()), pa.array([k.tobytes() for k in s["sig"]], pa.binary()), pa.array(s["n"].astype(np.int64))], names=["key", "sig", "n"])


def signatures(n: int, tokens: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Keys of which two sets that link share one: pairs of first shingles for light sets, single ones where a heavy set may be the partner."""
    gone = n - len(tokens)
    out = []
    if n <= boundary:
        first = tokens[: max(0, room(n, percent) + SUBSET - gone)].astype(np.uint64)
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(kit.mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
    if 100 * n >= percent * (boundary + 1):
        out.append(kit.mix(tokens[: max(0, room(n, percent) + 1 - gone)].astype(np.uint64) + np.uint64(0)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _keys(boundary: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, ns = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [signatures(n, x.values.to_numpy(), boundary, percent) for n, x in zip(ns, b.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in found])), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["node", "sign"])

    return run


def join_block(nodes: list[int], ns: list[int], tokens: list[np.ndarray], blocks: list[int], boundary: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what links in a block, or across two. Sets come by rising size; each meets the smaller ones on its keys.

    Keys and who holds them are flat arrays. A set that is linked to a component isn't compared with others of it.
    """
    order = np.argsort(ns, kind="stable")
    sizes, side, cross = np.asarray(ns)[order], np.asarray(blocks)[order], len(set(blocks)) > 1
    local = [tokens[i] for i in order]
    ends = np.cumsum([0] + [len(t) for t in local])
    kinds, flat = np.unique(np.concatenate(local), return_inverse=True)
    many = len(kinds)
    posted = []  # keys of a set, and whether it looks for others there
    for x, n in enumerate(sizes.tolist()):
        t = flat[ends[x] : ends[x + 1]]
        gone = n - len(t)
        if n <= boundary:
            first = np.sort(t[: max(0, room(n, percent) + SUBSET - gone)])
            i, j = np.triu_indices(len(first), 1)
            posted.append((first[i] * many + first[j], x, True))
        if 100 * n >= percent * (boundary + 1):
            posted.append((t[: max(0, room(n, percent) + 1 - gone)] - many, x, n > boundary))  # below zero: no pair's key
    count = [len(k) for k, _, _ in posted]
    keys, owner, sought = np.concatenate([k for k, _, _ in posted]), np.repeat([x for _, x, _ in posted], count), np.repeat([s for _, _, s in posted], count)
    by = np.argsort(keys, kind="stable")  # and by set, since postings came in that order
    keys, owner, sought = keys[by], owner[by].astype(np.int32), sought[by]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    start = np.repeat(start, np.diff(np.append(start, len(keys))))  # of each posting's list
    places = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[places], np.arange(len(sizes) + 1))
    root, held, links = np.arange(len(sizes)), np.zeros(many, bool), []
    # by a list's start: its first set, and whether all sets so far hang together with it (merging keeps that true)
    top, whole = np.zeros(len(keys), np.int32), np.ones(len(keys), bool)

    def compare(x: int, rest: np.ndarray) -> None:
        rest = rest[(root[rest] != root[x]) & (100 * sizes[rest] >= percent * sizes[x])]
        rest = np.unique(rest[side[rest] != side[x]] if cross else rest)
        while len(rest):
            some, rest = rest[:64], rest[64:]
            span = ends[some + 1] - ends[some]
            at = np.append(0, np.cumsum(span)[:-1])
            both = np.add.reduceat(held[flat[np.repeat(ends[some] - at, span) + np.arange(span.sum())]].astype(np.int64), at)
            for y in some[100 * both >= percent * (sizes[x] + sizes[some] - both)].tolist():
                if root[y] != root[x]:
                    links.append((nodes[order[x]], nodes[order[y]]))
                    root[root == root[y]] = root[x]
            rest = rest[root[rest] != root[x]]

    for x in range(len(sizes)):
        mine = places[cut[x] : cut[x + 1]]
        lists, before = start[mine], mine - start[mine]
        seek = sought[mine] & (before > 0)
        if seek.any():
            held[flat[ends[x] : ends[x + 1]]] = True
            compare(x, top[lists[seek]])  # most copies link here, and their lists need no reading
            seek &= ~(whole[lists] & (root[top[lists]] == root[x]))
            low, n = lists[seek], before[seek]
            compare(x, owner[np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(n) else low)
            held[flat[ends[x] : ends[x + 1]]] = False
        top[lists[before == 0]] = x
        whole[lists] &= root[top[lists]] == root[x]
    return links


def _blocks(boundary: int, percent: int):
    def run(batches):
        import pyarrow as pa

        def settle(rows):
            links = join_block([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], boundary, percent) if len(rows) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        now, rows = None, []
        for b in batches:
            for *k, node, n, block, t in zip(*(b.column(c).to_pylist() for c in range(6)), b.column(6)):
                if k != now and rows:
                    yield from settle(rows)
                    rows = []
                now = k
                rows.append((node, n, t.values.to_numpy(), block))
        if rows:
            yield from settle(rows)

    return run


def _partners(near: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, comp, block, with) for the sets of clusters of several blocks: the blocks in which a set has a partner on some signature. It goes nowhere else,
    so a chain of many sets costs what its candidates cost and not the square of its blocks."""
    posted = keys.join(near.select("node", "comp", "block"), "node")
    blocks = posted.groupBy("sign").agg(F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1)
    found = posted.join(kit.apart(blocks, "sign"), "sign").select("node", "comp", "block", F.explode("blocks").alias("with"))
    return found.where("block <> with").distinct()


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n, grp) for each distinct text key: its number of shingles and the name of its component (null without words).

    Scratch tables go as soon as what was made of them is written.
    """
    spark = docs.sparkSession
    n = kit.n_parts(spark)
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select(_key(text).alias("key"), text.alias("text"))
    sent = kit.dealt(rows.mapInArrow(kit.tidy(_report(k, 2 * n)), _REPORT), n, "bucket")
    back = kit.stage(sent.mapInArrow(kit.tidy(_count), _BACK), "counts")
    members = kit.stage(back.where("sets IS NOT NULL").select("sets").mapInArrow(kit.tidy(_members), "key binary, sig binary, n long").distinct(), "members")
    alive = back.select("flush", "bucket", "tokens", "df", "alive", "holders", "cut", "nodes", "sizes").repartition(n, "flush").sortWithinPartitions("flush").mapInArrow(kit.tidy(_survivors(percent)), "sig binary, n int, tokens array<long>, scan double, subsets double")
    alive = alive.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "scan", "subsets")])
    sets = kit.stage(alive.withColumn("node", F.monotonically_increasing_id()), "sets")
    kit.discard(back)
    costs = sets.groupBy(F.floor(F.log2("n") * 4).alias("size")).agg(F.max("n"), F.sum("scan"), F.sum("subsets")).orderBy("size").collect()  # a row per size class
    boundary = cheapest([tuple(r)[1:] for r in costs])
    keys = kit.stage(sets.select("node", "n", "tokens").mapInArrow(kit.tidy(_keys(boundary, percent)), "node long, sign long"), "signatures")
    center = keys.groupBy("sign").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center < other").select("sign", "center")
    stars = kit.stage(keys.join(kit.apart(center, "sign"), "sign").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), "stars")
    star_comps = kit.components(stars)
    near = kit.stage(star_comps, "clusters")
    kit.discard(stars), kit.discard(star_comps)
    size = sets.select("node", (F.size("tokens") + F.when(F.col("n") <= boundary, F.col("subsets")).otherwise(0)).alias("size"))
    near = near.join(size, "node")
    load = near.groupBy("comp").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("of"))
    near = near.join(kit.apart(load, "comp"), "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    near = kit.stage(near.select("comp", "of", "block", "node"), "blocks")
    to = near.select("node", "comp", "block", F.col("block").alias("with"))
    if near.where("of > 1").head(1):
        to = to.unionByName(_partners(near.where("of > 1"), keys)).distinct()
    full = to.join(sets.select("node", "n", "tokens"), "node")
    full = full.select("comp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "n", "block", "tokens")
    links = kit.stage(full.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(kit.tidy(_blocks(boundary, percent)), "a long, b long"), "links")
    kit.discard(near), kit.discard(keys)
    comps = kit.components(links)
    name = sets.select("sig", "node").join(comps, "node").select("sig", F.col("comp").cast("string").alias("comp"))
    out = members.join(name, "sig", "left").select("key", "n", F.when(F.col("n") > 0, F.coalesce("comp", F.hex("sig"))).alias("grp"))
    out = kit.stage(out, "groups")
    for x in (comps, links, sets, members):
        kit.discard(x)
    return out


def _key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 24))


def cheapest(classes: list[tuple[int, float, float]]) -> int:
    """The boundary size at which enumerating subsets up to it and scanning lists beyond it costs least. classes: (largest size, scan, subsets), by size."""
    best, boundary, done, left = sum(c[1] for c in classes), 0, 0.0, sum(c[1] for c in classes)
    for size, scan, subsets in classes:
        done, left = done + subsets, left - scan
        if done + left <= best:
            best, boundary = done + left, size
    return boundary


def cluster(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Components of documents whose shingle sets link. Returns (row, n_shingles, component_id, grp); ``row`` is a struct of the input's columns (or of ``keep``).

    component_id is the smallest doc_id of the component. Null and empty texts have no shingles and link with nothing;
    equal sets link; repeated rows fall into one component; null doc_ids take their component's
    smallest one (null if it has none); an empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.col("doc_id").alias("id"), _key(F.col("text").cast("string")).alias("key"))
    named = _named(docs, k, percent)
    return rows.join(named, "key", "left").select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "grp")


def _named(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, n, grp, least) for each distinct text: least is the smallest doc_id of its component. Ids are counted per text first, so copies don't travel."""
    found = groups(docs, k, percent)
    ids = docs.select(_key(F.col("text").cast("string")).alias("key"), F.col("doc_id").alias("id")).groupBy("key").agg(F.min("id").alias("id"))
    known = kit.stage(found.join(ids, "key"), "texts")
    kit.discard(found)
    least = known.where("grp IS NOT NULL").groupBy("grp").agg(F.min("id").alias("least"))
    return known.drop("id").join(kit.apart(least, "grp"), "grp", "left")


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents of which one of each component stays: a row with its smallest doc_id, and of several such rows that of the first text key.

    Everything is decided on ids and text keys; whole documents are shuffled once. Documents without words stay; rows that repeat both doc_id and
    text stay once, the one whose columns have the smallest hash; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    ids = docs.where(text.isNotNull()).select(_key(text).alias("key"), F.col("doc_id").alias("id")).groupBy("key", "id").agg(F.count("*").alias("copies"))
    known = ids.join(_named(docs, k, percent), "key")
    first = known.where("grp IS NOT NULL AND id <=> least").groupBy("grp").agg(F.min(F.struct("key", "id", "copies")).alias("x")).select("x.*")
    kept = kit.stage(first.unionByName(known.where("grp IS NULL").select("key", "id", F.lit(1).cast("long").alias("copies"))), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(text).alias("key"), F.col("doc_id").alias("id"))

    def those(which: str) -> DataFrame:
        some = kept.where(which).select(F.col("key").alias("k"), F.col("id").alias("i"))
        return rows.join(some, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")

    out = rows.where("key IS NULL").select("row").unionByName(those("copies = 1").select("row"))
    if kept.where("copies > 1").head(1):
        again = those("copies > 1").withColumn("h", F.xxhash64(*[F.col("row")[c] for c in docs.columns]))
        out = out.unionByName(again.groupBy("key", "id").agg(F.min_by("row", "h").alias("row")).select("row"))
    return out.select("row.*")


def op8(spark, sf_dir):
    found = cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", "n_shingles", "component_id")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS sig FROM s GROUP BY r),
u AS (SELECT sig, min(r) AS r, any_value(n) AS n FROM z GROUP BY sig),
t AS (SELECT u.r, x FROM u JOIN s USING (r)),
b AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT b.a, b.b FROM b JOIN u p ON p.r = b.a JOIN u q ON q.r = b.b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
m AS (SELECT r AS node, r AS comp FROM u UNION SELECT l.b, m.comp FROM m JOIN l ON l.a = m.node),
e AS (SELECT u.sig, min(m.comp) AS comp FROM u JOIN m ON m.node = u.r GROUP BY u.sig),
f AS (SELECT z.r, z.n, e.comp FROM z JOIN e USING (sig)),
g AS (SELECT comp, min(doc_id) AS least FROM f JOIN d USING (r) GROUP BY comp)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE least END AS component_id FROM d LEFT JOIN f USING (r) LEFT JOIN g USING (comp)
"""
