"""Suffix-array deduplication of byte strings of a fixed least length.

Only suffixes at anchors are sorted. Anchors are the positions whose 64-byte gram has the smallest hash of
some window of grams (winnowing): any two equal strings of 200 bytes hold an anchor at the same place, so nothing
is lost. The steps:

1. *Anchors.* Each task hashes its texts and reports, per anchor, its gram and its context (up to 136 bytes before
   and 200 from the anchor). Equal contexts within a task collapse first, so a group of copies costs a row per task.
2. *Grams.* Anchors whose gram is nowhere else drop out. Contexts that occur again, whole, are repeats as they stand
   (equal 64-bit gram hashes and equal 64-bit BLAKE2 digests of the contexts); one of each stays as a partner for the others.
3. *Runs.* Each task sorts the remaining suffixes (text from the anchor, then the text before it, backwards) and front-codes
   them: each is stored from its first byte that differs from its predecessor. Runs are exchanged by ranges of the gram.
4. *Merge.* A range merges its runs with a loser tree that carries common-prefix lengths and never compares
   a byte twice. Two suffixes that share 200 - r bytes forward and r backward share the string that begins r before
   the anchor; for every r the classes of both orders meet in integers, byte-exact.
5. *Removal.* The union of the strings found is cut from each text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import kit

LENGTH, GRAM = 200, 64
#: Anchors and suffixes that a task holds before it hands them on.
FLUSH, RUN = 1 << 18, 1 << 15
#: Suffixes of one gram that are merged in one task; the strings of grams with more are met one by one.
HOT = 1 << 17
#: Texts sampled for the borders of the ranges (they shape the load only, never the result).
SAMPLE = 2000

_ANCHOR = np.dtype([("gram", "<u8"), ("ctx", "<u8"), ("key", "S12"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("multi", "u1")])
_ITEM = np.dtype([("key", "S12"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("multi", "u1")])


_SPAN = np.dtype([("key", "S12"), ("a", "<u4"), ("b", "<u4")])


def joined(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans a to b of each key, those that touch made one."""
    out = np.zeros(len(key), _SPAN)
    if not len(key):
        return out
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order].astype(np.int64), b[order].astype(np.int64)
    other = np.append(False, key[1:] != key[:-1])
    high = np.cumsum(other) << 33
    end = np.maximum.accumulate(b + high) - high
    first = np.flatnonzero(np.append(True, other[1:] | (a[1:] > end[:-1])))
    out = out[: len(first)]
    out["key"], out["a"], out["b"] = key[first], a[first], end[np.append(first[1:], len(a)) - 1]
    return out


def slide(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over each w consecutive values, by doubling."""
    k = 1
    while 2 * k <= w:
        a, k = op(a[:-k], a[k:]), 2 * k
    return op(a[: len(a) - (w - k)], a[w - k :]) if k < w else a


def anchors(roller: kit.Roller, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(row, position in row, gram hash, context hash, bytes before, bytes from it) of each anchor of rows of ``length`` bytes or more."""
    w, lead = length - gram + 1, length - gram
    prefix = roller.prefix(buf)
    h = roller.grams(prefix, gram)
    if len(h) < w:
        return None
    v = (h >> np.uint64(32)).astype(np.uint32)
    low, pad = slide(np.minimum, v, w), np.zeros(w - 1, np.uint32)
    at = np.flatnonzero(v == slide(np.maximum, np.concatenate([pad, low, pad]), w))
    row = np.searchsorted(offs, at, "right") - 1
    ok = (at + gram <= offs[row + 1]) & (offs[row + 1] - offs[row] >= length)
    at, row = at[ok], row[ok]
    left, right = np.minimum(at - offs[row], lead), np.minimum(offs[row + 1] - at, length)
    data, digest = buf.tobytes(), hashlib.blake2b
    # a digest and no sum: texts can be made whose sums modulo 2**64 are equal
    ctx = np.frombuffer(b"".join([digest(data[a:b], digest_size=8).digest() for a, b in zip((at - left).tolist(), (at + right).tolist())]), "<u8")
    ctx = ctx ^ kit.mix((left * 256 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, at - offs[row], h[at], ctx, left, right


def text_anchors(roller: kit.Roller, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Anchors of many rows, in pieces of bounded size; a row longer than a piece goes through in overlapping pieces."""
    for lo, hi in kit.row_slices(offs):
        a, b = int(offs[lo]), int(offs[hi])
        if b - a <= 2 * kit.PIECE:
            found = [(0, a, b, None)]
        else:
            found = [(s, a, b, (max(a, s - 2 * length), min(b, s + kit.PIECE + 2 * length))) for s in range(a, b, kit.PIECE)]
        for s, a, b, part in found:
            if part is None:
                x = anchors(roller, buf[a:b], offs[lo : hi + 1] - a, length, gram)
                if x is not None:
                    yield x[0] + lo, *x[1:]
            else:
                p, q = part
                x = anchors(roller, buf[p:q], np.array([0, q - p]), length, gram)
                if x is not None:
                    own = (x[1] + p >= s) & (x[1] + p < s + kit.PIECE)
                    row, pos, g, ctx, left, right = (y[own] for y in x)
                    yield row + lo, pos + p - a, g, ctx, left, right


def _key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 24))


def _report(length: int, gram: int, buckets: int):
    """Anchors by bucket of their gram, equal contexts of a task collapsed; the spans of the collapsed ones are final."""

    def run(batches):
        import pyarrow as pa

        roller, held, n = kit.Roller(), [], 0

        def flush():
            a = np.concatenate(held)
            held.clear()
            a = a[np.lexsort((a["ctx"], a["gram"]))]
            new = np.ones(len(a), bool)
            new[1:] = (a["gram"][1:] != a["gram"][:-1]) | (a["ctx"][1:] != a["ctx"][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(a)))
            many = np.repeat(size > 1, size)
            a["multi"] = many
            done, rest = joined(*_whole(a[many])), a[new]
            bucket = (rest["gram"] >> np.uint64(40)).astype(np.int64) % buckets
            rest = rest[np.argsort(bucket, kind="stable")]
            cut = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            share = np.linspace(0, len(done), buckets + 1).astype(int)
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array([rest[cut[k] : cut[k + 1]].tobytes() for k in range(buckets)], pa.binary()), pa.array([done[share[k] : share[k + 1]].tobytes() for k in range(buckets)], pa.binary())], names=["bucket", "anchors", "done"])

        for b in batches:
            keys = np.frombuffer(b.column(0).cast(pa.binary(12)).buffers()[1], "S12", len(b), b.column(0).offset * 12) if len(b) and b.column(0).type != pa.binary() else np.array([x.as_py() for x in b.column(0)], "S12")
            buf, offs = kit.column_bytes(b.column(1))
            for row, pos, g, ctx, left, right in text_anchors(roller, buf, offs, length, gram):
                a = np.zeros(len(row), _ANCHOR)
                a["gram"], a["ctx"], a["key"], a["pos"], a["left"], a["right"] = g, ctx, keys[row], pos, left, right
                held.append(a)
                n += len(a)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def _whole(a: np.ndarray):
    """Spans of anchors whose whole context occurs again."""
    return a["key"], a["pos"].astype(np.int64) - a["left"], a["pos"].astype(np.int64) + a["right"]


def _rows(key, start, end):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x.ljust(12, b"\0") for x in key.tolist()], pa.binary()), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(end, np.int64))], names=["key", "a", "b"])


def _grams(most: int):
    """Per bucket: spans (a < b) of contexts that occur again, and requests for suffixes to compare: a = position, b = -1 (-2 for a partner, -3 in a hot gram)."""

    def settle(parts):
        a = np.concatenate(parts)
        a = a[np.lexsort((a["ctx"], a["gram"]))]
        g = np.ones(len(a), bool)
        g[1:] = a["gram"][1:] != a["gram"][:-1]
        c = g.copy()
        c[1:] |= a["ctx"][1:] != a["ctx"][:-1]
        weight = 1 + a["multi"].astype(np.int64)
        of_g, of_c = np.cumsum(g) - 1, np.cumsum(c) - 1
        rep = np.bincount(of_g, weight)[of_g] > 1
        again = np.bincount(of_c, weight)[of_c] > 1
        single = rep & ~again
        mixed = (np.bincount(of_g, single) > 0)[of_g]
        owner = rep & again & c & mixed
        again = joined(*_whole(a[again & (a["multi"] == 0)]))
        yield _rows(again["key"], again["a"], again["b"])
        ask = single | owner
        hot = (np.bincount(of_g, ask) > most)[of_g]
        yield _rows(a["key"][ask], a["pos"][ask], np.where(hot[ask], -3, np.where(owner[ask], -2, -1)))

    def run(batches):
        bucket, parts = None, []
        for b in batches:
            for k, anchors_, done in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != bucket and parts:
                    yield from settle(parts)
                    parts = []
                bucket = k
                if anchors_.as_buffer().size:
                    parts.append(np.frombuffer(anchors_.as_py(), _ANCHOR))
                if done.as_buffer().size:
                    spans = np.frombuffer(done.as_py(), _SPAN)
                    yield _rows(spans["key"], spans["a"], spans["b"])
        if parts:
            yield from settle(parts)

    return run


def _runs(length: int, gram: int, borders: list[bytes]):
    """Sorted, front-coded runs of suffixes, cut at the borders of the ranges."""
    lead = length - gram
    width = length + lead + 2
    schema = ["range", "items", "shared", "bytes"]

    def run(batches):
        import pyarrow as pa

        held, meta, n = [], [], 0

        def flush():
            m, items = np.concatenate(held), np.concatenate(meta)
            held.clear(), meta.clear()
            order = np.argsort(m.view(f"S{width}").ravel(), kind="stable")
            m, items = m[order], items[order]
            differ = m[1:] != m[:-1]
            shared = np.where(differ.any(1), differ.argmax(1), width)
            new = np.append(True, shared < width)
            m, items, shared = m[new], items[new], np.append(0, shared)[new].astype("<u2")
            grams = np.ascontiguousarray(m[:, :gram]).view(f"S{gram}").ravel()
            cut = [0, *np.searchsorted(grams, np.array(borders, f"S{gram}")), len(m)]
            out = []
            for k, (lo, hi) in enumerate(zip(cut, cut[1:])):
                if lo < hi:
                    s = shared[lo:hi].copy()
                    s[0] = 0
                    keep = np.arange(width) >= s[:, None]
                    out.append((k, items[lo:hi].tobytes(), s.tobytes(), m[lo:hi][keep].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=schema)

        for b in batches:
            for text, key, asked in zip(b.column(0), b.column(1), b.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                ask = np.unique(asked.values.to_numpy())
                pos, size = ask >> 1, len(data)
                for k in range(0, len(pos), RUN):
                    p, flag = pos[k : k + RUN], ask[k : k + RUN] & 1
                    at = np.concatenate([p[:, None] + np.arange(length), p[:, None] - 1 - np.arange(lead)], axis=1)
                    inside = (at >= 0) & (at < size)
                    m = np.zeros((len(p), width), np.uint8)
                    m[:, :-2] = np.where(inside, data[np.clip(at, 0, size - 1)], 0)
                    m[:, -2], m[:, -1] = inside[:, :length].sum(1), inside[:, length:].sum(1)
                    x = np.zeros(len(p), _ITEM)
                    x["key"], x["pos"], x["right"], x["left"], x["multi"] = key.as_py(), p, m[:, -2], m[:, -1], flag
                    held.append(m), meta.append(x)
                    n += len(p)
                if n >= RUN:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


class LoserTree:
    """Merge of sorted runs. Each contender knows how many bytes it shares with the last winner; only bytes beyond that are looked at."""

    def __init__(self, runs: list[tuple[np.ndarray, bytes, int]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at, self.byte, self.now, self.shared = [0] * self.k, [0] * self.k, [b""] * self.k, [0] * self.k
        for i in range(self.k):
            self.step(i)

    def step(self, i: int) -> None:
        """Decode the next string of run i; its common prefix with its predecessor, the last winner, is known from the front coding."""
        lcps, data, width = self.runs[i]
        n = self.at[i]
        if n == len(lcps):
            self.now[i], self.shared[i] = None, -1
            return
        s = int(lcps[n])
        end = self.byte[i] + width - s
        self.now[i], self.shared[i], self.at[i], self.byte[i] = self.now[i][:s] + data[self.byte[i] : end], s, n + 1, end

    def beats(self, i: int, j: int) -> bool:
        """Whether i wins over j; the loser's common prefix is then with the winner."""
        shared = self.shared
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        a, b = self.now[i], self.now[j]
        if a is None or b is None:
            return a is not None
        if a == b:
            shared[max(i, j)] = len(a)
            return i < j
        s = shared[i]
        x = int.from_bytes(a[s:], "big") ^ int.from_bytes(b[s:], "big")
        same = s + (8 * (len(a) - s) - x.bit_length()) // 8
        if a[same] < b[same]:
            shared[j] = same
            return True
        shared[i] = same
        return False

    def __iter__(self):
        """(run, number in run, string, bytes shared with the one before)."""
        k = self.k
        tree = [-1] * (2 * k)
        win = [-1] * (2 * k)
        for i in range(k):
            win[k + i] = i
        for node in range(k - 1, 0, -1):
            i, j = win[2 * node], win[2 * node + 1]
            win[node], tree[node] = (i, j) if self.beats(i, j) else (j, i)
        top = win[1] if k > 1 else 0
        while self.now[top] is not None:
            yield top, self.at[top] - 1, self.now[top], self.shared[top]
            self.step(top)
            node = (k + top) // 2
            while node:
                if self.beats(tree[node], top):
                    tree[node], top = top, tree[node]
                node //= 2


def _merge(length: int, gram: int):
    """Merge the runs of a range and give the strings that occur again."""
    lead = length - gram
    width = length + lead + 2

    def settle(m: np.ndarray, shared: np.ndarray, items: np.ndarray):
        n = len(m)
        back = np.ascontiguousarray(m[:, length : length + lead]).view(f"S{lead}").ravel()
        order = np.argsort(back, kind="stable")
        b = m[order, length : length + lead]
        differ = b[1:] != b[:-1]
        before = np.append(0, np.where(differ.any(1), differ.argmax(1), lead))
        low, high = np.full(n, -1), np.full(n, -1)
        right, left = items["right"], items["left"]
        cls = np.empty(n, np.int64)
        for r in range(lead + 1):
            part = np.flatnonzero((right >= length - r) & (left >= r))
            if len(part) < 2:
                continue
            cls[order] = np.cumsum(before < r)
            key = np.cumsum(shared < length - r)[part] * (n + 1) + cls[part]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            hit = np.zeros(len(part), bool)
            hit[by[1:][same]] = True
            hit[by[:-1][same]] = True
            hit = part[hit]
            low[hit] = np.where(low[hit] < 0, r, low[hit])
            high[hit] = r
        ok = (high >= 0) & (items["multi"] == 0)
        pos = items["pos"][ok].astype(np.int64)
        return _rows(items["key"][ok], pos - high[ok], pos - low[ok] + length)

    def merged(runs):
        items = [np.frombuffer(x, _ITEM) for x, _, _ in runs]
        tree = LoserTree([(np.frombuffer(s, "<u2"), d, width) for _, s, d in runs])
        strings, shared, which, number, last = [], [], [], [], b""

        def out():
            pick = np.empty(len(which), _ITEM)
            w, x = np.array(which), np.array(number)
            for k in np.unique(w):
                pick[w == k] = items[k][x[w == k]]
            m = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
            s = np.array(shared)
            s[0] = 0
            return settle(m, np.minimum(s, length), pick)

        for i, x, string, s in tree:
            if len(strings) >= RUN and s < gram:  # suffixes of different grams share nothing of interest
                yield out()
                strings.clear(), shared.clear(), which.clear(), number.clear()
            strings.append(string), shared.append(s), which.append(i), number.append(x)
        if strings:
            yield out()

    def run(batches):
        now, runs = None, []
        for b in batches:
            for k, *x in zip(*(b.column(c).to_pylist() for c in range(4))):
                if k != now and runs:
                    yield from merged(runs)
                    runs = []
                now = k
                runs.append(x)
        if runs:
            yield from merged(runs)

    return run


def _windows(length: int, gram: int):
    """(key, a, digest): each string of ``length`` bytes that holds one of the asked anchors, by a 128-bit digest."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for text, key, asked in zip(b.column(0), b.column(1), b.column(2)):
                data = memoryview(text.as_buffer())
                pos = np.unique(asked.values.to_numpy())
                reach = pos[:, None] - np.arange(length - gram + 1)
                start = np.unique(reach[(reach >= 0) & (reach <= len(data) - length)])
                for k in range(0, len(start), RUN):
                    part = start[k : k + RUN]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), pa.binary()), pa.array(part), pa.array([hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in part.tolist()], pa.binary())], names=["key", "a", "digest"])

    return run


def hot_repeats(texts: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of strings at anchors of hot grams: no task gathers a gram, each string meets its equals by digest, counted in part before the shuffle."""
    asked = found.where("b = -3").groupBy("key").agg(F.collect_list("a").alias("asked"))
    seen = kit.stage(texts.join(kit.apart(asked, "key"), "key").select("text", "key", "asked").mapInArrow(kit.tidy(_windows(length, gram)), "key binary, a long, digest binary").distinct(), "windows")
    again = seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return seen.join(again, "digest").select("key", "a", (F.col("a") + length).alias("b"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans (key, a, b) of bytes a to b of the text with that key, covered by strings of ``length`` bytes that also start elsewhere."""
    if not 8 <= gram < length <= 255:
        raise ValueError("8 <= gram < length <= 255 is needed")
    spark = docs.sparkSession
    n = kit.n_parts(spark)
    text = F.col("text").cast("string")
    texts = docs.where(F.octet_length(text) >= length).select(_key(text).alias("key"), text.alias("text"))
    rows = texts.mapInArrow(kit.tidy(_report(length, gram, 2 * n)), "bucket int, anchors binary, done binary")
    found = kit.dealt(rows, n, "bucket").mapInArrow(kit.tidy(_grams(HOT)), "key binary, a long, b long")
    found = kit.stage(found, "grams")
    asked = found.where("b IN (-1, -2)").groupBy("key").agg(F.collect_list(F.col("a") * 2 + F.when(F.col("b") == -2, 1).otherwise(0)).alias("asked"))
    runs = texts.join(kit.apart(asked, "key"), "key").select("text", "key", "asked").mapInArrow(kit.tidy(_runs(length, gram, _borders(texts, length, gram, n))), "range int, items binary, shared binary, bytes binary")
    more = kit.dealt(runs, n, "range").mapInArrow(kit.tidy(_merge(length, gram)), "key binary, a long, b long")
    spans = found.where("b > 0").union(kit.stage(more, "repeats"))
    return spans.union(hot_repeats(texts, found, length, gram)) if found.where("b = -3").head(1) else spans


def spans_by_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): the distinct spans of each text. Its copies report the same ones, so a list grows with the text and not with the copies."""
    return repeats(docs, length).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _borders(texts: DataFrame, length: int, gram: int, n: int) -> list[bytes]:
    """Borders of the ranges, from a few grams of each of a bounded sample of whole texts, by hash of their keys."""
    total = texts.count()

    def run(batches):
        import pyarrow as pa

        roller = kit.Roller()
        for b in batches:
            buf, offs = kit.column_bytes(b.column(0))
            found = []
            for row, pos, *_ in text_anchors(roller, buf, offs, length, gram):
                for r in np.unique(row):
                    p = pos[row == r]
                    found += [bytes(buf[x : x + gram]) for x in (offs[r] + p[:: max(1, len(p) // 8)][:8]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["gram"])

    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = texts.where(draw < int((1 << 30) * min(1.0, SAMPLE / max(1, total)))).select("text").mapInArrow(kit.tidy(run), "gram binary")
    grams = sorted(bytes(r[0]) for r in sample.limit(16 * SAMPLE).collect())
    return sorted({grams[len(grams) * k // (2 * n)] for k in range(1, 2 * n)}) if grams else []


def strip(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the corpus.

    Returns (row, kept, n_bytes, n_removed, n_spans, kept_sha256); ``row`` is a struct of the input's columns (or of
    ``keep``), ``kept`` the remaining text without characters that were cut in two (null unless something was removed and ``texts``). Null text is empty; texts
    shorter than ``length`` are never touched; repeated rows are each other's repeats and lose their whole text;
    strings are judged on the input; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = spans_by_text(docs, length)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), text.alias("text"), _key(text).alias("key"))
    both = rows.join(kit.apart(spans, "key"), "key", "left").select(
        "row", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("spans").isNull(), F.sha2("text", 256)).alias("sha"), F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"), "spans"
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            kept, removed, n_spans, sha = [None] * len(b), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), b.column(2).to_pylist()
            valid = b.column(4).is_valid()
            for k in np.flatnonzero(valid.to_numpy(zero_copy_only=False)):
                data = memoryview(b.column(3)[k].as_buffer())
                s = b.column(4)[k].values
                a, e = s.field(0).to_numpy(), s.field(1).to_numpy()
                order = np.argsort(a, kind="stable")
                a, e = a[order], np.maximum.accumulate(e[order])
                new = np.append(True, a[1:] > e[:-1])
                first, last = a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
                rest = b"".join(data[x:y] for x, y in zip(np.append(0, last), np.append(first, len(data))))
                removed[k], n_spans[k], sha[k] = (last - first).sum(), len(first), hashlib.sha256(rest).hexdigest()
                if texts:
                    kept[k] = rest.decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), b.column(1), pa.array(removed), pa.array(n_spans), pa.array(sha, pa.string())], names=[f.name for f in out])

    out = T.StructType([both.schema["row"], *[T.StructField(c, t()) for c, t in (("kept", T.StringType), ("n_bytes", T.LongType), ("n_removed", T.LongType), ("n_spans", T.LongType), ("kept_sha256", T.StringType))]])
    return both.mapInArrow(kit.tidy(run), out)


def op2(spark, sf_dir):
    found = strip(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], texts=False)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
x AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, true) AS new FROM x),
n AS (SELECT r, i, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY r, run),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
c AS (SELECT r, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (r)
"""
