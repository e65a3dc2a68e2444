"""Best-fit packing of documents into token sequences: vector best-fit over residual capacities.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed by falling length; among the open bins that can take a piece under every
constraint, the one with the best score gets it (``dot``: smallest weighted dot product of demand and
slack, ``norm``: smallest weighted residual norm after placing). Equal pieces in equal bins are placed
together, so the planner works on the histogram of lengths: at most ``capacity`` classes, and each class
adds at most two groups of bins. Limits on documents and cost that aren't given are made as tight as they get without a
further bin. Its size depends on the capacity alone, never on the corpus, which is
what makes the plan broadcastable. Ranks inside a length class come from counts per task and a
prefix sum over tasks, so no class is ever gathered.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import kit

CAPACITY = 2048
#: Words and odd chunks whose ids a worker keeps in each of two generations (memory only; results don't depend on it).
WORDS, CHUNKS = 250_000, 10_000
#: Characters of a text that are split at once.
PART = 1 << 22
BREAK = re.compile("[ \t\n\r]+")
VOCABULARY = "word_bpe_49k.json"
#: What tokens, documents and attention cost count for in the score of a bin.
WEIGHTS = (1.0, 0.5, 0.5)


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take the letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Cached(dict):
    """Values by key in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Chunks:
    """Ids of texts, word by word.

    In a text of printable ASCII and Latin letters without the vocabulary's special tokens, the splitter's pieces are found by its
    own rule (PIECES) and go to the merges directly. Other texts go through the whole tokenizer by white-space
    delimited chunks; the splitter never joins across a space, tab or line break.
    """

    ODD = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿ]|<\\|")
    #: Fixed value: the vocabulary's splitter, for the letters and digits that pass ODD.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.words, self.chunks = Cached(self.word, WORDS), Cached(self.chunk, CHUNKS)

    def word(self, word: str) -> bytes:
        return np.asarray([t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in word.encode()]))], "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words. A very long text goes through in parts cut at white space."""
        parts, at = [], 0
        while at < len(text):
            cut = BREAK.search(text, at + PART)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            if self.ODD.search(part):
                parts.append(b"".join(map(self.chunks.__getitem__, BREAK.split(part))))
            else:
                parts.append(b"".join(map(self.words.__getitem__, self.PIECES.findall(part.lower()))))
            at = end
        return b"".join(parts)


_kept: dict[str, Chunks] = {}


def chunks_of(path: str) -> Chunks:
    """One per worker process, which Spark uses for many tasks."""
    if path not in _kept:
        _kept[path] = Chunks(path)
    return _kept[path]


def tokenized(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, task, nth), nth counting equal lengths within the task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches):
        import pyarrow as pa

        chunks, task, counts, zero = chunks_of(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.uint32(0).tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for k, doc in enumerate(ids):
                data = chunks.ids(batch.column(1)[k].as_py() or "") + zero
                n = len(data) // 4
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    rows.append((doc, piece, at, size, zlib.crc32(memoryview(data)[4 * at : 4 * (at + size)]), task, int(counts[size])))
                    counts[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kit.tidy(run), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, first bin, offset, how many): pieces of one length, from a rank on, go to consecutive bins at an offset."""
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    top = np.array([capacity, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    lo, n, free = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3))  # groups of equal bins
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, need = counts[length], 0, np.array([length, 1, length * length], float)
        if (need > top).any():
            raise ValueError(f"a piece of {length} fits in no bin")
        while left:
            fits = np.flatnonzero((free >= need).all(1))
            if not len(fits):
                fresh = left if 2 * length > capacity else max(1, min(left, -(-left // max(1, int(min(top / need))))))
                lo, n, free = np.append(lo, bins), np.append(n, fresh), np.vstack([free, top])
                bins += fresh
                continue
            rest = (free[fits] - need) / top
            score = (w * rest * rest).sum(1) if rule == "norm" else (w * (need / top) * (free[fits] / top)).sum(1)
            g = fits[np.lexsort((lo[fits], free[fits, 0], score))[0]]
            k = int(min(left, n[g]))
            rows.append((length, rank, lo[g], capacity - free[g, 0], k))
            if k < n[g]:
                lo, n, free = np.append(lo, lo[g] + k), np.append(n, n[g] - k), np.vstack([free, free[g]])
            n[g], free[g] = k, free[g] - need
            left, rank = left - k, rank + k
        open_ = free[:, 0] > 0
        lo, n, free = lo[open_], n[open_], free[open_]
    return np.asarray(rows, np.int64).reshape(-1, 5)


def bins_of(rows: np.ndarray) -> int:
    return int((rows[:, 2] + rows[:, 4]).max(initial=0))


def tightest(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, int, int]:
    """A plan and its limits on documents and cost. A limit that isn't given starts where it can't bind and is bisected down to where the plan would need more bins."""
    most = {"max_docs": max_docs or capacity, "max_cost": max_cost or capacity * capacity}
    best = plan(counts, capacity, **most, weights=weights, rule=rule)
    for name, low in [(k, low) for k, given, low in (("max_docs", max_docs, 1), ("max_cost", max_cost, max(counts, default=1) ** 2)) if not given]:
        while low < 0.95 * most[name]:
            less = most | {name: int(low + most[name]) // 2}
            tried = plan(counts, capacity, **less, weights=weights, rule=rule)
            if bins_of(tried) > bins_of(best):
                low = less[name] + 1
            else:
                best, most = tried, less
    return best, most["max_docs"], most["max_cost"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    As few as the vector rule finds; limits on documents and cost per sequence may be given, else they are as tight as that number allows.
    A document is its token ids and then id 0; only longer ones are cut, into pieces of ``capacity``.
    Null text counts as empty (one token), a null doc_id stays null, repeated rows are packed each,
    an empty table gives no rows; other columns are not read. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id and offset.
    """
    spark = docs.sparkSession
    items = kit.stage(tokenized(docs, vocabulary, capacity), "pieces")
    per = items.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = per.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(tightest(counts, capacity, max_docs, max_cost, weights, rule)[0])

    def place(batches):
        import pyarrow as pa

        rows = table.value
        key = rows[:, 0] * (1 << 44) + rows[:, 1]
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            hit = rows[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1] if len(t) else np.zeros((0, 5), np.int64)
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(hit[:, 2] + rank - hit[:, 1])).append_column("offset", pa.array(hit[:, 3]))
            yield from t.to_batches()

    ranked = items.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(kit.tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
