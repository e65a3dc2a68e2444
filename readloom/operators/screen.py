"""Which pairs have a k-mer of a small library, told where they are read, before anything of them is shuffled.

Letters are numbers of two bits. Every k-mer covers one whole word of SEED letters that begins at a multiple of k - SEED + 1 of the
buffer in which a batch's reads stand one after the other; only where such a word is in the library are the k-mers around it looked
up, as whole numbers, so the answer is exact. Reads with letters beyond ASCII aren't judged but stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import align

#: Letters that are looked at in one go, a multiple of every step; slots of the table that rules most words out (a power of 2).
BLOCK, SLOTS = 15 << 18, 1 << 22
_OTHER, _WIDE = 4, 8
_CODES = np.full(256, _OTHER, np.uint8)
_CODES[128:] = _WIDE
for _n, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODES[[ord(c) for c in _pair]] = _n


def _numbers(codes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``width`` letters (31 at most) that begin at the places, as numbers, and whether all their letters are bases."""
    found, seen = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint8)
    for i in range(width):
        letter = codes[at + i]
        found = (found << np.uint64(2)) | (letter & 3)
        seen |= letter
    return found, seen < _OTHER


def _slots(words: np.ndarray) -> np.ndarray:
    return (words.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(33 - SLOTS.bit_length())


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


class Screen:
    """The words and k-mers of a library's sequences, both strands given."""

    def __init__(self, sequences: list[str], k: int = seq.KMER):
        self.k, self.step = k, k - align.SEED + 1
        words, kmers = [], []
        for s in sequences:
            codes = _CODES[np.frombuffer(s.encode(), np.uint8)]
            for width, out in ((align.SEED, words), (k, kmers)):
                numbers, ok = _numbers(codes, np.arange(max(0, len(codes) - width + 1)), width)
                out.append(numbers[ok])
        self.words, self.kmers = (np.unique(np.concatenate([np.zeros(0, np.uint64), *x])) for x in (words, kmers))

    def hits(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Places of the data (bytes) at which a k-mer of the library begins."""
        found, seed = [np.zeros(0, np.int64)], align.SEED
        for low in range(0, len(data) - seed + 1, BLOCK):
            codes = _CODES[data[low : low + BLOCK + seed]]
            n = (min(BLOCK, len(codes) - seed + 1) + self.step - 1) // self.step
            word, seen = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
            for i in range(seed):
                letter = codes[i : i + (n - 1) * self.step + 1 : self.step]
                word <<= np.uint32(2)
                word |= letter & 3
                seen |= letter
            at = np.flatnonzero(table[_slots(word)] & (seen < _OTHER))
            at = low + self.step * at[_among(word[at].astype(np.uint64), self.words)]
            at = (at[:, None] - np.arange(self.step)).ravel()
            at = at[(at >= 0) & (at + self.k <= len(data))]
            if len(at):
                near = _CODES[data[(first := at.min()) : at.max() + self.k]]
                number, ok = _numbers(near, at - first, self.k)
                found.append(at[ok & _among(number, self.kmers)])
        return np.concatenate(found)

    def judge(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        """For each read whether it has a k-mer of the library, or letters beyond ASCII."""
        column, kept = column.cast(pa.large_string()), np.zeros(len(column), bool)
        _, offsets, data = column.buffers()
        if not len(column) or data is None:
            return kept
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        row = lambda at: np.searchsorted(ends, at, "right") - 1
        if len(self.kmers):
            at = self.hits(data, table)
            of = row(at)
            kept[of[at + self.k <= ends[of + 1]]] = True
        kept[row(np.flatnonzero(data > 127))] = True
        return kept

    def __call__(self, batches):
        table = np.zeros(SLOTS, bool)
        table[_slots(self.words)] = True
        for batch in batches:
            yield batch.filter(pa.array(self.judge(batch.column("r1"), table) | self.judge(batch.column("r2"), table)))


def screened(pairs: DataFrame, libraries: list[DataFrame]) -> DataFrame:
    """(pair_id, r1, r2) of the pairs of which a mate may have a hit: all others have none. Libraries too large to be broadcast screen nothing."""
    sequences = None
    for rows in libraries:
        rows = rows.select(F.upper("sequence").alias("sequence"))
        sequences = rows if sequences is None else sequences.unionByName(rows)
    bases = sequences.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    pairs = pairs.select("pair_id", "r1", "r2")
    if bases > align.BROADCAST_BASES:
        return pairs
    rows = sequences.where("sequence IS NOT NULL").collect()
    return pairs.mapInArrow(Screen([r["sequence"] for r in rows]), pairs.schema)
