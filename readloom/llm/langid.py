"""Language identification by hierarchical discrimination.

A linear classifier predicts the language family first; within a family, one-versus-one linear support
vector machines separate its languages by votes. Features are byte n-grams (1 to 3) of the whole
text, hashed, as square roots of relative frequencies.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import kit

# Families of language codes. A code that is not listed makes a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Bound on the labelled rows that the models are fitted on: about so many of a language, and so many in all.
PER_LANGUAGE, IN_ALL = 600, 8000
ONE, TWO, THREE = 256, 1280, 2560  # places of 1-, 2- and 3-grams
WIDTH = ONE + TWO + THREE
#: Bytes and rows whose features are counted at once.
PIECE, ROWS = 1 << 17, 256

_FOLD = np.full(256, 32, np.int64)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A unit vector per row; a row's vector depends on that row alone."""
    n = len(offs) - 1
    total = np.zeros(n * WIDTH)
    if not len(buf):
        return total.reshape(n, WIDTH)
    for lo in range(0, len(buf), PIECE):
        hi = min(len(buf), lo + PIECE)
        b = _FOLD[buf[lo : min(len(buf), hi + 2)]]
        at = np.arange(lo, hi)
        row = np.searchsorted(offs, at, "right") - 1
        room = offs[row + 1] - at  # n-grams end with their row
        base = row * WIDTH
        m = hi - lo
        first, last = int(row[0]) * WIDTH, (int(row[-1]) + 1) * WIDTH
        span = total[first:last]
        base -= first
        span += np.bincount(base + b[:m], minlength=last - first)
        k = m if len(b) > m else m - 1
        ok = room[:k] > 1
        code = (b[:k] * 40503 + b[1 : k + 1] * 2654435 >> 3) % TWO
        span += np.bincount((base[:k] + ONE + code)[ok], minlength=last - first)
        k = min(m, len(b) - 2)
        if k > 0:
            ok = room[:k] > 2
            code = ((b[:k] * 73856093 + b[1 : k + 1] * 19349663 + b[2 : k + 2] * 83492791) >> 4) % THREE
            span += np.bincount((base[:k] + ONE + TWO + code)[ok], minlength=last - first)
    total = total.reshape(n, WIDTH)
    return np.sqrt(total / np.maximum(1, total.sum(1, keepdims=True)))


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12) -> np.ndarray:
    """A linear support vector machine (squared hinge) on some rows of x by dual coordinate descent. x's last column is 1: its weight is the bias."""
    diag, a, w = np.array([x[r].astype(float) @ x[r] for r in rows]) + 0.5 / cost, np.zeros(len(rows)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            one = x[rows[i]].astype(float)
            new = max(0.0, a[i] - (y[i] * (w @ one) - 1 + a[i] * 0.5 / cost) / diag[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * one
                a[i] = new
    return w


class Model:
    """Classifiers of languages by rows of x, whose last column is 1; x is only looked at row by row and never copied."""

    def __init__(self, langs: list[str], x: np.ndarray) -> None:
        label = np.asarray(langs, object)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILY.get(lang, lang), []).append(lang)
        names, everything = list(self.families), np.arange(len(langs))
        family = np.asarray([FAMILY.get(v, v) for v in langs], object)
        self.top = np.stack([svm(x, everything, np.where(family == f, 1.0, -1.0)) for f in names]) if len(names) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for p, q in combinations(members, 2):
                use = np.flatnonzero((label == p) | (label == q))
                self.pairs[p, q] = svm(x, use, np.where(label[use] == p, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1))])
        names = list(self.families)
        which, score = np.zeros(len(x), int), np.ones(len(x))
        if self.top is not None:
            m = x @ self.top.T
            which = m.argmax(1)
            score = 1 / (1 + np.exp(-3 * m.max(1)))
        out = np.empty(len(x), object)
        for k, f in enumerate(names):
            rows, members = np.flatnonzero(which == k), self.families[f]
            votes, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, j in combinations(range(len(members)), 2):
                m = x[rows] @ self.pairs[members[i], members[j]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin)).argmax(1)
            out[rows] = np.asarray(members, object)[best]
            if len(members) > 1:
                score[rows] /= 1 + np.exp(-3 * margin[np.arange(len(rows)), best] / (len(members) - 1))
        return list(out), np.clip(score, 0, 1)


def _vectors(batches):
    """(lang, x, draw) of (lang, text, draw): features as half-precision numbers."""
    import pyarrow as pa

    for b in batches:
        buf, offs = kit.column_bytes(b.column(1))
        out = []
        for lo, hi in kit.row_slices(offs, PIECE, ROWS):
            x = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]).astype(np.float16)
            out += [v.tobytes() for v in x]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["lang", "x", "draw"])


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """Fit on a sample of (id, lang, text) rows: by a hash of id and text, about ``per_language`` of each language.

    Rows without id, language or a letter are left out; None if nothing is left.
    """
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(in_all // 4).collect()}
    if not counts:
        return None
    most = min(per_language, in_all // len(counts))
    part = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30))
    picked = rows.where(draw / float(1 << 30) < part[F.col("lang")]).select("lang", "text", draw.alias("draw")).mapInArrow(kit.tidy(_vectors), "lang string, x binary, draw long")
    # the bound holds whatever the ids: by hash, then by content, so that reruns agree
    picked = sorted((r["lang"], bytes(r["x"])) for r in picked.orderBy("draw", "lang", "x").limit(2 * in_all).collect())
    if not picked:
        return None
    x = np.ones((len(picked), WIDTH + 1), np.float16)
    for k, (_, v) in enumerate(picked):
        x[k, :-1] = np.frombuffer(v, np.float16)
    return Model([v for v, _ in picked], x)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text. Returns (row, lang_pred, score), row being a struct of the input's columns (or of ``keep``).

    ``und`` with score 0 where text is null, empty or without a letter, or if nothing could be learned.
    Repeated rows get equal predictions; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 4,096 weights, whatever the corpus
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row")
    text = F.col("text").cast("string")
    full = docs.select(row, F.when(text.rlike(r"\p{L}"), text).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            col = b.column(1)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            known = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            if shared.value is not None and len(known):
                buf, offs = kit.column_bytes(col.drop_null())
                for lo, hi in kit.row_slices(offs, PIECE, ROWS):
                    x = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    lang[known[lo:hi]], score[known[lo:hi]] = shared.value.predict(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return full.mapInArrow(kit.tidy(run), T.StructType([full.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(column: str = "doc_id"):
    """The fold that nothing is learned from; rows without an id are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out()).select(F.col("doc_id").cast("string").alias("id"), "lang", "text"))


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs), keep=["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
