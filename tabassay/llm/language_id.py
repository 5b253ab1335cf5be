"""Language identification by hierarchical discrimination: the language family first, then
one-versus-one linear support vector machines between the languages of that family.

A text is the vector of its hashed byte 3- and 4-grams (A-Z lowered, other ASCII non-letters as one
space; counts as square roots, length 1). Families compete one against one as well. The winner of
most duels wins, then the larger sum of margins, then the first name. At most about MAX_DOCS labelled
documents are used for fitting, the same number of each language where there are enough.

Null texts and texts without a letter are ``und`` with score 0. Whole texts of any length count.
Documents without language are predicted like others. Repeated rows stay. Without labelled documents
all are ``und``. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .tables import hash_fold, load, texts

BUCKETS = 2048
MAX_DOCS = 4_000       # labelled documents fitted on, all languages together

# fixed values: families of common languages; others are put into families by likeness of their texts
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]
_P3, _P4 = (int(x) for x in blocks.mixed_constants(21, 2))


def vectors(column) -> np.ndarray:
    """One row of BUCKETS per text of an Arrow column."""
    data, offsets = blocks.string_column(column)
    n = len(offsets) - 1
    data = _FOLD[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    code, doc = data[keep].astype(np.uint64), doc[keep]
    out = np.zeros(n * BUCKETS)
    for size, prime in ((3, _P3), (4, _P4)):
        if len(code) < size:
            break
        m = len(code) - size + 1
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h = (h << blocks.U64(8)) | code[k:k + m]
        h = (h + blocks.U64(size << 40)) * blocks.U64(prime)
        whole = doc[:m] == doc[size - 1:]
        at = doc[:m] * BUCKETS + (h >> blocks.U64(53)).astype(np.int64)
        out += np.bincount(at[whole], minlength=n * BUCKETS)
    x = np.sqrt(out.reshape(n, BUCKETS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss (weights, then the constant), classes balanced, by
    accelerated gradient steps. y: 1 or -1."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    cost, y = cost.astype(np.float32), y.astype(np.float32)
    step = np.float32(1 / (1 + 2 * (cost * np.einsum("ij,ij->i", x, x)).sum()))
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * ((cost * slack * y) @ x))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + np.float32((old - 1) / t) * (new - w)
        w = new
    return w


@dataclass
class Duels:
    """One-versus-one machines between named classes."""
    names: list
    pairs: list
    weights: np.ndarray  # pairs x (features + 1)

    @classmethod
    def fit(cls, x, labels, names):
        pairs = list(combinations(range(len(names)), 2))
        at = {name: k for k, name in enumerate(names)}
        k = np.array([at.get(name, -1) for name in labels])
        made = []
        for a, b in pairs:
            own = (k == a) | (k == b)
            made.append(svm(x[own], np.where(k[own] == a, 1.0, -1.0)))
        return cls(names, pairs, np.array(made).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x):
        """Index of the winner and its least margin over a rival, of each row."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, total = np.zeros((len(x), n)), np.zeros((len(x), n))
        least = np.full((len(x), n), np.inf)
        for p, (a, b) in enumerate(self.pairs):
            for k, m in ((a, margin[:, p]), (b, -margin[:, p])):
                wins[:, k] += m > 0
                total[:, k] += m
                least[:, k] = np.minimum(least[:, k], m)
        best = (wins + total / (1e3 * (1 + np.abs(total).max(initial=0)))).argmax(1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: Duels | None
    languages: dict  # family -> Duels

    def predict(self, column):
        """Languages and scores of an Arrow text column."""
        raw = column.to_pylist()
        names, scores = ["und"] * len(raw), np.zeros(len(raw))
        ok = np.array([bool(t and _LETTER.search(t)) for t in raw], bool)
        if self.families is None or not ok.any():
            return names, scores
        at = np.flatnonzero(ok)
        x = vectors(column)[at]
        family, sure = self.families.predict(x)
        for f, name in enumerate(self.families.names):
            own = np.flatnonzero(family == f)
            if len(own):
                lang, margin = self.languages[name].predict(x[own])
                for i, k, m in zip(own, lang, np.minimum(sure[own], margin)):
                    names[at[i]], scores[at[i]] = self.languages[name].names[k], 1 / (1 + np.exp(-4 * min(m, 9.0)))
        return names, scores


def labelled(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, text) of about ``max_docs`` documents whose id's crc32 is not 2 modulo 4."""
    rows = texts(docs, F.col("lang").cast("string").alias("lang")).where(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(hash_fold(F.col("doc_id"), 4) != 2)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.greatest(F.floor(F.lit(max_docs) / F.count("*").over(Window.partitionBy(F.lit(0)))), F.lit(1))  # one row per language
    share = counts.select("lang", F.least(F.lit(1 << 20), F.ceil(each * (1 << 20) / F.col("n"))).alias("share"))
    # one row per language, which the model on the driver holds as well
    return rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share")).select("lang", "text")


def families_of(x: np.ndarray, lang: np.ndarray) -> dict:
    """Family of each language: the known one, else one of about the square root of the number of
    the others, so the machines grow with n to the power 1.5 and not with its square. Seeds are
    chosen farthest from each other by mean vectors; each language joins the seed it is most like."""
    others = sorted(set(lang) - set(FAMILY))
    found = {v: FAMILY[v] for v in set(lang) & set(FAMILY)}
    if others:
        mean = np.array([x[lang == v].mean(0) for v in others])
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        seeds, near = [0], mean @ mean[0]
        while len(seeds) < math.isqrt(len(others) - 1) + 1:
            seeds.append(int(near.argmin()))
            near = np.maximum(near, mean @ mean[seeds[-1]])
        best = (mean @ mean[seeds].T).argmax(1)
        found |= {v: f"like {others[seeds[k]]}" for v, k in zip(others, best)}
    return found


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:

    def make(batches):
        for block in blocks.text_blocks(batches):
            x = vectors(block.column(1))
            ok = pa.array([bool(_LETTER.search(t)) for t in block.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"]).filter(ok)

    got = labelled(docs, max_docs).mapInArrow(make, "lang string, x binary").toArrow()
    if not got.num_rows:
        return Model(None, {})
    order = np.argsort(np.array([a + b.hex()[:64] for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist())]))
    lang = np.array(got.column(0).to_pylist(), dtype=object)[order]
    x = np.frombuffer(b"".join(got.column(1).to_pylist()), np.float32).reshape(-1, BUCKETS)[order]
    of = families_of(x, lang)
    family = np.array([of[v] for v in lang], dtype=object)
    names = sorted(set(family))
    inside = {f: Duels.fit(x[family == f], lang[family == f], sorted(set(lang[family == f]))) for f in names}
    return Model(Duels.fit(x, family, names), inside)


def predict(docs: DataFrame, model: Model, **columns) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for block in blocks.text_blocks(batches):
            names, scores = shared.value.predict(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return texts(docs, **columns).mapInArrow(make, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (hash_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
