"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the word classes of a clause: insults and threats put out weight; target,
negation and reported speech scale what is put out while they are in force. Their product is one
automaton, run over the clauses that hold an anchor; a document's score is a logistic function of
what its clauses put out, so a word alone decides nothing. Insult stems (whole words and word
beginnings) and their weights are learned from labelled documents: beginnings far more frequent in
toxic ones, counted by different neighbouring words so that copies of a text count once. The other
classes are short fixed lists.

At most SAMPLE labelled documents (those of least hash) are used for fitting, split by fold between
stems and calibration. Only texts enter a score.

Null and empty texts score like texts without any match. Repeated labels of an id count as toxic if
one is. Without labelled documents of both classes only the fixed lists and default weights work.
Repeated rows stay; ties have no effect; empty tables give empty results; extra columns are not
read by scoring and stay in filtering.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .tables import hash_fold, load, stage, texts

SAMPLE = 15_000        # labelled documents used for fitting, at most
CANDIDATES = 6_000     # stems whose neighbours are counted
STEMS = 2_000          # stems kept
PREFIXES = range(3, 9)
MIN_TOXIC = 5          # different neighbours in toxic documents
MIN_WEIGHT = 2.0       # log of how much more frequent in toxic documents
REACH = 3              # words over which target, negation and threat act

# fixed values: word classes in English, German, French and Spanish
THREAT = {"kill", "hurt", "destroy", "beat", "shoot", "stab", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "pegar"}
TARGET = {"you", "your", "u", "du", "dich", "dir", "euch", "tu", "toi", "vous", "tú", "te", "usted", "ustedes"}
NEGATION = {"not", "never", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"}
REPORTED = {"said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "disait", "écrivait", "dijo", "escribió"}

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]")
CLASSES = "OITYNR"  # other, insult, threat, target, negation, reported


@dataclass(frozen=True)
class Transducer:
    """next[(state, class)] -> state, else the state falls by one towards 0; out(state before, class)
    is what it puts out (emitters) or the factor it applies to outputs (modifiers)."""
    next: dict
    out: dict = field(default_factory=dict)
    factor: dict = field(default_factory=dict)
    sticky: bool = False

    def step(self, state, kind):
        if (state, kind) in self.next:
            return self.next[state, kind]
        return state if self.sticky else max(state - 1, 0)


def _within(kind, reach=REACH):
    return {(s, kind): reach for s in range(reach + 1)}


INSULT = Transducer({}, out={(0, "I"): 1.0})
THREATS = Transducer(_within("T"), out={(s, "Y"): 1.0 for s in range(1, REACH + 1)})
TARGETED = Transducer(_within("Y"), factor={s: 1.25 for s in range(1, REACH + 1)})
NEGATED = Transducer(_within("N"), factor={s: 0.5 for s in range(1, REACH + 1)})
REPORT = Transducer({(0, "R"): 1}, factor={1: 0.6}, sticky=True)


class Grammar:
    """Product of emitters and modifiers: table[(state, class)] -> (state, output)."""

    def __init__(self, emitters=(INSULT, THREATS), modifiers=(TARGETED, NEGATED, REPORT)):
        self.table, start, parts = {}, (0,) * (len(emitters) + len(modifiers)), (*emitters, *modifiers)
        ids, todo = {start: 0}, [start]
        while todo:
            state = todo.pop()
            for kind in CLASSES:
                scale = math.prod(m.factor.get(s, 1.0) for m, s in zip(modifiers, state[len(emitters):]))
                put = scale * sum(e.out.get((s, kind), 0.0) for e, s in zip(emitters, state))
                after = tuple(p.step(s, kind) for p, s in zip(parts, state))
                if after not in ids:
                    ids[after] = len(ids)
                    todo.append(after)
                self.table[ids[state], kind] = ids[after], put

    def run(self, kinds, weights):
        """Total output of one clause."""
        state, total = 0, 0.0
        for kind, weight in zip(kinds, weights):
            state, put = self.table[state, kind]
            total += put * weight
        return total


@dataclass
class Model:
    stems: dict              # word beginning, or whole word ending in $ -> weight
    coefficients: list       # of the features, then the constant
    grammar: Grammar = field(default_factory=Grammar)
    threat_weight: float = 4.0

    def __post_init__(self):
        import ahocorasick
        self.fixed = {**dict.fromkeys(THREAT, "T"), **dict.fromkeys(TARGET, "Y"), **dict.fromkeys(NEGATION, "N"), **dict.fromkeys(REPORTED, "R")}
        self.anchors = ahocorasick.Automaton()
        for word in {*(s.rstrip("$") for s in self.stems), *THREAT}:
            self.anchors.add_word(word, len(word))
        self.anchors.make_automaton()

    def __getstate__(self):
        return {"stems": self.stems, "coefficients": self.coefficients, "grammar": self.grammar, "threat_weight": self.threat_weight}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def weigh(self, word: str) -> float:
        """Weight of the best stem of a word, 0 without one."""
        best = self.stems.get(word + "$", 0.0)
        for n in PREFIXES:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clauses(self, text: str):
        """Output of each clause that holds an anchor."""
        text = text.lower()
        starts = {end + 1 - n for end, n in self.anchors.iter(text)}
        out, stop = [], -1
        for at in sorted(s for s in starts if s == 0 or not text[s - 1].isalpha()):
            if at < stop:
                continue
            start = max(text.rfind(c, 0, at) for c in ".!?;:\n") + 1
            end = _CLAUSE.search(text, at)
            stop = end.start() if end else len(text)
            words = _WORD.findall(text, start, stop)
            weights = [self.weigh(w) for w in words]
            kinds = ["I" if x else self.fixed.get(w, "O") for w, x in zip(words, weights)]
            weights = [x or self.threat_weight for x in weights]
            got = self.grammar.run(kinds, weights)
            if got > 0:
                out.append(got)
        return out

    def features(self, text: str | None) -> list[float]:
        found = self.clauses(text) if text else []
        total = sum(found)
        return [math.log1p(total), math.log1p(max(found, default=0.0)), float(len(found) > 1), math.log1p(len(text or "")) / 10 * (total > 0)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.coefficients, [*self.features(text), 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _patterns(word):
    yield word + "$"
    for n in PREFIXES:
        if n > len(word):
            break
        yield word[:n]


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, n, toxic_n): labelled documents with each word beginning, summed per block first."""

    def make(batches):
        for block in blocks.text_blocks(batches, "text", 4 << 20):
            seen = [Counter(), Counter()]
            for text, toxic in zip(block.column(1).to_pylist(), block.column(2).to_pylist()):
                found = {p for w in set(_WORD.findall((text or "").lower())) if len(w) > 2 for p in _patterns(w)}
                seen[toxic].update(found)
            rows = [(k, c, t * c) for t in (0, 1) for k, c in seen[t].items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["stem", "n", "toxic_n"])

    return sample.mapInArrow(make, "stem string, n long, toxic_n long").groupBy("stem").agg(
        F.sum("n").alias("n"), F.sum("toxic_n").alias("toxic_n"))


def _neighbours(sample: DataFrame, stems) -> DataFrame:
    """(stem, toxic, n): different words that stand before the stem in each class."""
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(stems))

    def make(batches):
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                before = ""
                for word in _WORD.findall((text or "").lower()):
                    for p in _patterns(word):
                        if p in wanted.value:
                            rows.add((p, toxic, before))
                    before = word
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["stem", "toxic", "before"])

    return sample.mapInArrow(make, "stem string, toxic long, before string").distinct().groupBy("stem", "toxic").agg(F.count("*").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, part) of at most ``max_docs`` documents whose id's crc32 is not 0
    modulo 5; part 4 calibrates, the others give stems."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.max("toxic").cast("int").alias("toxic")).withColumn("part", hash_fold(F.col("doc_id"), 5).cast("int"))
           .where("part <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    return texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic", "part")


def _weights(counts, toxic_all, clean_all):
    """log of toxic over clean frequency, the clean count raised by its own uncertainty."""
    t, c = counts
    return math.log((t + 0.5) / (toxic_all + 1)) - math.log((c + 1 + math.sqrt(c)) / (clean_all + 2))


def _logistic(x, y, ridge=1e-2, steps=60):
    """Newton steps with a small ridge; classes weigh as they are."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * np.append(b[:-1], 0) / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge / 10 * np.eye(len(b))
        b -= np.linalg.solve(h, g)
    return b.tolist()


DEFAULT = [2.0, 2.0, 1.0, -1.0, -4.0]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE) -> Model:
    sample = stage(labelled(docs, labels, max_docs), "toxicity-sample")
    for_stems = sample.where("part <> 4")
    sizes = {r["toxic"]: r["n"] for r in for_stems.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, DEFAULT)
    ratio = F.log((F.col("toxic_n") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic_n") + 1) / (clean + 2))
    found = (_stem_counts(for_stems).where(F.col("toxic_n") >= MIN_TOXIC).withColumn("w", ratio).where(F.col("w") >= MIN_WEIGHT)
             .orderBy(F.desc(F.col("w") * F.sqrt("toxic_n")), "stem").limit(CANDIDATES).select("stem").collect())
    near = {}
    for r in _neighbours(for_stems, [r["stem"] for r in found]).collect():
        near.setdefault(r["stem"], [0, 0])[1 - r["toxic"]] = r["n"]
    weights = {s: _weights(c, toxic, clean) for s, c in near.items() if c[0] >= MIN_TOXIC}
    kept = sorted((s for s in weights if weights[s] >= MIN_WEIGHT), key=lambda s: (-weights[s], s))[:STEMS]
    model = Model({s: round(weights[s], 6) for s in kept}, DEFAULT)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(t) for t in text], dtype=object)

    rows = sample.where("part = 4").orderBy("doc_id").select("toxic", features("text").alias("x")).collect()
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        model.coefficients = _logistic(np.array([r["x"] for r in rows], float), y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, with their columns."""
    scored = score(docs, fit(docs, labels), out_col="_toxicity")
    return scored.where(F.col("_toxicity") < threshold).drop("_toxicity")


def query(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(texts(docs), model).select(
        "doc_id", (hash_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
