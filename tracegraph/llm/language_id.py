"""Operator 1, language identification.

A document becomes the TF-IDF vector, of length one, of its hashed character n-grams (1 to 3 letters, lower case, everything
else a space); document frequencies are counted over all documents. A multinomial logistic
regression is trained on documents with a language label by follow-the-regularised-leader (FTRL-proximal, one rate for each
weight, L1 and L2 penalties, so most weights are exactly zero), then a temperature that minimises the loss on
held-out labelled rows divides its scores. Only the fit is bounded: it uses about MAX_TRAIN labelled documents, of each language its share
but LEAST_TRAIN at least (or all it has), those of the smallest hash of doc_id and text; rows that repeat whole count once. Their texts count whole, but only their
counts of FEATURES come to the driver, so their length doesn't matter. Every
language that labels a text with a letter is in the model at every size; over MOST_LANGUAGES of them are refused, as labels are then no languages.

Defined results: a null, empty or letterless text has predicted and confidence null and is rejected; without any
labelled text there is no model, nothing is predicted and every document is accepted; of languages as probable the first by name is predicted, and a
confidence of exactly MIN_CONFIDENCE is accepted; very long texts count whole; null doc_ids stay
null; rows that repeat are judged alike; other columns are not read (the filter keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import codes, fresh, give_back, importable, letters, trimmed

BITS = 14
FEATURES = 1 << BITS
MAX_TRAIN = 3000  #: bound of the labelled rows that the classifier is fitted on
LEAST_TRAIN = 50  #: labelled rows of a language that are taken however rare it is
HELD_OUT = 5  #: every fifth of a language's calibrates the temperature
MIN_CONFIDENCE = 0.5
MOST_LANGUAGES = 2000  #: weights are FEATURES for each
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 3


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = codes(text.lower())
    a = np.where(letters()[a], a, np.uint32(32))
    a = np.concatenate((a[:1] * 0 + 32, a, a[:1] * 0 + 32)).astype(np.uint32)
    if not (a != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        one = a * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (a[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (a[2:] * np.uint32(0x165667B1) + np.uint32(0x7FEB352D))) * np.uint32(0x9E3779B1)
    blank = a == 32
    two, three = two[~(blank[:-1] & blank[1:])], three[~(blank[:-2] & blank[1:-1] & blank[2:])]
    at = np.concatenate((one[~blank], two, three)) >> np.uint32(32 - BITS)
    counts = np.bincount(at.astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(n)) * idf[at] if len(at) else np.empty(0)
    norm = math.sqrt(float(x @ x))
    return (at, x / norm) if norm > 0 else (at[:0], x[:0])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression, one example at a time, per-weight rates, elastic net."""

    def __init__(self, features: int, classes: int) -> None:
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    """A fitted classifier."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        at, x = _vector(*ngram_counts(text), self.idf)
        return _softmax(x @ self.weights[at] / self.temperature) if len(at) else None


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Least loss over temperatures, by golden section on the logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(scores / math.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], documents: int, frequency: np.ndarray) -> Model | None:
    """Model of (lang, features, counts) in the order of learning before it is shuffled; frequency: documents with each feature."""
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(7)
    number = {lang: k for k, lang in enumerate(languages)}
    examples = [(*_vector(at, n, idf), number[lang]) for lang, at, n in rows]
    examples = [e for e in examples if len(e[0])]
    held, own, seen = [], [], [0] * len(languages)
    for e in examples:
        seen[e[2]] += 1
        (own if seen[e[2]] % HELD_OUT else held).append(e)
    ftrl = Ftrl(FEATURES, len(languages))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(own)):
            ftrl.learn(*own[k])
    w = ftrl.weights(slice(None))
    scores = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), -1)
    return Model(languages, w.astype(np.float32), idf.astype(np.float32), _temperature(scores, np.array([y for _, _, y in held], dtype=int)))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, n = np.zeros(FEATURES, dtype=np.int64), 0
    for pdf in batches:
        for text in pdf["text"]:
            counts[ngram_counts(text)[0]] += 1
            n += 1
    if n:
        yield pd.DataFrame({"feature": np.r_[np.arange(FEATURES), -1], "n": np.r_[counts, n]})


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Counts over all documents, then the bounded fit on the driver."""
    importable(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(trimmed(_frequencies), "feature long, n long")
    totals = {r["feature"]: r["n"] for r in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    documents = totals.get(-1, 0)
    frequency = np.array([totals.get(k, 0) for k in range(FEATURES)], dtype=float)
    rows = sample(docs, max_train).mapInPandas(trimmed(_counted), "hash long, lang string, features binary, counts binary").orderBy("hash", "lang", "features").collect()
    return fit([(r["lang"], np.frombuffer(r["features"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in rows], documents, frequency)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [ngram_counts(text) for text in pdf["text"]]
        yield pd.DataFrame({"hash": pdf["hash"], "lang": pdf["lang"], "features": [at.tobytes() for at, _ in found], "counts": [n.astype(np.int64).tobytes() for _, n in found]})


def sample(docs: DataFrame, max_train: int = MAX_TRAIN, least: int = LEAST_TRAIN) -> DataFrame:
    """(hash, lang, text) of the labelled rows with a letter that the fit takes.

    The rows of smallest hash of each language, up to its quota. Only rows under a bound are sorted: about twice the quota, and the smallest hash.
    """
    spread, number = 1 << 62, "rank_of_row"
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread)).alias("hash"), "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("low")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} language labels")
    total = sum(r["n"] for r in counts)
    limits = []
    for r in counts:
        quota = min(r["n"], max(least, math.ceil(max_train * r["n"] / total)))
        limits.append((r["lang"], quota, max(r["low"], min(spread, spread * 2 * quota // r["n"]))))
    quotas = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, quota long, bound long"))
    few = labelled.join(quotas, "lang").where("hash <= bound").dropDuplicates(["lang", "hash"])
    few = few.withColumn(number, F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    return few.where(F.col(number) <= F.col("quota")).select("hash", "lang", "text")


def judge(model: Model | None, min_confidence: float = MIN_CONFIDENCE):
    """The pandas UDF text -> struct(predicted, confidence, accepted)."""

    @F.pandas_udf("predicted string, confidence double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            p = model.probabilities(text) if model else None
            k = None if p is None else int(p.argmax())
            out.append((None, None, model is None) if k is None else (model.languages[k], round(float(p[k]), 6), bool(p[k] >= min_confidence)))
        give_back()
        return pd.DataFrame(out, columns=["predicted", "confidence", "accepted"])

    return run


def identify(docs: DataFrame, max_train: int = MAX_TRAIN, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, lang, predicted, confidence, accepted) for every row."""
    run = judge(train(docs, max_train), min_confidence)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), run(F.col("text").cast("string")).alias("found"))
    return own.select("doc_id", "lang", "found.predicted", "found.confidence", "found.accepted")


def keep_identified(docs: DataFrame, max_train: int = MAX_TRAIN, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of docs, all columns, whose language is identified with enough confidence."""
    run = judge(train(docs, max_train), min_confidence)
    found = fresh(docs, "found_language")
    return docs.withColumn(found, run(F.col("text").cast("string"))).where(F.col(found)["accepted"]).drop(found)
