"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model of
its words and their beginnings (offending stems take many endings); the document's is the
noisy-or, 1 - prod(1 - p). Only documents have labels: the gradient of the bag's loss reaches
its sentences in proportion to what each contributes, so the model learns which sentences
offend, and can name them. Scores are calibrated on documents of the sample that a model
fitted without them has scored.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.shared import id_crc

#: Labelled documents from which the model is fitted, at most, and their length.
SAMPLE_DOCUMENTS = 3500
SAMPLE_CHARS = 20_000
#: Features need this many documents of the sample; the model holds so many at most.
MIN_DOCUMENTS = 2
MOST_FEATURES = 40_000
#: Letters of the beginnings that count as features.
BEGINNINGS = (4, 5)
#: Words whose weight a worker remembers; bounds memory only.
REMEMBERED = 300_000
STEPS = 200
#: Parts of the sample that are scored by a model of the others, for calibration.
FOLDS = 3
PREDICTED_FROM = 0.7
#: Probability from which a sentence counts as offending.
OFFENDING = 0.5

_SENTENCE = re.compile(r"[.!?\n]+")
_EDGE = ".,;:!?\"'()[]{}*#_-"


def sentences(text: str | None) -> list[list[str]]:
    return [w for part in _SENTENCE.split((text or "").lower()) if (w := [x.strip(_EDGE) for x in part.split()])]


def features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in BEGINNINGS if len(word) >= n]]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    slope: float = 1.0
    shift: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, w: str) -> float:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return found

    def sentence(self, words: list[str]) -> float:
        """The logit of one sentence; each distinct word counts once."""
        return self.bias + sum(map(self.word, sorted(set(words))))

    def logits(self, text: str | None) -> np.ndarray:
        return np.array([self.sentence(words) for words in sentences(text)])

    def bag(self, z: np.ndarray) -> float:
        """The logit of the noisy-or of sentences with these logits; minus infinity without any."""
        missed = float(np.logaddexp(0.0, z).sum())  # minus the log probability that none offends
        return missed + float(np.log(-np.expm1(-missed))) if missed > 0 else -np.inf

    def score(self, z: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.bag(z) + self.shift, -700, 700)))) if len(z) else 0.0


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over logits ``x`` that others' models gave, with labels ``y``.

    The slope is that of the best fit, by Newton's steps. The shift puts PREDICTED_FROM where telling
    toxic from clean has the best F1 among these documents; between equally good places, in the middle."""
    x = np.clip(x, -30, 30)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    design = np.column_stack((x, np.ones_like(x)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + 1e-3 * (w - (1.0, 0.0))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, grad), -1, 1)
    slope = max(float(w[0]), 0.05)
    return slope, float(np.log(PREDICTED_FROM / (1 - PREDICTED_FROM))) - slope * best_cut(x, y)


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The place among logits ``x`` above which calling documents toxic has the best F1."""
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    caught, called = np.cumsum(y), np.arange(1, len(x) + 1)
    ends = np.append(x[:-1] > x[1:], True)  # equal logits can't be parted
    f1 = np.where(ends, 2 * caught / (called + y.sum()), -1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)


def fit_calibrated(texts: list[str | None], labels: list[int], fits: Callable[[Callable[[int], bytes]], dict[int, bytes]] | None = None) -> Model:
    """:func:`fit` on all, with the curve from FOLDS parts that models of the others have scored.

    ``fits`` runs the FOLDS + 1 fits (by default one after the other here)."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return fit(texts, labels)

    def part(k: int) -> bytes:
        """What fold ``k``'s model says about its own documents; for FOLDS the model of all."""
        if k == FOLDS:
            return pickle.dumps(fit(texts, labels))
        rest = [i for i in range(len(texts)) if i % FOLDS != k]
        model = fit([texts[i] for i in rest], [labels[i] for i in rest])
        return np.array([model.bag(model.logits(texts[i])) for i in range(k, len(texts), FOLDS)]).tobytes()

    done = {k: part(k) for k in range(FOLDS + 1)} if fits is None else fits(part)
    model, x = pickle.loads(done[FOLDS]), np.zeros(len(y))
    if not model.weights:
        return model
    for k in range(FOLDS):
        x[k::FOLDS] = np.frombuffer(done[k])
    return Model(model.bias, model.weights, *calibrated(x, y))


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS) -> Model:
    """Full-batch Adam on the noisy-or loss; deterministic. Without both labels, a model that scores 0."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(-40.0, {})
    seen: Counter = Counter()
    for text in texts:
        seen.update({f for words in sentences(text) for w in words for f in features(w)})
    often = sorted(((n, f) for f, n in seen.items() if n >= MIN_DOCUMENTS), key=lambda x: (-x[0], x[1]))[:MOST_FEATURES]
    del seen
    vocabulary = {f: i for i, (_, f) in enumerate(often)}
    doc_of, row_of, word_of, rows = array("i"), array("i"), array("i"), 0
    for d, text in enumerate(texts):
        for words in sentences(text):
            own = [vocabulary[f] for w in sorted(set(words)) for f in features(w) if f in vocabulary]
            doc_of.append(d)
            word_of.extend(own)
            row_of.extend([rows] * len(own))
            rows += 1
    doc_of, row_of, word_of = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (doc_of, row_of, word_of))
    theta = np.zeros(len(vocabulary) + 1)
    positive = np.zeros(len(vocabulary))
    pairs = np.unique(doc_of[row_of].astype(np.int64) * len(vocabulary) + word_of) if len(row_of) else np.zeros(0, np.int64)
    np.add.at(positive, pairs % max(len(vocabulary), 1), y[pairs // max(len(vocabulary), 1)])
    total = np.bincount(pairs % max(len(vocabulary), 1), minlength=len(vocabulary))[: len(vocabulary)]
    theta[:-1] = np.clip(np.log((positive + 0.5) / (y.sum() + 1)) - np.log((total - positive + 0.5) / ((1 - y).sum() + 1)), -1, 3)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row_of, theta[word_of], minlength=rows)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), minlength=len(y)))
        bag = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = bag[doc_of] * p
        grad = np.append(np.bincount(word_of, g[row_of], minlength=len(vocabulary)), g.sum()) / len(y)
        grad[:-1] += 2e-5 * np.sign(theta[:-1]) + 2e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(float(theta[-1]), {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.05})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE_DOCUMENTS labelled documents whose id isn't held out.

    Rows without a label don't count; a document with several labels is toxic if one says so.
    Documents are chosen by a hash of their ids among ids alone; only the texts of the chosen
    are fetched, each distinct text of an id once (SAMPLE_DOCUMENTS in all), and those beyond
    SAMPLE_CHARS left out.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = labels.where("toxic is not null and doc_id is not null").where(id_crc() % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("place", place)
    total = known.count()
    # a few more than needed, so that tasks send no more than that
    share = min(1.0, (SAMPLE_DOCUMENTS + 6 * SAMPLE_DOCUMENTS**0.5) / max(total, 1))
    chosen = known.where(F.col("place") < F.lit(int(share * (1 << 30)))).orderBy("place", "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int")
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(wanted), "doc_id")
    once = texts.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    # an id may stand for many texts: of all, as many as documents may be fitted, by a hash of both
    few = once.orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash").limit(SAMPLE_DOCUMENTS)
    rows = sorted(few.collect(), key=lambda r: (r["doc_id"], r["hash"]))
    return fit_calibrated([r["text"] for r in rows], [r["toxic"] for r in rows], lambda part: _in_tasks(docs.sparkSession, part))


def _in_tasks(spark: SparkSession, part: Callable[[int], bytes]) -> dict[int, bytes]:
    """Each fit in a task of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"k": frame["id"], "found": [part(int(k)) for k in frame["id"]]})

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "k long, found binary").collect()
    return {r["k"]: bytes(r["found"]) for r in found}


def scored(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """All columns of ``docs`` with held_out, score, predicted and offending: the numbers (from 0)
    of the sentences whose own probability is ``least`` or more.

    Null and empty texts score 0 and have no sentences. Repeated rows are scored alike, null ids
    count as the empty text in the split, and an empty table gives an empty table. Columns of
    ``docs`` named like an added one are replaced.
    """

    @F.pandas_udf("score double, offending array<int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        scores, offending = [], []
        line = float(np.log(least / (1 - least)))
        for text in texts:
            z = model.logits(text)
            scores.append(model.score(z))
            offending.append(np.flatnonzero(z >= line).tolist())
        return pd.DataFrame({"score": scores, "offending": offending})

    docs = docs.drop("held_out", "score", "predicted", "offending")
    found = of(F.col("text").cast("string"))
    out = docs.withColumn("offending", found).withColumn("held_out", id_crc() % 3 == 1)
    return out.withColumns({"score": F.col("offending.score"), "predicted": (F.col("offending.score") >= PREDICTED_FROM).cast("int"), "offending": F.col("offending.offending")})


def offending_sentences(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """doc_id, sentence (number from 0), probability and words of sentences from ``least`` on."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
                for k, words in enumerate(sentences(text)):
                    if (p := 1 / (1 + np.exp(-model.sentence(words)))) >= least:
                        out.append((None if pd.isna(doc_id) else int(doc_id), k, float(p), " ".join(words)))
            found = pd.DataFrame(out, columns=["doc_id", "sentence", "probability", "words"])
            found["doc_id"] = found["doc_id"].astype("Int64")
            yield found

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(find, "doc_id long, sentence long, probability double, words string")
