"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax.

The bag is the n-grams of one word, so a misspelling shares most of its bag with the word that was
seen. Labels are of documents, some of them wrong: a word may be toxic if most of its documents are,
by more than their share; training starts from those words for which chance would not do that, and
the model relabels the others after every round. A document scores as its most toxic word, so
length does not dilute it; one document in four of the sample is left out of training and turns that
largest logit into a probability.

Training reads at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents outside the held-out
fold (documented bounds; chosen by a hash of doc_id), whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import SMALL_STEP_BYTES, text_steps
from bidlake.llm.language import held_out, one_each
from bidlake.llm.subwords import Model, all_words, bags, distinct_words, lowered, train

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SIZES = (3, 5)
BUCKETS = 1 << 18
ROUNDS = 2
EPOCHS = 8
CHANCE = 1e-4
SURE_LOGIT = 2.0
BALANCE = 5.0
THRESHOLD = 0.7
_NO_WORD = -30.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class ToxicityModel:
    """Word logits of a model, and the line that turns a document's largest into a probability."""

    def __init__(self, model: Model | None, slope: float = 1.0, offset: float = 0.0):
        self.model, self.slope, self.offset = model, slope, offset

    def word_logits(self, words: pa.Array) -> np.ndarray:
        sums, grams = self.model.word_sums(words)
        return (sums[:, 1] - sums[:, 0]) / np.maximum(grams, 1) + self.model.bias[1] - self.model.bias[0]

    def largest(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest word logit of each text."""
        words, number, text = distinct_words(data, starts)
        out = np.full(len(starts) - 1, _NO_WORD)
        if len(number):
            np.maximum.at(out, text, self.word_logits(words)[number])
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fold."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = (F.xxhash64("doc_id"), "doc_id", "toxic")
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(
        marked.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    texts = docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # the limits bound the broadcast (4,500 rows of an id and a label) and the texts of the sample
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).filter("text is not null").select("doc_id", "toxic", "text")
    sample = one_each(found, "doc_id", "toxic").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic_doc = sample.column("toxic").to_numpy().astype(bool)
    if not len(toxic_doc) or toxic_doc.all() or not toxic_doc.any():
        return ToxicityModel(None)
    words, number, text = all_words(sample)
    left_out = np.arange(len(toxic_doc)) % 4 == 0
    mine = ~left_out[text]
    pairs = np.unique(text[mine] * np.int64(len(words)) + number[mine])  # a word counts once per document
    by_word, by_doc = pairs % len(words), pairs // len(words)
    in_toxic = np.bincount(by_word, toxic_doc[by_doc], len(words))
    evidence, open_ = _evidence(in_toxic, np.bincount(by_word, minlength=len(words)), toxic_doc[~left_out].mean())
    clean = ~open_ & (np.bincount(by_word, ~toxic_doc[by_doc], len(words)) > 0)
    positive = open_ & (evidence >= min(-np.log(CHANCE), evidence[open_].max(initial=0)))
    grams = bags(words, SIZES, BUCKETS)
    model = ToxicityModel(None)
    for turn in range(ROUNDS):
        balance = np.sqrt(clean.sum() / max(positive.sum(), 1)).clip(1, BALANCE)
        unsure = open_ & (turn > 0)  # words not chosen count as not toxic from the second round on
        weight = np.where(positive, balance, np.where(clean | unsure, 1.0, 0.0))
        size = (weight > 0).astype(np.int64)  # a bag is one word
        model.model = train(np.flatnonzero(size), size, positive.astype(np.int64), grams, 2, BUCKETS, SIZES, epochs=EPOCHS,
                            rate=4.0, weight=weight, seed=turn + 1)
        logit = model.word_logits(words)
        chosen = open_ & (logit > SURE_LOGIT)
        positive = chosen if chosen.any() else positive
    largest = np.full(len(toxic_doc), _NO_WORD)
    np.maximum.at(largest, text, logit[number])
    # on documents whose words the model has not learnt
    fresh = left_out if len(set(toxic_doc[left_out])) == 2 else np.ones(len(left_out), bool)
    model.slope, model.offset = _line(largest[fresh], toxic_doc[fresh])
    return model


def _evidence(in_toxic: np.ndarray, in_all: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Per word, how unlikely chance makes its documents as toxic as they are (a bound on -log of the
    probability), and whether toxic ones are the bulk of them. One wrong label changes both a little."""
    rate = in_toxic / np.maximum(in_all, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(rate > 0, rate * np.log(rate / share), 0) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
    return np.where(rate > share, in_all * gap, 0), rate > (1 + share) / 2


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x, by damped Newton steps with a slight penalty on the slope. Classes
    weigh by the square root of what would balance them, half way between all rows and both classes alike."""
    centre, spread = x.mean(), max(x.std(), 1e-9)
    weight = np.sqrt(np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    a = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1)
    penalty = np.array([0.05, 0.0])

    def loss(beta: np.ndarray) -> float:
        z = a @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * beta * beta).sum() / 2)

    beta = np.array([1.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        gradient = a.T @ (weight * (p - y)) + penalty * beta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-4 and not loss(beta - size * step) <= loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slope = float(beta[0] / spread)
    return (slope, float(beta[1] - slope * centre)) if slope > 0 else (1.0, 0.0)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text).

    A null text or one without a word scores near 0; without labelled rows of both kinds every
    score is 0. Repeated rows are scored each; null ids stay null; other columns are not read.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(map(lowered, batches), step_bytes=SMALL_STEP_BYTES):
            p = np.zeros(len(starts) - 1) if model.model is None else model.probability(model.largest(data, starts))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(p),
                "predicted": pa.array((p >= threshold).astype(np.int32))})

    return kept.mapInArrow(run, SCHEMA)
