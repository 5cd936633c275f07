"""Language of whole texts: averaged hashed subword embeddings, linear softmax, calibrated rejection.

The model learns from at most ``SAMPLE_PER_LANGUAGE`` labelled documents of each of at most
``MAX_LANGUAGES`` languages outside the held-out fold (documented bounds; chosen by a hash of
doc_id), cut into segments of ``SEGMENT_WORDS`` words so that short texts are learnt too. One document
in five of the sample is left out of training: it sets the temperature of the scores and the bounds
of rejection. A softmax score cannot tell a text in an unlearnt language where few are learnt, so a text
is also rejected if its n-grams are too rare in the language predicted for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import SMALL_STEP_BYTES, text_steps
from bidlake.llm.subwords import Model, all_words, bags, distinct_words, lowered, softmax, train

SAMPLE_PER_LANGUAGE = 400
MAX_LANGUAGES = 200
SEGMENT_WORDS = 25
SIZES = (2, 4)
BUCKETS = 1 << 16
UNSEEN = 0.1  # the count of an n-gram that a language has not shown
FEW_GRAMS = 200  # texts with fewer n-grams than this count less against the language
LOW = 0.01  # the share of rightly predicted left-out documents that the bounds may pass over
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the ``rows`` of each key, whatever their order: that of the smallest hash of ``text``."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.md5("text"))).alias("text"))


class LanguageModel:
    """A trained model with its languages, temperature, rejection score and bound of strangeness.

    The table of ``model`` holds the logits of all languages and then their log frequencies;
    ``usual`` is the mean log frequency of a document for each language.
    """

    def __init__(self, model: Model | None, languages: list[str], temperature: float = 1.0, least: float = 0.0):
        self.model, self.languages, self.temperature, self.least = model, languages, temperature, least
        self.usual, self.strangest = np.zeros(len(languages)), np.inf

    def scores(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean logits of each text and class, mean log frequencies, n-grams of each text)."""
        words, number, text = distinct_words(data, starts)
        sums, grams = self.model.word_sums(words)
        n, classes = len(starts) - 1, len(self.languages)
        total = np.bincount(text, grams[number], n)
        mean = np.stack([np.bincount(text, sums[number, c], n) for c in range(sums.shape[1])], axis=1)
        mean = mean / np.maximum(total, 1)[:, None]
        return mean[:, :classes] + self.model.bias, mean[:, classes:], total

    def strangeness(self, best: np.ndarray, frequencies: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """How far the n-grams of each text are from those of language ``best``."""
        return (self.usual[best] - frequencies[np.arange(len(best)), best]) * np.sqrt(grams / (grams + FEW_GRAMS))

    def judged(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the best language, its score, whether the text is accepted) of each text."""
        z, frequencies, grams = self.scores(data, starts)
        p = softmax(z / self.temperature)
        best, top = p.argmax(axis=1), p.max(axis=1)
        return best, top, (top >= self.least) & (self.strangeness(best, frequencies, grams) <= self.strangest)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from text and non-null lang of rows outside the held-out fold."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang").distinct()
    chosen = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language)
    ids = chosen.select("doc_id", F.col("lang").alias("l")).orderBy("r", "l").limit(per_language * MAX_LANGUAGES)
    # the limit bounds the broadcast (80,000 rows of an id and a language) and the texts of the sample
    texts = docs.filter("text is not null").join(F.broadcast(ids), (docs["doc_id"] == ids["doc_id"]) & (docs["lang"] == ids["l"])).select(
        ids["doc_id"], F.col("l").alias("lang"), "text")
    sample = one_each(texts, "doc_id", "lang").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    languages = sorted(set(sample.column("lang").to_pylist()))
    if not languages:
        return LanguageModel(None, [])
    label_of = np.array([languages.index(x) for x in sample.column("lang").to_pylist()])
    words, number, text = all_words(sample)
    if not len(number):
        return LanguageModel(None, [])
    place = np.arange(len(text)) - np.searchsorted(text, text, side="left")
    first = np.flatnonzero(place % SEGMENT_WORDS == 0)
    size = np.diff(first, append=len(text))
    doc = text[first]
    keep = doc % 5 != 0
    label = label_of[doc[keep]]
    weights = 1.0 / np.maximum(np.bincount(label_of[doc], minlength=len(languages)), 1)
    grams, kept = bags(words, SIZES, BUCKETS), np.repeat(keep, size)
    model = LanguageModel(train(number[kept], size[keep], label, grams, len(languages), BUCKETS, SIZES, epochs=3,
                                weight=(weights * len(doc) / len(languages))[label].clip(0, 5)), languages)
    seen, of = number[kept], label_of[text[kept]]
    frequencies = np.zeros((BUCKETS, len(languages)), np.float32)
    for c in range(len(languages)):
        count = np.bincount(grams[1], np.bincount(seen[of == c], minlength=len(words))[grams[0]], BUCKETS) + UNSEEN
        frequencies[:, c] = np.log(count / count.sum())
    model.model.logits = np.hstack([model.model.logits, frequencies])
    _calibrate(model, sample, label_of)
    return model


def _calibrate(model: LanguageModel, sample: pa.Table, label_of: np.ndarray) -> None:
    """Temperature by least log loss, and the bounds of rejection, on documents left out of training."""
    rows = np.arange(0, len(label_of), 5)
    parts = []
    left_out = sample.take(pa.array(rows)).select(["text"]).to_batches(max_chunksize=256)
    for _, data, starts in text_steps(map(lowered, left_out), step_bytes=2_000_000):
        parts.append(model.scores(data, starts))
    z, frequencies, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    has = grams > 0
    z, frequencies, grams, truth = z[has], frequencies[has], grams[has], label_of[rows][has]
    if not len(z):
        return
    losses = {t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in (0.25, 0.5, 1.0, 2.0, 4.0)}
    model.temperature = min(losses, key=losses.get)
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == truth
    if not right.any():
        return
    # half of what the least sure right predictions of the left-out documents score
    model.least = float(np.quantile(p.max(axis=1)[right], LOW)) / 2
    frequencies, grams, truth = frequencies[right], grams[right], truth[right]
    own = frequencies[np.arange(len(truth)), truth]
    model.usual = np.array([np.median(own[truth == c] if (truth == c).any() else own) for c in range(len(model.languages))])
    # four times as far from the middle as the strangest right ones: passages like licences or addresses are in no language
    strange = model.strangeness(truth, frequencies, grams)
    middle = float(np.median(strange))
    model.strangest = middle + 4 * (float(np.quantile(strange, 1 - LOW)) - middle)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row of ``docs`` (doc_id, text).

    A null text or one without a letter gives ``und`` with score 0 and is rejected, as is every text
    if no language was learnt. ``rejected`` also marks scores below the calibrated bound and texts too
    strange for the language predicted; their lang_pred stays. Repeated rows are scored each; null ids stay null; other columns are not read.
    """
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(map(lowered, batches), step_bytes=SMALL_STEP_BYTES):
            n = len(starts) - 1
            best, top, usual = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            if model.model is not None:
                best, top, usual = model.judged(data, starts)
            known = letters & (model.model is not None)
            top = np.where(known, top, 0.0)
            names = np.array([*model.languages, UNKNOWN], object)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                "score": pa.array(top), "rejected": pa.array(~known | ~usual)})

    return kept.mapInArrow(score, SCHEMA)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns, whatever their names.

    Null texts, texts without a letter and, if no language was learnt, all texts are rejected. Repeated
    rows are judged each; null ids stay null. An empty table gives no rows.
    """
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    nested = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), letters.alias("letters"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(_with_lowered(batches), "lower", SMALL_STEP_BYTES):
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            if model.model is None:
                known = np.zeros(len(known), bool)
            else:
                known = known & model.judged(data, starts)[2]
            yield batch.select(["row"]).filter(pa.array(known))

    return nested.mapInArrow(keep, nested.select("row").schema).select("row.*")


def _with_lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["row", "letters"]).append_column("lower", lowered(batch.select(["text"])).column("text"))
