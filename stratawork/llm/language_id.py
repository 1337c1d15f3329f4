"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies count all documents that may be learned from. The weights are trained on a bounded sample with
follow-the-regularised-leader and elastic-net penalties, which leaves weights without evidence at zero; one temperature,
found on the part of the sample that was set aside, calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import held_out, pieces, steps

#: Hashed n-grams of one to GRAMS letters; words are kept apart by one space.
BUCKETS, GRAMS = 2**15, 3
#: About so many documents of each language, drawn by a hash of their ids, fit the weights, MOST_SAMPLE in all. Of longer
#: texts the fit sees MOST_CHARS, in pieces from all over them.
SAMPLE, MOST_SAMPLE, MOST_CHARS = 1200, 12_000, 10_000
#: Every fifth document of the sample is set aside for the temperature.
ASIDE = 5
#: Temperatures whose mean log loss differs by less than this are equally good; the highest is taken.
TIE = 0.001
EPOCHS, RATE, RIDGE, LASSO = 3, 0.5, 1.0, 0.1

UNDECIDED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _grams(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a text; None if it has no letter."""
    if not text:
        return None
    text = _OTHER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, text)):
        return None
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    found = []
    rolling = np.zeros(len(codes), np.uint32)
    for n in range(1, GRAMS + 1):
        rolling = rolling[: len(codes) - n + 1] * np.uint32(31) + codes[n - 1 :] * _FACTORS[n - 1]
        spread = rolling ^ (rolling >> np.uint32(15))
        found.append((spread * np.uint32(0x2C1B3C6D) >> np.uint32(17)) & np.uint32(BUCKETS - 1))
    return np.concatenate(found)


def _vector(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their TF-IDF values, of length one."""
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    return at, value / max(np.sqrt(value @ value), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts of a partition that hold each bucket; bucket -1 counts the texts."""
    texts, found = 0, np.zeros(BUCKETS, np.int64)
    for batch in steps(batches):
        for text in batch.column("text").to_pylist():
            if (grams := _grams(text)) is not None:
                texts += 1
                found += np.bincount(grams, minlength=BUCKETS) > 0
    if texts:
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], texts))], ["bucket", "texts"]
        )


def _probabilities(weights: np.ndarray, at: np.ndarray, value: np.ndarray, temperature: float) -> np.ndarray:
    logits = weights[:, at] @ value / temperature
    odds = np.exp(logits - logits.max())
    return odds / odds.sum()


def _fit(texts: list[str], labels: list[int], classes: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    vectors = [(_vector(grams, idf), label) for text, label in zip(texts, labels) if (grams := _grams(text)) is not None]
    aside = [x for k, x in enumerate(vectors) if k % ASIDE == ASIDE - 1]
    fit = [x for k, x in enumerate(vectors) if k % ASIDE != ASIDE - 1]
    leader, squares, weights = (np.zeros((classes, BUCKETS)) for _ in range(3))
    target = np.eye(classes)
    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in order.permutation(len(fit)).tolist():
            (at, value), label = fit[k]
            z, n = leader[:, at], squares[:, at]
            w = np.where(np.abs(z) <= LASSO, 0, -(z - np.sign(z) * LASSO) / ((1 + np.sqrt(n)) / RATE + RIDGE))
            logits = w @ value
            odds = np.exp(logits - logits.max())
            slope = (odds / odds.sum() - target[label])[:, None] * value
            after = n + slope**2
            leader[:, at] = z + slope - (np.sqrt(after) - np.sqrt(n)) / RATE * w
            squares[:, at] = after
    shrunk = np.sign(leader) * np.maximum(np.abs(leader) - LASSO, 0)
    weights = -shrunk / ((1 + np.sqrt(squares)) / RATE + RIDGE)
    scale = np.geomspace(0.05, 20, 60)
    loss = np.zeros(len(scale))
    for (at, value), label in aside:
        for k, temperature in enumerate(scale):
            loss[k] -= np.log(_probabilities(weights, at, value, temperature)[label] + 1e-12)
    if not aside:
        return weights, 1.0
    return weights, float(scale[loss / len(aside) <= loss.min() / len(aside) + TIE].max())


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """Languages, IDF, weights and temperature from the documents with a language that are not held out; None without any.

    What reaches the driver is one number for each bucket, one for each language, and the sample.
    """
    learned = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    per_language = learned.groupBy("lang").count().toArrow()
    if not per_language.num_rows:
        return None
    counts = dict(sorted(zip(per_language.column("lang").to_pylist(), per_language.column("count").to_pylist())))
    frequencies = learned.mapInArrow(_frequencies, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    frequencies = frequencies.toArrow()  # one row for each bucket
    buckets, texts = frequencies.column("bucket").to_numpy(), frequencies.column("texts").to_numpy()
    if not len(buckets):
        return None
    all_texts = int(texts[buckets == -1][0])
    seen = np.zeros(BUCKETS)
    seen[buckets[buckets >= 0]] = texts[buckets >= 0]
    idf = np.log((1 + all_texts) / (1 + seen)) + 1
    languages = list(counts)
    bound = F.lit(0.0)
    for language, count in counts.items():
        each = min(SAMPLE, MOST_SAMPLE / len(counts))
        bound = F.when(F.col("lang") == language, min(1.0, each / count)).otherwise(bound)
    place = F.expr("shiftrightunsigned(xxhash64(doc_id, 5), 32)")
    sample = learned.filter(place < bound * float(2**32)).withColumn("text", pieces("text", MOST_CHARS)).toArrow()
    rows = sorted(zip(*(sample.column(name).to_pylist() for name in ("doc_id", "lang", "text"))))
    weights, temperature = _fit(
        [text for _, _, text in rows], [languages.index(lang) for _, lang, _ in rows], len(languages), idf
    )
    return languages, idf, weights, temperature


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in steps(batches):
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                grams = _grams(text) if model else None
                if grams is None:
                    names.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                languages, idf, weights, temperature = model
                probability = _probabilities(weights, *_vector(grams, idf), temperature)
                best = int(probability.argmax())
                names.append(languages[best])
                scores.append(float(probability[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def languages(docs: DataFrame, model) -> DataFrame:
    """Predict the language of whole texts: doc_id, held_out, lang_pred, score (the calibrated probability).

    Texts that are null or without a letter are `und` with score 0, as is every text if there was nothing to learn from.
    The first of equally likely languages by name is taken. Every row is predicted, null and repeated ids too. Columns
    other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")
