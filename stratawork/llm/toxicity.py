"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given for documents only, so tokens are labelled first: a feature (a word, a prefix or a suffix) that occurs
in toxic documents and hardly ever in others is a cue, and the tokens of toxic documents that carry a cue are toxic. The
field is trained on sentences of these tokens. Marginals of the forward-backward recursion mark the spans; their largest
and their sum, calibrated on the documents' labels, give the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import held_out, pieces, steps

#: The field is fitted on about so many toxic and other documents, drawn by a hash of their ids; of longer
#: texts it sees MOST_CHARS, in pieces from all over them.
SAMPLE = {1: 1500, 0: 3500}
MOST_CHARS = 10_000
#: Sentences in the fit: all that hold a toxic token, and others up to this number.
SENTENCES = 40_000
#: Every so many-th document of the sample is kept from the field and calibrates the scores.
ASIDE = 4
#: Longer sentences are cut for the fit, not for the scores.
PIECE = 64
#: Words whose potentials a worker keeps; the table is emptied when it is full.
CACHED_WORDS = 300_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")


class Field(NamedTuple):
    """Weights of the toxic state by feature, log factors of the transitions from and to each state, and the calibration."""

    weights: dict[str, float]
    moves: np.ndarray
    calibration: np.ndarray


def _features(word: str) -> tuple[str, ...]:
    return ("", word, "<" + word[:3], "<" + word[:4], "<" + word[:5], word[-3:] + ">", word[-4:] + ">")


def _chains(ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of every sentence, longest first; tokens are those that don't end one."""
    kept = np.flatnonzero(~ends)
    if not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(kept), bool)
    new[1:] = (np.diff(kept) > 1) | (doc[kept[1:]] != doc[kept[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(kept)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def _pieces(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences for the fit, cut into pieces of PIECE tokens at most, longest first."""
    number = -(-length // PIECE)
    place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    first, left = np.repeat(first, number) + place * PIECE, np.repeat(length, number) - place * PIECE
    length = np.minimum(left, PIECE)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def _marginals(score: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability of the toxic state of every token, by forward and backward passes over all sentences at once.

    Step t handles the sentences that are longer than t, which come first. With `pairs` also the expected number of each
    transition.
    """
    trans, odds = np.exp(moves), np.exp(np.clip(score, -30, 30))
    n = len(score)
    ahead, back = np.zeros((2, n)), np.ones((2, n))
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = first[: active[t]] + t
        if t:
            a, b = ahead[0, at - 1], ahead[1, at - 1]
            clean, toxic = a * trans[0, 0] + b * trans[1, 0], (a * trans[0, 1] + b * trans[1, 1]) * odds[at]
        else:
            clean, toxic = np.ones(len(at)), odds[at]
        total = clean + toxic
        ahead[0, at], ahead[1, at] = clean / total, toxic / total
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        a, b = back[0, at + 1], back[1, at + 1] * odds[at + 1]
        clean, toxic = trans[0, 0] * a + trans[0, 1] * b, trans[1, 0] * a + trans[1, 1] * b
        total = clean + toxic
        back[0, at], back[1, at] = clean / total, toxic / total
    clean, toxic = ahead[0] * back[0], ahead[1] * back[1]
    marginal = toxic / (clean + toxic)
    if not pairs:
        return marginal
    inner = np.ones(n, bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    joint = np.empty((2, 2, len(to)))
    for i in range(2):
        for j in range(2):
            joint[i, j] = ahead[i, to - 1] * trans[i, j] * back[j, to] * (odds[to] if j else 1)
    return marginal, (joint / joint.sum((0, 1))).sum(2)


def _cues(docs: list[np.ndarray], labels: np.ndarray, vocabulary: list[str]) -> set[str]:
    """Features that tell toxic documents from others: nearly all documents that hold them are toxic, and not by chance.

    Near copies mostly share the smallest hash of four words; what they hold counts once. Features of toxic documents are
    counted first, and only those that are frequent enough in the others, so no table of all features is kept.
    """
    once: dict[tuple[int, int], int] = {}
    for k, (words, label) in enumerate(zip(docs, labels.tolist())):
        four = (words[i : i + 4].tobytes() for i in range(max(1, len(words) - 3)))
        once.setdefault((label, min(map(crc32, four))), k)
    kept = sorted(once.values())
    toxic = max(1, int(labels[kept].sum()))
    base = toxic / len(kept)

    def held(k: int) -> set[str]:
        words = (vocabulary[w] for w in np.unique(docs[k]).tolist())
        return {f for word in words if word[0] not in _ENDS for f in _features(word)[1:5]}

    in_toxic = Counter(f for k in kept if labels[k] for f in held(k))
    cues: set[str] = set()
    for bar in (14, 9):
        least = max(2, bar / math.log(1 / base))
        often = {f for f, n in in_toxic.items() if n >= least}
        in_clean = Counter(f for k in kept if not labels[k] for f in held(k) & often)
        cues = {f for f in often if in_toxic[f] >= 0.95 * (in_toxic[f] + in_clean[f])}
        if sum(not cues.isdisjoint(held(k)) for k in kept if labels[k]) >= 0.4 * toxic:
            break
    return cues


def fit_field(texts: list[str], labels: list[int], prior: float) -> Field | None:
    """Fit the field on documents and the calibration for a share `prior` of toxic documents; None without both labels."""
    once = dict(zip(texts, labels))
    texts, labels = list(once), np.array(list(once.values()))
    if not len(labels) or labels.min() == labels.max():
        return None
    aside = np.arange(len(labels)) % ASIDE == ASIDE - 1
    if labels[aside].min(initial=1) == labels[aside].max(initial=0) or labels[~aside].min() == labels[~aside].max():
        aside = np.zeros(len(labels), bool)
    judged = [text for text, a in zip(texts, aside) if a] or texts
    judged_labels = labels[aside] if aside.any() else labels
    texts, labels = [text for text, a in zip(texts, aside) if not a], labels[~aside]
    index: dict[str, int] = {}
    docs = [
        np.fromiter((index.setdefault(w, len(index)) for w in _TOKEN.findall(text.lower())), np.int32) for text in texts
    ]
    vocabulary = list(index)
    index.clear()
    cues = _cues(docs, labels, vocabulary)
    ends_word = np.array([w[0] in _ENDS for w in vocabulary], bool)
    cue_word = np.array([not e and not cues.isdisjoint(_features(w)) for w, e in zip(vocabulary, ends_word)], bool)
    word_of, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    ends = ends_word[word_of]
    first, length = _pieces(*_chains(ends, doc))
    words, owner = word_of[~ends], doc[~ends]
    truth = cue_word[words] & (labels[owner] == 1)
    toxic_before = np.concatenate([[0], np.cumsum(truth)])
    chosen = toxic_before[first + length] > toxic_before[first]
    others = np.flatnonzero(~chosen)
    others = np.random.default_rng(5).permutation(others)[:SENTENCES]
    pick = np.sort(np.concatenate([np.flatnonzero(chosen), others]))
    size = length[pick]
    start = np.cumsum(size) - size
    at = np.repeat(first[pick] - start, size) + np.arange(int(size.sum()))
    y = truth[at].astype(float)
    used, local = np.unique(words[at], return_inverse=True)
    names = Counter(f for w in used for f in _features(vocabulary[w]))
    ids = {f: i for i, f in enumerate(names)}
    of_word = np.array([[ids[f] for f in _features(vocabulary[w])] for w in used])
    weights, moves = np.zeros(len(ids)), np.zeros((2, 2))
    weights[ids[""]] = -4.0
    observed = np.zeros((2, 2))
    inner = np.ones(len(at), bool)
    inner[start] = False
    to = np.flatnonzero(inner)
    np.add.at(observed, (y[to - 1].astype(int), y[to].astype(int)), 1)
    steps_w, steps_m = np.full(len(ids), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(80):
        score = weights[of_word].sum(1)[local]
        marginal, expected = _marginals(score, start, size, moves, pairs=True)
        by_word = np.bincount(local, y - marginal, len(used))
        slope = np.zeros(len(ids))
        np.add.at(slope, of_word, by_word[:, None])
        slope -= 0.05 * weights
        slope_m = observed - expected - 0.05 * moves
        slope_m[0, 0] = 0
        steps_w += slope**2
        steps_m += slope_m**2
        weights += 0.6 * slope / np.sqrt(steps_w)
        moves += 0.6 * slope_m / np.sqrt(steps_m)
    field = Field({f: float(weights[i]) for f, i in ids.items()}, moves, np.zeros(3))
    evidence = _evidence(field)
    facts = np.concatenate([evidence(judged[k : k + 500])[0] for k in range(0, len(judged), 500)])
    labels = judged_labels
    share = labels.mean()
    importance = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    calibration = np.array([math.log(prior / (1 - prior)), 0.0, 0.0])
    rows = np.column_stack([np.ones(len(facts)), facts])
    ridge = np.diag([1e-4, 1e-3, 1e-3]) * len(rows)
    
    def loss(c: np.ndarray) -> float:
        odds = rows @ c
        return float(importance @ (np.logaddexp(0, odds) - labels * odds) + c @ ridge @ c / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-rows @ calibration))
        slope = rows.T @ (importance * (labels - p)) - ridge @ calibration
        bend = (rows * (importance * p * (1 - p))[:, None]).T @ rows + ridge
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(calibration + size * step) > loss(calibration):
            size /= 2
        calibration = calibration + size * step
    return field._replace(calibration=calibration)


class _Potentials(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        value = math.nan if word[0] in _ENDS else sum(get(f, 0.0) for f in _features(word))
        self[word] = value
        return value


def _evidence(field: Field):
    """A function from texts to, for each, its largest marginal's log odds and the log of their sum; the token marginals; owners."""
    potentials = _Potentials(field.weights)

    def run(texts: list[str]):
        if len(potentials) > CACHED_WORDS:
            potentials.clear()
        tokens = [_TOKEN.findall(text.lower()) for text in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        score = np.fromiter((potentials[w] for t in tokens for w in t), float, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        ends = np.isnan(score)
        first, length = _chains(ends, doc)
        marginal = np.zeros(len(score))
        if len(first):
            marginal[~ends] = _marginals(score[~ends], first, length, field.moves)
        largest, total = np.zeros(len(texts)), np.bincount(doc, marginal, len(texts))
        np.maximum.at(largest, doc, marginal)
        largest = np.clip(largest, 1e-6, 1 - 1e-6)
        return np.column_stack([np.log(largest / (1 - largest)) / 5, np.log1p(total)]), marginal, sizes

    return run


def _spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Character positions of runs of toxic tokens."""
    found: list[dict] = []
    previous = -2
    for k, token in enumerate(_TOKEN.finditer(text.lower())):
        if marginal[k] >= 0.5:
            if previous == k - 1:
                found[-1]["end"] = token.end()
            else:
                found.append({"start": token.start(), "end": token.end()})
            previous = k
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value) if shared.value else None
        evidence = _evidence(field) if field else None
        for batch in steps(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            if evidence:
                facts, marginal, sizes = evidence(texts)
                score = 1 / (1 + np.exp(-(field.calibration[0] + facts @ field.calibration[1:])))
                bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                spans = [
                    _spans(text, own) if (own := marginal[a:b]).max(initial=0) >= 0.5 else []
                    for text, a, b in zip(texts, bounds[:-1], bounds[1:])
                ]
            else:
                score, spans = np.zeros(len(texts)), [[] for _ in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.3).astype(np.int32)),
                 pa.array(spans, _SPANS), batch.column("text_hash")],
                ["doc_id", "held_out", "score", "predicted", "spans", "text_hash"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Fit on a bounded sample of the labelled documents that are not held out; None if one of the two labels is missing."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")
    ).filter(~held_out())
    counts = {int(row.toxic > 0): row["count"] for row in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if len(counts) < 2:
        return None
    place = F.expr("shiftrightunsigned(xxhash64(doc_id, 3), 32)")
    bound = F.when(F.col("toxic") > 0, min(1.0, SAMPLE[1] / counts[1])).otherwise(min(1.0, SAMPLE[0] / counts[0]))
    sample = known.filter(place < bound * float(2**32)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("long"), pieces("text", MOST_CHARS).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id").toArrow()  # about 7500 ids at most
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts, toxic = rows.column("text").to_pylist(), rows.column("toxic").to_pylist()
    return fit_field([texts[i] for i in order], [toxic[i] for i in order], counts[1] / (counts[0] + counts[1]))


def scores(docs: DataFrame, field: Field | None) -> DataFrame:
    """Score whole texts: doc_id, held_out, score, predicted (score of 0.3 or more), spans (start, end), text_hash.

    Spans are character positions of runs of tokens that are more likely toxic than not. Null and empty texts get the
    score of a text without evidence. Without a field (no rows of one label to learn from) every score is 0. Every row
    is scored, null and repeated ids too. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(field) if field else None)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).withColumn("held_out", held_out())
    spans = "spans array<struct<start: int, end: int>>"
    return rows.mapInArrow(
        _scorer(shared), f"doc_id long, held_out boolean, score double, predicted int, {spans}, text_hash long"
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    field = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(field) if field else None)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for batch in steps(batches):
            none = pa.nulls(batch.num_rows)
            asked = pa.RecordBatch.from_arrays([none, none, batch.column("text"), none], ["doc_id", "held_out", "text", "text_hash"])
            for result in score(iter([asked])):
                yield batch.filter(pc.equal(result.column("predicted"), 0))

    return docs.mapInArrow(keep, docs.schema)
