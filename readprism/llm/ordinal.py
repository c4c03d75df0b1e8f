"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered (0 worst). One weight vector over hashed text features gives
a latent score ``s`` and ordered thresholds give ``P(grade <= k) = sigmoid(t_k - s)``.
From that come the expected grade and the tail probability ``P(grade >= top)``,
by which documents are selected.

Features are hashed into ``2**BITS`` slots, each counted once for a document:
its words (lower case, no punctuation), the prefixes of 6, 7 and 8 bytes of
longer words (inflected forms share them), and words for its shape: binned shares
of symbols, capitals, digits, distinct words and repeated neighbours, and the
binned number of words.

The model is fitted on a bounded sample of labelled documents (``sample``, those
of the least hash of their id, among ids that documents have), on the driver, from features extracted by Spark.
Scoring is one pass over all texts; nothing is shuffled.

Defined results: documents without words (null or empty texts too) have grade 0
with certainty. Labels with a null grade, or of documents that don't exist, are
not used; a document with several labels counts with its worst. With no labels,
or labels of one grade only, there is nothing to tell apart: every document with
words gets that grade (the top grade without labels). Repeated rows are scored
one by one. Further columns, whatever their names, are kept by ``select_quality`` and
ignored elsewhere. Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.llm import words as W

_U = np.uint64
BITS = 18
SAMPLE = 12000
GRADES = 3
PREFIXES = (6, 7, 8)
THRESHOLD = 0.5
_SHAPES = ("symbols", "capitals", "digits", "distinct", "repeats", "size")
_EDGES = {
    "symbols": (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5),
    "capitals": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.005, 0.02, 0.05, 0.1, 0.3),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "repeats": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "size": (3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400),
}
_IS = {name: np.array([test(c) for c in range(256)]) for name, test in {
    "symbols": lambda c: c < 128 and not chr(c).isalnum() and chr(c) not in " \t\n\r\x0b\x0c.,",
    "capitals": lambda c: 65 <= c <= 90,
    "digits": lambda c: 48 <= c <= 57,
    "ink": lambda c: chr(c) not in " \t\n\r\x0b\x0c",
}.items()}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, bounds, word counts): each row's distinct feature slots; rows without words have none."""
    columns, bounds = W.plain_word_hashes(texts, PREFIXES)
    hashes, n_words = columns[:, 0], np.diff(bounds)
    data, offsets = W.string_bytes(texts)
    own = data[int(offsets[0]) : int(offsets[-1])]
    ink = np.maximum(_per_row(_IS["ink"][own], offsets), 1)
    slots, slot_bounds = W.distinct((columns >> _U(64 - BITS)).ravel(), bounds * columns.shape[1])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][n_words > 0]] = False
    shape = {name: _per_row(_IS[name][own], offsets) / ink for name in ("symbols", "capitals", "digits")}
    shape["distinct"] = np.diff(slot_bounds) / np.maximum(n_words * columns.shape[1], 1)
    shape["repeats"] = (np.concatenate([[0], np.cumsum(same)])[bounds[1:]] - np.concatenate([[0], np.cumsum(same)])[bounds[:-1]]) / np.maximum(n_words, 1)
    shape["size"] = n_words
    extra = np.stack([np.searchsorted(_EDGES[name], shape[name], side="right") + 32 * i for i, name in enumerate(_SHAPES)], axis=1)
    extra = W.mix(extra.astype(np.uint64) + _U(0x51A9E)) >> _U(64 - BITS)
    full = np.flatnonzero(n_words)
    counts = np.where(n_words > 0, np.diff(slot_bounds) + len(_SHAPES), 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(out_bounds[-1]), np.int64)
    at_extra = (out_bounds[1:][full] - len(_SHAPES))[:, None] + np.arange(len(_SHAPES))
    out[at_extra] = extra[full].astype(np.int64)
    rest = np.ones(len(out), bool)
    rest[at_extra.ravel()] = False
    out[rest] = slots.astype(np.int64)
    return out, out_bounds, n_words


@dataclass
class Model:
    """Weights by slot and ascending thresholds; ``constant`` is set when there was one grade only."""

    weights: np.ndarray
    thresholds: np.ndarray
    constant: int | None = None

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1..top: shape (rows, top)."""
        if self.constant is not None:
            return np.broadcast_to((np.arange(1, len(self.thresholds) + 1) <= self.constant).astype(float), (len(scores), len(self.thresholds)))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit(slots: np.ndarray, bounds: np.ndarray, grades: np.ndarray, *, n_grades: int = GRADES, steps: int = 250, rate: float = 0.05, l1: float = 2e-4, least_share: float = 0.002) -> Model:
    """Fit weights and thresholds by full-batch Adam with soft thresholding (L1).

    Slots of fewer than ``max(3, least_share * rows)`` rows get no weight.
    Thresholds are ``t_1`` and positive gaps, so they stay ordered. The score is
    ``log P(t_{g} < s + noise <= t_{g+1})`` summed over rows.
    """
    n, top = len(grades), n_grades - 1
    weights = np.zeros(1 << BITS)
    found = np.unique(grades)
    if n == 0 or len(found) == 1:
        return Model(weights, np.zeros(top), int(found[0]) if n else top)
    used, inverse, df = np.unique(slots, return_inverse=True, return_counts=True)
    keep = df >= max(3, least_share * n)
    number = np.cumsum(keep) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    some = keep[inverse]
    col, row = number[inverse[some]], rows[some]
    k = int(keep.sum())
    share = np.clip(np.array([(grades < g).mean() for g in range(1, n_grades)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def levels(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    for step in range(1, steps + 1):
        t = np.concatenate([[-np.inf], levels(theta[k:]), [np.inf]])
        s = np.bincount(row, theta[col], n)
        with np.errstate(over="ignore"):
            hi, lo = (1 / (1 + np.exp(-(t[grades + j] - s))) for j in (1, 0))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad_s = (d_hi - d_lo) / n
        grad_t = -(np.bincount(grades, d_hi, n_grades)[:-1] - np.bincount(grades, d_lo, n_grades)[1:]) / n
        back = np.cumsum(grad_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, grad_s[row], k), back[:1], back[1:] * np.exp(theta[k + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps // 4:
            shrink = rate * l1 / (np.sqrt(v[:k] / (1 - 0.999**step)) + 1e-4)
            theta[:k] = np.sign(theta[:k]) * np.maximum(np.abs(theta[:k]) - shrink, 0)
    weights[used[keep]] = theta[:k]
    return Model(weights, levels(theta[k:]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, quality 0/1, toxic 0/1): 0 toxic, 1 poor, 2 good.

    With the worst fault at the bottom, several faults only push a document
    further down, as one latent score needs it.
    """
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    grade = F.when(toxic == 1, 0).when((toxic == 0) & quality.isin(0, 1), 1 + quality)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, *, sample: int = SAMPLE, n_grades: int = GRADES) -> Model:
    """Fit on at most ``sample`` rated ids, of those that documents have.

    They are a table of at most that many rows, so broadcasting them is bounded;
    only feature slots come to the driver. An id that several rows have gives the
    text of the least hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    known = ratings.select(F.col("doc_id").cast("long").alias("id"), "grade").join(texts.select("id"), "id", "left_semi")
    ids = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    rated = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("grade").alias("grade"), one).select("grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            slots, bounds, _ = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), W.list_array(pa.array(slots.astype(np.int32)), bounds)], ["grade", "slots"])

    rows = rated.mapInArrow(extract, "grade int, slots array<int>").toArrow().combine_chunks()
    lists = [rows["slots"][i].values.to_numpy() for i in range(len(rows))]
    sizes = np.array([len(x) for x in lists], np.int64)
    return fit(np.concatenate(lists) if lists else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), rows["grade"].to_numpy().astype(np.int64), n_grades=n_grades)


def _scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Columns c0, c1, ... for ``columns``, then expected_grade and tail, so no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index("text")] if "text" in columns else "text"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in W.slices(batches, text):
            slots, bounds, n_words = features(batch.column(text))
            sums = np.concatenate([[0.0], np.cumsum(model.weights[slots])])
            tails = np.where((n_words > 0)[:, None], model.tails(sums[bounds[1:]] - sums[bounds[:-1]]), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1]))], [*names, "expected_grade", "tail"])

    chosen = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], *([] if "text" in columns else ["text"]))
    ddl = ", ".join(f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in names)
    return chosen.mapInArrow(rate, f"{ddl}, expected_grade double, tail double")


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """(columns..., expected_grade double, tail double): ``tail`` is the probability of the top grade."""
    return _scored(docs, model, list(columns)).toDF(*columns, "expected_grade", "tail")


def select_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose probability of the top grade is at least ``threshold``."""
    model = train(docs, graded(labels), sample=sample)
    kept = _scored(docs, model, docs.columns).where(F.col("tail") >= threshold)
    return kept.drop("expected_grade", "tail").toDF(*docs.columns)
