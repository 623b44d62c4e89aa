"""Quality by Bradley-Terry: a linear score learned from pairs of a better and a worse document, then a threshold at one of its quantiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import sampled, scored, small

#: The score at which a document is predicted to be good.
CUT = 0.7
MEASURES = ("words", "word_chars", "symbols", "upper", "digits", "marks", "pipes", "repeats", "distinct", "line_repeats", "shouts")
N_BINS = 8


def features(text: str | None) -> list[float]:
    """Measures of a whole text, each but the first a share of its words, characters or lines; all 0 for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(MEASURES)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(np.minimum(cp, 256), minlength=257)
    lines = [x for x in text.split("\n") if x]
    upper = n[65:91].sum() + n[192:223].sum() - n[215]
    alpha = upper + n[97:123].sum() + n[223:256].sum() + n[256]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / len(words),
        (n[33] + n[35:39].sum() + n[42:44].sum() + n[60:63].sum() + n[64] + n[91:97].sum() + n[123:127].sum()) / len(cp),
        upper / max(1, alpha),
        n[48:58].sum() / len(cp),
        (n[44] + n[46] + n[58:60].sum() + n[63]) / len(words),
        n[124] / len(words),
        sum(map(eq, words, words[1:])) / len(words),
        # distinct words fall with the length of any text, as its square root about
        len(set(words)) / len(words) ** 0.9,
        1 - len(set(lines)) / max(1, len(lines)),
        n[33] / len(words),
    ]


@dataclass(frozen=True)
class Ranker:
    """edges: bin borders of each measure; weights: of the bins; the score at `threshold` is CUT."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def design(self, rows: np.ndarray) -> np.ndarray:
        return design(rows, self.edges)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; a document that ties the threshold gets CUT itself."""
        utility = self.design(rows) @ self.weights
        z = np.clip(self.slope * (utility - self.threshold) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def design(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A measure's bins as steps: for every border, whether the measure is above it."""
    return (rows[:, :, None] > edges[None, :, :]).reshape(len(rows), -1).astype(np.float64)


def fit_pairs(rows: np.ndarray, good: np.ndarray, pairs: int = 40_000, l2: float = 3.0, seed: int = 5) -> Ranker:
    """Bradley-Terry by Newton steps on the logistic loss of feature differences of (better, worse) pairs.

    The threshold lies midway between the classes' outer quantiles; where these overlap, it is the one
    of all the sample's scores with the best mean of both classes' recalls.
    Without both classes, every document is kept.
    """
    n_measures = len(MEASURES)
    if not len(rows) or good.all() or not good.any():
        return Ranker(np.zeros((n_measures, 1)), np.zeros(n_measures), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    # borders at quantiles of the sample and of the worse documents, which are few
    q = np.linspace(0, 1, N_BINS + 2)[1:-1]
    edges = np.stack([np.concatenate([np.quantile(c, q), np.quantile(c[~good], q)]) for c in rows.T])
    x = design(rows, edges)
    better, worse = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    diff = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (p - 1) + l2 * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = x @ w
    bad_end, good_begin = np.quantile(u[~good], 0.998), np.quantile(u[good], 0.002)
    if bad_end < good_begin:
        threshold = float((bad_end + good_begin) / 2)
    else:
        at = np.unique(u)
        kept, dropped = good.sum() - np.searchsorted(np.sort(u[good]), at), np.searchsorted(np.sort(u[~good]), at)
        threshold = float(at[int(np.argmax(kept / good.sum() + dropped / (~good).sum()))])
    spread = float(np.std(u)) or 1.0
    return Ranker(edges, w, threshold, 3.0 / spread)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row of docs (doc_id, text)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(arrow):
            rows = [features(x.as_py()) for x in batch.column("text")]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} double" for m in MEASURES))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> Ranker:
    """Learn from docs (doc_id, text) and labels (doc_id, quality 0/1), from about sample_rows labelled documents at most.

    Only the sample's measures reach the driver, never texts. The sample's ids and labels are broadcast:
    sample_rows bounds both. Null labels and ids don't count; of repeated labels the larger holds, and of rows that repeat an id
    the text that sorts first; null texts are texts without words; other columns are ignored.
    """
    some = sampled(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    found = measured(rows).toPandas().sort_values("doc_id", key=lambda c: c.map(lambda r: r["doc_id"]), kind="stable")
    good = np.array([r["quality"] == 1 for r in found["doc_id"]], bool)
    return fit_pairs(found[list(MEASURES)].to_numpy(float).reshape(-1, len(MEASURES)), good)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text), in one pass without a shuffle.

    Null and empty texts are scored by their measures, all 0. Repeated rows and null ids are scored row
    by row; other columns are never read. Ties at the threshold are predicted good.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(arrow):
            rows = np.array([features(x.as_py()) for x in batch.column("text")], float).reshape(-1, len(MEASURES))
            s = ranker.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, all columns, predicted good; only texts go to Python.

    Null and empty texts are judged by their measures, all 0; repeated rows and null ids row by row; texts are measured whole, one at a time.
    """

    def begin():
        return lambda texts: ranker.scores(np.array([features(x) for x in texts], float).reshape(-1, len(MEASURES)))

    return docs.where(scored(begin)(docs["text"]) >= CUT)
