"""Quality score from a regularised quadratic discriminant.

Method. A text becomes a vector of statistics, each transformed towards a bell shape (logarithm of counts,
log-odds of shares). Per class the mean and a shrunken covariance are estimated: a part of the pooled
covariance, and a part of its average variance on the diagonal. The score is the logistic of the difference
of the two log densities, computed as Mahalanobis lengths with Cholesky factors that are kept in the model.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import hash01, over_budget

NAMES = ("words", "word_length", "letters", "capitals", "digits", "symbols", "distinct", "top_word", "stutter", "new_pairs", "closed", "odd_words", "repeated_lines", "line_length")


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, drawn towards one half by one count, so that short texts are no extremes."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of the whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    small = np.bincount(np.minimum(raw, 128), minlength=129)
    lower, upper, digits = small[97:123].sum(), small[65:91].sum(), small[48:58].sum()
    blanks, wide = small[32] + small[9:14].sum(), small[128]
    symbols = size - lower - upper - digits - blanks - wide
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    closed = sum(x.rstrip()[-1] in ".!?:;" for x in lines)
    odd = sum(c for w, c in counts.items() if not w.isalpha() and not w[:-1].isalpha())
    return [
        float(np.log1p(n)), float(np.log1p((size - blanks) / max(1, n))), _odds(lower + upper + wide, size - blanks), _odds(upper, lower + upper + wide),
        _odds(digits, size - blanks), _odds(symbols, size - blanks), _odds(len(counts), n) if n else 0.0, _odds(max(counts.values(), default=0), n),
        _odds(stutter, max(0, n - 1)), _odds(pairs, max(0, n - 1)), _odds(closed, len(lines)), _odds(odd, n), _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
    ]


@dataclass
class Discriminant:
    means: np.ndarray  # (2, d)
    factors: np.ndarray  # (2, d, d): lower Cholesky factors of the covariances
    log_dets: np.ndarray  # (2,)
    prior: float  # log-odds of label 1

    def scores(self, rows: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            white = np.linalg.solve(self.factors[k], (rows - self.means[k]).T)
            density.append(-0.5 * ((white * white).sum(axis=0) + self.log_dets[k]))
        gap = np.clip(density[1] - density[0] + self.prior, -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(rows: np.ndarray, labels: np.ndarray, sizes: tuple[int, int], pooled: float = 0.5, diagonal: float = 0.1) -> Discriminant:
    """Shrinkage estimate; a class without rows takes the moments of all rows, and no rows a unit bell.

    `sizes` are the rows of both classes before any sampling: the prior follows from them.
    """
    d = rows.shape[1] if rows.ndim == 2 else len(NAMES)
    rows = rows.reshape(-1, d)
    groups = [rows[labels == k] for k in (0, 1)]
    total = np.cov(rows.T, bias=True) if len(rows) > 1 else np.eye(d)
    within = sum(len(g) * np.cov(g.T, bias=True) for g in groups if len(g) > 1) / max(1, len(rows)) if any(len(g) > 1 for g in groups) else total
    means, factors, dets = [], [], []
    for g in groups:
        means.append(g.mean(axis=0) if len(g) else rows.mean(axis=0) if len(rows) else np.zeros(d))
        own = np.cov(g.T, bias=True) if len(g) > d else within
        mixed = (1 - pooled) * own + pooled * within
        mixed = (1 - diagonal) * mixed + diagonal * np.eye(d) * max(np.trace(mixed) / d, 1e-3)
        factor = np.linalg.cholesky(mixed)
        factors.append(factor)
        dets.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((sizes[1] + 1) / (sizes[0] + 1))
    return Discriminant(np.array(means), np.array(factors), np.array(dets), float(prior))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, pooled: float = 0.5, diagonal: float = 0.1) -> Discriminant:
    """Fitted on a bounded sample: documents with label 0 or 1, drawn by a hash of their id, about `max_rows` a class.

    A document with more than one label row counts with its smallest label. The prior comes from all labels.
    Statistics are computed in tasks; the driver gets the sample's numbers, `max_rows` rows of a class at most
    in expectation. So long is the list of ids that is broadcast to the texts, which stay where they are.
    """
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    classes = {r["quality"]: r for r in marked.groupBy("quality").agg(F.count("*").alias("n"), over_budget(F.count("*"), max_rows).alias("share")).collect()}
    share, sizes = ([classes[k][c] if k in classes else d for k in (0, 1)] for c, d in (("share", 1.0), ("n", 0)))
    limit = F.when(F.col("quality") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = marked.where(hash01(F.col("doc_id"), F.lit("quality")) < limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "quality"])

    # rows arrive in any order: sorted, so that sums and with them the model are the same in every run
    sample = rows.mapInArrow(run, "x array<double>, quality int").toArrow()
    x = np.asarray(sample.column("x").combine_chunks().flatten()).reshape(-1, len(NAMES))
    y = np.asarray(sample.column("quality"))
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit(x[order], y[order], tuple(sizes), pooled, diagonal)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) per row, from the text alone; null and empty texts get the score of an empty text.

    Each row is read by itself: repeated ids, ties and extra columns change nothing; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = np.array([statistics(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(rows))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
