"""Quality by ordinal cumulative-link regression on graded ratings (operator 2).

P(grade <= k) = logistic(threshold_k - w.x) with ordered thresholds and one shared
weight vector over hashed text features. x marks the presence of hashed
words, and of word shapes and repetitions by how often they come. Features found
in fewer than ``min_df`` training texts are left out.

Training rows are a bounded sample of the labelled rows (``max_rows``, the least by
a hash of their ids). Their features stay in a table of the shared folder; each
step of L-BFGS runs over its partitions and only sums of gradients come back.
Scoring is one pass over each text, without a shuffle.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks, stored

#: Hashed features; bounds what is sent to tasks and summed on the driver.
DIM = 1 << 17
_MASK = DIM - 1
_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def _shape(word: str, core: str) -> str:
    case = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "m" if core else "-"
    return case + word[len(word.rstrip(_PUNCTUATION)) :][:3]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a text; empty for null and empty texts."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32)
    distinct = Counter(words)
    names, shapes = set(), Counter()
    for word, n in distinct.items():
        core = word.strip(_PUNCTUATION)
        names.add("w:" + core.lower())
        shapes[_shape(word, core)] += n
    for shape, n in shapes.items():
        names.add(f"s:{shape}:{round(np.log2(n / len(words)))}")
    again = sum(a == b for a, b in zip(words, words[1:]))
    names.add(f"r:{round(np.log2((again + 0.5) / len(words)))}")
    names.add(f"d:{round(8 * len(distinct) / len(words))}")
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) & _MASK for x in names), np.int32, len(names)))


@dataclass(frozen=True)
class Model:
    """weights[DIM] and ordered thresholds (grades - 1)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        s = self.weights[found].sum(dtype=np.float64)
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -500, 500)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for grades, texts in blocks(batches, "grade", "text"):
        found = pa.array([features(t) for t in texts], pa.list_(pa.int32()))
        yield pa.record_batch([pa.array(grades, pa.int32()), found], ["grade", "found"])


def _loss(params: np.ndarray, n_grades: int):
    """Sums over a partition: rows, loss, gradient by [weights, thresholds]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, cuts = params[:DIM], np.concatenate([[-np.inf], params[DIM:], [np.inf]])
        rows, loss, slope = 0, 0.0, np.zeros(DIM + n_grades - 1)
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["found"].map(len).to_numpy()
            flat = np.concatenate(batch["found"].to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), sizes)
            score = np.bincount(owner, weights[flat], len(batch))
            grade = batch["grade"].to_numpy().astype(int)
            upper = 1 / (1 + np.exp(np.clip(score - cuts[grade + 1], -500, 500)))
            lower = 1 / (1 + np.exp(np.clip(score - cuts[grade], -500, 500)))
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            loss -= np.log(p).sum()
            slope[:DIM] += np.bincount(flat, (du - dl)[owner], DIM)
            for k in range(n_grades - 1):
                slope[DIM + k] += dl[grade == k + 1].sum() - du[grade == k].sum()
            rows += len(batch)
        yield pd.DataFrame({"rows": [rows], "loss": [loss], "slope": [slope.astype("<f4").tobytes()]})

    return run


def lbfgs(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimise by L-BFGS with halving steps; ``evaluate`` gives value and gradient."""
    value, slope = evaluate(x)
    pairs: deque = deque(maxlen=memory)
    while rounds > 0:
        q, alphas = slope.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - y @ q / (y @ s)) * s
        step = 1.0
        while rounds > 0:
            rounds -= 1
            new, new_slope = evaluate(x - step * q)
            if new <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            return x
        s, y = -step * q, new_slope - slope
        if s @ y > 1e-10:
            pairs.append((s, y))
        done = value - new < 1e-5 * abs(value)
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def train(
    docs: DataFrame,
    grades: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_grades: int = 3,
    max_rows: int = 20_000,
    min_df: int = 8,
    ridge: float = 3e-4,
    rounds: int = 30,
    partitions: int | None = None,
) -> Model:
    """Fit on at most ``max_rows`` graded rows: ``grades`` has (id_col, grade from 0 to n_grades - 1).

    Rows with a null id or grade are left out; an id that is graded twice counts twice,
    one that has several texts is learned from the least of them.
    Without any graded text all weights are 0 and thresholds are evenly spaced.
    """
    # the sample is bounded, and so is what its parts send back in a step
    partitions = partitions or min(64, docs.sparkSession.sparkContext.defaultParallelism)
    sample = (
        grades.select(F.col(id_col).cast("long").alias("id"), F.col("grade").cast("int").alias("grade"))
        .dropna()
        .orderBy(F.xxhash64("id"), "id", "grade")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample.groupBy("id", "grade").agg(F.count("*").alias("times"))), "id")
    rows = rows.groupBy("id", "grade", "times").agg(F.min("text").alias("text"))
    rows = rows.select("grade", "text", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("grade", "text")
    rows = rows.repartition(partitions)
    data = stored(rows.mapInArrow(_featured, "grade int, found array<int>"), "graded")
    df = data.select(F.explode("found").alias("f")).groupBy("f").count().filter(F.col("count") >= min_df).select("f").toPandas()
    used = np.zeros(DIM + n_grades - 1)
    used[df["f"].to_numpy(dtype=int)] = 1
    used[DIM:] = 1
    decay = np.full(DIM + n_grades - 1, ridge)
    decay[DIM:] = 0
    start = np.zeros(DIM + n_grades - 1)
    start[DIM:] = np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else 0

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        if (np.diff(x[DIM:]) <= 0).any():
            return np.inf, x
        parts = data.mapInPandas(_loss(x, n_grades), "rows long, loss double, slope binary").collect()
        n = sum(p.rows for p in parts)
        slope = sum((np.frombuffer(p.slope, "<f4") for p in parts), np.zeros(len(x)))
        value = sum(p.loss for p in parts) / max(n, 1) + (decay * x * x).sum() / 2
        return value, used * (slope / max(n, 1) + decay * x)

    best = lbfgs(evaluate, start, rounds)
    return Model(best[:DIM].astype(np.float32), best[DIM:])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for keys, texts in blocks(batches, "id", "text"):
            tails = np.array([fitted.tails(features(t)) for t in texts])
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])],
                ["id", "expected_grade", "top_tail"],
            )

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", min_tail: float = 0.5) -> DataFrame:
    """(id_col, expected_grade, top_tail, kept), a row per row of ``docs``.

    top_tail is the probability of the best grade; kept means that it is ``min_tail`` at
    least. Null and empty texts have no features: they get the scores of the
    thresholds alone. Other columns are ignored, so their names can't clash;
    repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_score(shared), "id long, expected_grade double, top_tail double")
    return found.select(F.col("id").alias(id_col), "expected_grade", "top_tail", (F.col("top_tail") >= min_tail).alias("kept"))


def _filtered(model, text_col: str, min_tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in batches:
            at = 0
            for (texts,) in blocks([batch], text_col):
                kept = [bool(fitted.tails(features(t))[-1] >= min_tail) for t in texts]
                yield batch.slice(at, len(texts)).filter(pa.array(kept, pa.bool_()))
                at += len(texts)

    return run


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", min_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that score() keeps, in one pass: no row is numbered, stored or joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filtered(shared, text_col, min_tail), docs.schema)


def grades_of(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Graded ratings: 0 toxic, 1 poor, 2 good; null if the labels don't tell."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(id_col), grade.alias("grade"))
