"""Toxicity by averaged subword embeddings and a linear softmax (operator 13).

A word's vector is the mean of the embeddings of its character n-grams (its ends
marked, hashed into BUCKETS rows), a text's the mean of its words' vectors; a softmax over
it gives the probability of label 1. Misspellings share most n-grams with the
word that they stand for. A word that comes c times in a text counts sqrt(c), and PAD empty words
are added, so that repetitions and very short texts don't swing the mean.

Embeddings and softmax are trained together by stochastic gradients (AdaGrad) in
numpy: in every round each part of a bounded sample goes on from the shared parameters, and what
the parts changed is averaged over those that changed it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, stored

BITS = 18
#: Rows of the embedding table; with DIM it bounds what is sent to tasks and back.
BUCKETS = 1 << BITS
DIM = 4
#: Lengths of n-grams.
SHORTEST, LONGEST = 3, 6
PAD = 20.0
#: What the empty text of a step counts.
EMPTY = 0.2
#: Words whose scores a task keeps.
CACHED = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of a row are kept from training; false without an id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and for each the place of its word.

    Memory grows with the characters of ``words``; callers hand over a few at a time.
    """
    marked = ["<" + w.strip(_PUNCTUATION) + ">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(codes))
    found, of = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        mixed = (mixed[:k] ^ codes[n - 1 :]) * _MIX
        mixed ^= mixed >> np.uint64(29)
        if n >= SHORTEST:
            inside = left[:k] >= n
            found.append(((mixed[inside] * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
            of.append(owner[:k][inside])
    return np.concatenate(found), np.concatenate(of)


def _batches(words: list[str], most: int = 8192) -> Iterator[list[str]]:
    rest = iter(words)
    while batch := list(islice(rest, most)):
        yield batch


def words_of(text: str | None) -> Counter:
    return Counter(text.lower().split()) if text else Counter()


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with their shares of its mean; empty for a text without words."""
    counts = words_of(text)
    shares = np.zeros(BUCKETS)
    total = PAD
    for words in _batches(list(counts)):
        found, of = ngrams(words)
        per = np.bincount(of, minlength=len(words))
        weight = np.sqrt([counts[w] for w in words]) * (per > 0)
        total += weight.sum()
        shares += np.bincount(found, (weight / np.maximum(per, 1))[of], BUCKETS)
    at = np.flatnonzero(shares).astype(np.int32)
    return at, (shares[at] / total).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """embeddings[BUCKETS, DIM], softmax weights[DIM, 2] and biases[2]."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def contrast(self) -> np.ndarray:
        """What each bucket adds to the log-odds of label 1."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A part of the sample as one row of flat arrays, in order of ids."""
    rows = rows.sort_values(["id", "toxic"])
    bags = [bag(t) for t in rows["text"]]
    flat = lambda i, kind: np.concatenate([b[i] for b in bags]).astype(kind).tobytes()
    return pd.DataFrame(
        {
            "part": [rows["part"].iloc[0]],
            "labels": [rows["toxic"].to_numpy("<i4").tobytes()],
            "sizes": [np.array([len(b[0]) for b in bags], "<i4").tobytes()],
            "buckets": [flat(0, "<i4")],
            "shares": [flat(1, "<f4")],
        }
    )


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of a part have each bucket."""
    for batch in batches:
        for raw in batch["buckets"]:
            df = np.bincount(np.frombuffer(raw, "<i4"), minlength=BUCKETS)
            yield pd.DataFrame({"df": [df.astype("<i4").tobytes()]})


def _trained(part, model: Model, used: np.ndarray, rate: float, seed: int, positive: float, steps: int, size: int = 32):
    """The model after some steps over a part's rows, in ever new orders, and which buckets they changed."""
    labels, sizes = np.frombuffer(part.labels, "<i4"), np.frombuffer(part.sizes, "<i4")
    buckets, shares = np.frombuffer(part.buckets, "<i4"), np.frombuffer(part.shares, "<f4")
    stops = np.cumsum(sizes)
    starts = stops - sizes
    table, weights, bias = model.embeddings.copy(), model.weights.copy(), model.bias.copy()
    seen, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full(weights.shape, 1e-8), np.full(2, 1e-8)
    changed = np.zeros(BUCKETS, bool)
    draw = np.random.default_rng(seed)
    order = np.concatenate([draw.permutation(len(labels)) for _ in range(-(-steps * size // len(labels)))])
    for rows in [order[i * size : (i + 1) * size] for i in range(steps)]:
        at = np.concatenate([buckets[starts[r] : stops[r]] for r in rows])
        share = np.concatenate([shares[starts[r] : stops[r]] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        held = used[at]
        at, share, owner = at[held], share[held], owner[held]
        label = np.append(labels[rows], 0)  # a text without words, last, is of label 0
        mean = np.stack([np.bincount(owner, table[at, k] * share, len(label)) for k in range(DIM)], 1)
        z = mean @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        p *= np.where(label == 1, positive, 1.0)[:, None] / len(rows)
        p[-1] *= EMPTY
        back = p @ weights.T
        some, place = np.unique(at, return_inverse=True)
        slope = np.stack([np.bincount(place, back[owner, k] * share, len(some)) for k in range(DIM)], 1)
        slope_w, slope_b = mean.T @ p, p.sum(axis=0)
        seen[some] += (slope**2).mean(axis=1)
        seen_w += slope_w**2
        seen_b += slope_b**2
        table[some] -= rate * slope / np.sqrt(seen[some])[:, None]
        weights -= rate * slope_w / np.sqrt(seen_w)
        bias -= rate * slope_b / np.sqrt(seen_b)
        changed[some] = True
    return Model(table, weights, bias), changed


def _round(shared, used, rate: float, seed: int, positive: float, steps: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                new, changed = _trained(part, shared.value, used.value, rate, seed + int(part.part), positive, steps)
                yield pd.DataFrame(
                    {
                        "at": [np.flatnonzero(changed).astype("<i4").tobytes()],
                        "rows": [new.embeddings[changed].astype("<f4").tobytes()],
                        "softmax": [np.concatenate([new.weights.ravel(), new.bias]).astype("<f8").tobytes()],
                    }
                )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 8_000,
    parts: int = 8,
    min_df: int = 20,
    rounds: int = 12,
    steps: int = 30,
    rate: float = 1.0,
    positive: float = 2.5,
    seed: int = 7,
) -> Model:
    """Fit on a bounded sample of the labelled rows: at most ``max_rows``, a quarter of them of label 1.

    Of each label the rows with the least hash of their id are taken. Held-out ids, null
    ids and labels other than 0 and 1 are left out; an id labelled twice has its
    greater label, one with several texts is learned from the least of them. Buckets found in fewer
    than ``min_df`` sample texts stay 0. In each round a part takes ``steps`` steps of 32 rows and
    an empty text of label 0. Rows of label 1 count ``positive`` times. Without any
    labelled text every score is 0.5.
    """
    session = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    least = lambda label, n: marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = least(1, max_rows // 4).unionByName(least(0, max_rows - max_rows // 4))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int"))
    schema = "part int, labels binary, sizes binary, buckets binary, shares binary"
    dealt = rows.repartition(4 * parts, "part")  # few parts meet in a task
    data = stored(dealt.groupBy("part").applyInPandas(_packed, schema), "toxic-sample")
    df = sum(
        (np.frombuffer(r.df, "<i4").astype(np.int64) for r in data.mapInPandas(_frequencies, "df binary").collect()),
        np.zeros(BUCKETS, np.int64),
    )
    keep = df >= min_df
    draw = np.random.default_rng(seed)
    table = (draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)) * keep[:, None]).astype(np.float32)
    model = Model(table, np.zeros((DIM, 2)), np.zeros(2))
    used = session.sparkContext.broadcast(keep)
    for number in range(rounds):
        shared = session.sparkContext.broadcast(model)
        found = data.mapInPandas(
            _round(shared, used, rate, seed + 1000 * number, positive, steps), "at binary, rows binary, softmax binary"
        )
        model = _averaged(model, found.collect())
        shared.destroy()
    return model


def _averaged(model: Model, parts: list) -> Model:
    """The mean of the parts' models: of each bucket over those that changed it."""
    n = np.zeros(BUCKETS)
    sums = np.zeros((BUCKETS, DIM))
    softmax = []
    for part in parts:
        at = np.frombuffer(part.at, "<i4")
        n[at] += 1
        sums[at] += np.frombuffer(part.rows, "<f4").reshape(-1, DIM)
        softmax.append(np.frombuffer(part.softmax, "<f8"))
    if not softmax:
        return model
    mean = np.mean(softmax, axis=0)
    table = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], model.embeddings).astype(np.float32)
    return Model(table, mean[: 2 * DIM].reshape(DIM, 2), mean[2 * DIM :])


def text_scores(texts: list[str | None], contrast: np.ndarray, bias: float, cache: dict[str, float]) -> list[float]:
    """Probabilities of label 1; ``cache`` keeps words' means, nan for words without n-grams."""
    if len(cache) > CACHED:
        cache.clear()
    out = []
    for text in texts:
        counts = words_of(text)
        for words in _batches([w for w in counts if w not in cache]):
            found, of = ngrams(words)
            per = np.bincount(of, minlength=len(words))
            with np.errstate(invalid="ignore"):
                cache.update(zip(words, (np.bincount(of, contrast[found], len(words)) / per).tolist()))
        values = np.fromiter((cache[w] for w in counts), np.float64, len(counts))
        weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))) * ~np.isnan(values)
        z = bias + (weight * np.nan_to_num(values)).sum() / (PAD + weight.sum())
        out.append(float(1 / (1 + np.exp(np.clip(-z, -500, 500)))))
    return out


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contrast, bias = shared.value
        cache: dict[str, float] = {}
        for keys, texts in blocks(batches, "id", "text"):
            scores = text_scores(texts, contrast, bias, cache)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted), a row per row of ``docs``; predicted is 1 from ``least`` on.

    Texts are read whole. Null texts, empty ones and those without a letter or digit have no
    n-grams and get the score of the biases alone. Other columns are ignored, so their
    names can't clash; repeated rows are scored each; an empty table gives an empty result.
    """
    known = (model.contrast().astype(np.float32), float(model.bias[1] - model.bias[0]))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # BUCKETS floats
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scored(shared), "id long, score double")
    return found.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
