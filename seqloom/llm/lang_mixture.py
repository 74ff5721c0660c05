"""Language identification by multilingual mixture inference (operator 4).

Each learned language has a smoothed distribution over hashed letter trigrams,
counted over all training texts. A document is a mixture of languages:
expectation-maximisation finds the proportions that make its trigrams likeliest.
The set of languages is chosen by penalised likelihood: starting from the best
single language, the next one is added as long as twice the gain in
log-likelihood exceeds ``penalty * log(number of trigrams)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks

#: Hashed trigrams of a language's table, and languages at most (bounds what is broadcast).
DIM, MAX_LANGUAGES = 1 << 16, 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; other runs count as one space. Empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    x = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for langs, texts in blocks(batches, "lang", "text"):
        for lang, text in zip(langs, texts):
            found = totals.setdefault(lang, np.zeros(DIM, np.int64))
            grams, times = np.unique(trigrams(text), return_counts=True)
            found[grams] += times
    for lang, found in totals.items():
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["lang", "gram", "n"])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: DIM x languages) from all rows with text and language.

    Only DIM counts of each of at most MAX_LANGUAGES languages reach the driver.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((DIM, len(langs)), smoothing)
    found = counts.toPandas()
    table[found["gram"], found["lang"].map({x: i for i, x in enumerate(langs)}).astype(int)] += found["n"]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table


def expectation_maximisation(likely: np.ndarray, times: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a mixture; likely: distinct trigrams x languages, scaled by row; times: how often each comes."""
    share = np.full(likely.shape[1], 1 / likely.shape[1], likely.dtype)
    total = times.sum()
    for _ in range(rounds):
        new = share * ((times / (likely @ share)) @ likely) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(times @ np.log(likely @ share).astype(np.float64))


def infer(grams: np.ndarray, table: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """(languages of the selected set, largest share first, and their shares).

    Works on distinct trigrams, DIM at most, however long the text.
    """
    distinct, times = np.unique(grams, return_counts=True)
    times = times.astype(np.float32)
    logs = table[distinct]
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - top)
    exact = times.astype(np.float64)
    single = exact @ logs
    chosen = [int(single.argmax())]
    share, best = np.ones(1, np.float32), float(single[chosen[0]] - exact @ top[:, 0])
    if len(single) > 1:
        order = [int(i) for i in np.argsort(-expectation_maximisation(likely, times)[0], kind="stable")]
        for lang in (i for i in order if i != chosen[0]):
            new, score = expectation_maximisation(likely[:, [*chosen, lang]], times)
            if 2 * (score - best) <= penalty * np.log(len(grams) + 1):
                break
            chosen, share, best = [*chosen, lang], new, score
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


_FOUND = pa.schema(
    {
        "id": pa.int64(),
        "lang_pred": pa.string(),
        "score": pa.float64(),
        "languages": pa.list_(pa.string()),
        "shares": pa.list_(pa.float64()),
    }
)


def _predict(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for keys, texts in blocks(batches, "id", "text"):
            out = []
            for key, text in zip(keys, texts):
                grams = trigrams(text)
                if not len(grams) or not langs:
                    out.append((key, UNKNOWN, 0.0, [], []))
                    continue
                chosen, share = infer(grams, table, penalty)
                names = [langs[i] for i in chosen]
                out.append((key, names[0], float(min(1.0, share[0])), names, share.astype(float).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, row)) for row in out], _FOUND)

    return run


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 10.0,
) -> DataFrame:
    """(id_col, lang_pred, score, languages, shares), a row per row of ``docs``.

    languages holds the selected set, largest share first, shares their proportions;
    lang_pred is the first and score its share. A null text, one without letters, or
    an empty model gives "und", 0 and empty arrays. Other columns are ignored, so
    their names can't clash; repeated rows are judged each; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIM * MAX_LANGUAGES floats
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(
        _predict(shared, penalty), "id long, lang_pred string, score double, languages array<string>, shares array<double>"
    )
    return found.withColumnRenamed("id", id_col)


def held_out(id_column: Column) -> Column:
    """The quarter of ids that is kept from training: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
