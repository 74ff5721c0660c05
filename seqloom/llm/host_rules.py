"""Host-level quality rules with an empirical beta prior (operator 6).

Everything is a DataFrame expression. Base measures come from one pass over each
text within its row, so that very long texts and hot hosts need no grouping of
words. Failures are then aggregated by host (map-side first), the beta prior is
fitted to all hosts by the method of moments, each host's rate is shrunk to it,
and verdicts of hosts are joined back to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, stored

#: Words in a window that may not come twice.
WINDOW = 8


def _shifted(values: Column, by: int) -> tuple[Column, Column]:
    """The array without its last and without its first ``by`` entries."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.slice(values, 1, n), F.slice(values, 1 + by, n)


def _with_measures(docs: DataFrame) -> DataFrame:
    pair = lambda a, b: F.xxhash64(a, b)
    out = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    out = out.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for by, name in ((1, "h2"), (2, "h4"), (4, "h8")):  # hashes of 2, 4 and 8 words in a row
        prior = {"h2": "h", "h4": "h2", "h8": "h4"}[name]
        out = out.withColumn(name, F.zip_with(*_shifted(F.col(prior), by), pair))
    out = out.withColumn("repeated", F.size(F.array_distinct("h8")) < F.size("h8"))
    # windows with their places, sorted by hash: equal neighbours come twice or more
    out = out.withColumn(
        "sorted",
        F.when(
            F.col("repeated"),
            F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.filter(
        F.zip_with(*_shifted(F.col("sorted"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull(),
    )
    # starts of these windows, in order: each covers what the one before it doesn't
    out = out.withColumn("starts", F.when(F.col("repeated"), F.sort_array(F.array_distinct(F.flatten(twice)))))
    covered = F.aggregate(
        F.zip_with(*_shifted(F.col("starts"), 1), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(WINDOW),
        lambda s, x: s + x,
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n_lines = lambda a: F.size(a)
    return out.select(
        "id",
        "host",
        zero(F.when(F.col("words").isNotNull(), F.size("words"))).alias("n_words"),
        zero(F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        zero(F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        zero(F.when(F.col("text").isNotNull(), n_lines(lines) - n_lines(F.array_distinct(lines)))).alias("n_dup_lines"),
        zero(F.when(F.col("repeated"), covered)).alias("n_repeat_words"),
    )


def host_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """Measures and verdicts, a row per row of ``docs``.

    Columns: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, kept. A row fails if it has under ``min_words`` words or
    over ``max_repeat_percent`` percent of them in repeated windows. ``host_rate`` is
    the posterior mean of the host's failure rate under a beta prior fitted to all
    hosts; every row of a host whose rate is above ``max_host_rate`` is rejected too.

    A null text has no words (and fails); a null host is no host (rate null, judged
    by itself alone); repeated rows count as often as they come. Other columns are
    ignored, so their names can't clash; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    # compressed, as the id may be a struct of all columns of a row
    measured = stored(_with_measures(rows).withColumn("base_failed", failed), "rules-measured")
    hosts = (
        measured.filter("host is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    )
    verdicts = shrunk_rates(hosts)
    joined = measured.join(verdicts.select("host", "host_rate"), "host", "left")
    host_ok = F.coalesce(F.col("host_rate") <= max_host_rate, F.lit(True))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "host_rate",
        (~F.col("base_failed") & host_ok).alias("kept"),
    )


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """(host, n, k, host_rate): k of n failures shrunk to a beta prior of all hosts.

    The prior's mean m and variance come from the hosts' raw rates; its weight
    a + b = m (1 - m) / variance - 1 is held within 1 and 1000, where a variance of
    nought (one host, or equal rates) means 1000.
    """
    p = F.col("k") / F.col("n")
    m, v = F.avg(p), F.var_pop(p)
    weight = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    prior = hosts.agg(F.struct(m.alias("m"), weight.alias("w")).alias("prior"))
    out = hosts.withColumn("prior", prior.scalar())
    rate = (F.col("k") + F.col("prior.m") * F.col("prior.w")) / (F.col("n") + F.col("prior.w"))
    return out.select("host", "n", "k", rate.alias("host_rate"))
