"""Scratch storage: the cluster's shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts, where they are dealt by how many there are.
ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local folder is made and set if all runs on one machine (tests);
    on a cluster each executor would write to its own disk: an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "seqloom.scratch.dir", None
    )
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("seqloom.scratch.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as compressed Parquet below the shared checkpoint folder and read back.

    For intermediate tables too wide for checkpoint(), whose rows aren't compressed.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows by keys in as many partitions as ``n`` rows need, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(math.ceil(n / ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def in_small_groups(df: DataFrame, keys: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``run`` over the rows of each group of equal keys (not null), for very many small groups.

    Rows (tuples in the order of ``df``) stream through sorted partitions, so that only a
    batch and one group are held.
    """
    at = [df.columns.index(k) for k in keys]
    names = [field.split()[0].strip("`") for field in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        made: list[tuple] = []
        for _, group in groupby(rows, lambda row: [row[i] for i in at]):
            made += run(list(group))
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=names)
                made = []
        yield pd.DataFrame(made, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)
