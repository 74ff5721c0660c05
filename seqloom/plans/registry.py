"""Where query functions register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone.

    It isn't cast to one with a zone: where the session's zone changes its clocks, times would move by an hour.
    """
    at = F.col(at).cast("timestamp_ntz")
    minutes = F.unix_date(at.cast("date")).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def millis(at: str) -> Column:
    return F.floor(micros(at) / 1000)
