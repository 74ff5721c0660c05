"""What the fourth round's findings named."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import image_features
from seqloom.operators import blocks, intervals as I
from seqloom.plans import catalog
from seqloom.sources import sinks
from seqloom.storage import cut


@pytest.mark.parametrize("taken", [1, 40, 1 << 25])
def test_tiers_are_looked_up_in_a_table_of_bits(monkeypatch, taken):
    """the intervals over a point were gone through for each interval; tiers beyond the table are found too."""
    monkeypatch.setattr(I, "TAKEN", taken)
    draw = np.random.default_rng(4)
    s = np.sort(draw.integers(0, 60, 400))
    e = s + draw.integers(1, 40, 400)
    rank = np.argsort(np.lexsort((draw.permutation(400), s - e)))
    want = np.full(400, -1)
    for i in np.argsort(rank):
        over = set(want[(s < e[i]) & (s[i] < e) & (want >= 0)].tolist())
        want[i] = next(t for t in range(400) if t not in over)
    assert want.max() > 130
    got = np.where(rank < 100, want, -1)
    I._placed(s, e, got, rank, -np.inf, np.inf)
    assert got.tolist() == want.tolist()
    part = np.full(400, -1)
    I._placed(s, e, part, rank, -np.inf, 90)
    assert (part >= 0).any() and (part < 0).any() and (part[part >= 0] == want[part >= 0]).all()


def test_slices_are_no_more_than_cores_and_memory_ask_for(spark):
    """a slice held 100,000 intervals, so that rounds, of which each settles two slices at worst, grew ten times as fast."""
    rows = spark.range(900_000).select(F.lit(0).alias("__island"), F.col("id").alias("s"), (F.col("id") + 5).alias("e"))
    (cuts, fit), = I._slices(rows, "s", "e").values()
    assert len(cuts) == 3 and fit > 100_000


def test_xml_files_are_packed(spark, tmp_path, monkeypatch):
    """F8: the reports took some fourteen times the disk of the table they were written from."""
    wrote = []
    whole = sinks.write_rooted
    monkeypatch.setattr(sinks, "write_rooted", lambda rows, record, root, path, *more: wrote.append(path) or whole(rows, record, root, path, *more))
    sf = "/root/testdata/sf0.001"
    hits = catalog.QUERIES["blast_xml_hits"](spark, sf)
    assert hits.count() == spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_suppkey >= 3 AND l_linenumber >= 2 AND greatest(l_linenumber, 9) - least(l_linenumber, 9) + 1 >= 5").count()
    files = spark.read.format("binaryFile").load(wrote[0])
    lines = spark.read.text(wrote[0])
    assert files.agg(F.sum("length")).first()[0] < 0.2 * lines.agg(F.sum(F.length("value") + 1)).first()[0]


def test_times_do_not_hang_on_the_zone_of_the_session(spark, tmp_path):
    """where clocks are changed, hits two hours apart seemed one or three hours apart."""
    days = ["2024-03-10", "2024-11-03", "2024-01-05"]
    rows = [(d * 20 + h, f"{day} {h:02d}:00:00.000999", h // 9) for d, day in enumerate(days) for h in range(0, 18, 2)]
    for name in ("utc", "other"):
        df = spark.createDataFrame(rows, "event_id long, at string, user_id long").withColumn("ts", F.col("at").cast("timestamp_ntz"))
        df.write.parquet(str(tmp_path / name / "events.parquet"))
    found = {}
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name, at in (("utc", "UTC"), ("other", "America/New_York")):
        spark.conf.set("spark.sql.session.timeZone", at)
        try:
            for query in ("alignment_clusters", "event_tiers"):
                found[query, name] = sorted(tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path / name)).collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    for query in ("alignment_clusters", "event_tiers"):
        assert found[query, "utc"] == found[query, "other"]


def test_a_task_has_one_pair_of_blocks(spark, monkeypatch):
    """pairs of blocks were dealt by hash, so that some tasks had several and others none."""
    monkeypatch.setattr(image_features, "stored", lambda df, name: df)
    rows = spark.range(600).select(F.col("id").alias("class_id"), F.lit(0).alias("corner"), F.array(*[F.xxhash64("id", F.lit(w)) for w in range(4)]).alias("bits"))
    met = image_features.all_near_corners(rows, rows).withColumn("task", F.spark_partition_id())
    got = met.groupBy("task").agg(F.count_distinct(F.pmod(F.xxhash64("i"), F.lit(12))).alias("blocks"), F.count("*").alias("n")).collect()
    assert len(got) == 12 and all(r.blocks == 1 for r in got) and sum(r.n for r in got) == 600


def test_sets_are_sent_as_bits(spark, monkeypatch):
    """each block was sent a long for each item of a set; items come from several partitions here, one without rows."""
    kept = []
    monkeypatch.setattr(blocks, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(blocks, "number_of_blocks", lambda n, items=0: 3)
    has = {m: {i for i in range(150) if (i * 7 + m) % 5} for m in range(40)} | {40: {700}, 41: {700, 701}}
    df = spark.createDataFrame([(m, i) for m, s in has.items() for i in s] + [(None, 3), (3, None)], "m int, i int")
    got = blocks.shared_counts(df, "m", "i", lambda n, m, k: np.where(k > 0, 1000 * n + k, -1), "v").collect()
    assert sorted((r.a, r.b, r.v % 1000) for r in got) == [(a, b, len(has[a] & has[b])) for a in has for b in has if a < b and has[a] & has[b]]
    assert all(r.v // 1000 in (len(has[r.a]), len(has[r.b])) for r in got)
    sets = kept[-1]
    assert dict(sets.dtypes)["bits"] == "array<bigint>" and sets.agg(F.sum(F.size("bits"))).first()[0] <= 42 * 3
