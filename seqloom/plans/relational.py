"""Queries of the relational operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqloom.functions import text as X
from seqloom.operators import aggregates as A, domain as D, joins as J, reports as P, windows as W

from .registry import Tables, micros, millis, query


@query("""SELECT o_orderkey, cn.n_name AS customer_nation, cr.r_name AS customer_region, sn.n_name AS supplier_nation, sr.r_name AS supplier_region
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""")
def double_dimension_join(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    side = lambda p: place.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"))
    joined = (
        t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(side("customer"), F.col("c_nationkey") == F.col("customer_key"))
        .join(side("supplier"), F.col("s_nationkey") == F.col("supplier_key"))
    )
    return joined.select("o_orderkey", "customer_nation", "customer_region", "supplier_nation", "supplier_region")


@query("""SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1
HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def relational_division(t: Tables) -> DataFrame:
    flags = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    rows = flags.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "flag")
    return J.divided(rows, "s_nationkey", "flag", flags)


@query("""SELECT a.event_id AS view_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 86400000000""")
def primer_pair_range_join(t: Tables) -> DataFrame:
    at = micros("ts").alias("at")
    views = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", at)
    bought = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", at)
    near = J.range_join(views, bought, ["user_id"], "at", "at", 0, 86_400_000_000)
    return near.select("view_id", "purchase_id", "user_id")


_READS = """reads AS (SELECT event_id, user_id, epoch_ms(ts) AS pos FROM events),
genes AS (SELECT event_id AS gene, user_id, epoch_ms(ts) AS start_pos, epoch_ms(ts) + 3600000 * (1 + event_id % 5) AS end_pos
          FROM events WHERE event_type = 'signup')"""


def _reads(t: Tables) -> tuple[DataFrame, DataFrame]:
    pos = millis("ts")
    reads = t.events.select("event_id", "user_id", pos.alias("pos"))
    genes = t.events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("gene"),
        "user_id",
        pos.alias("start_pos"),
        (pos + 3_600_000 * (1 + F.col("event_id") % 5)).alias("end_pos"),
    )
    return reads, genes


@query(f"""WITH {_READS}, hit AS (SELECT r.event_id, g.gene, row_number() OVER (PARTITION BY r.event_id ORDER BY start_pos, gene) AS k
  FROM reads r LEFT JOIN genes g ON r.user_id = g.user_id AND r.pos BETWEEN g.start_pos AND g.end_pos)
SELECT event_id, coalesce(gene::VARCHAR, 'Nongene') AS gene FROM hit WHERE k = 1""")
def point_in_interval(t: Tables) -> DataFrame:
    reads, genes = _reads(t)
    held = J.point_in_interval(reads, genes, ["user_id"], "pos", "start_pos", "end_pos", 5 * 3_600_000)
    first = W.first_rows(held, ["event_id"], ["start_pos", "gene"])
    return first.select("event_id", F.coalesce(F.col("gene").cast("string"), F.lit("Nongene")).alias("gene"))


@query("""WITH d AS (SELECT l_suppkey, (epoch_ms(l_shipdate) // 86400000) AS day, l_quantity FROM lineitem),
g AS (SELECT s_suppkey, 8500 + s_suppkey % 7 * 100 AS a, 8600 + s_suppkey % 7 * 100 AS b FROM supplier)
SELECT s_suppkey, avg(l_quantity) AS mean, median(l_quantity) AS median, count(*) AS n
FROM g JOIN d ON l_suppkey = s_suppkey AND day BETWEEN a AND b GROUP BY 1""")
def interval_slice_mean_median(t: Tables) -> DataFrame:
    depth = t.lineitem.select(
        "l_suppkey", F.floor(millis("l_shipdate") / 86_400_000).alias("day"), "l_quantity"
    )
    genes = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), (8500 + F.col("s_suppkey") % 7 * 100).alias("a"), (8600 + F.col("s_suppkey") % 7 * 100).alias("b")
    )
    held = J.point_in_interval(depth, genes, ["l_suppkey"], "day", "a", "b", 100, how="inner")
    return held.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median"), F.count("*").alias("n")
    )


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 5 = 0 WHERE o_orderkey IS NULL")
def anti_join_unprocessed(t: Tables) -> DataFrame:
    processed = t.orders.filter("o_orderkey % 5 = 0")
    return t.customer.join(processed, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""")
def pair_semi_join(t: Tables) -> DataFrame:
    listed = t.events.filter("event_type = 'error' AND value > 150").select("user_id")
    return t.events.join(listed, "user_id", "left_semi").select("user_id", "event_type").distinct()


@query("""SELECT c_custkey, coalesce(n_name, 'unassigned') AS nation, coalesce(n, 0) AS n_orders FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_joins_with_defaults(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = t.customer.join(t.nation.filter("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        counts, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return joined.select("c_custkey", F.coalesce("n_name", F.lit("unassigned")).alias("nation"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(a.v, b.v, c.v) AS v FROM
(SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) a FULL JOIN
(SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k FULL JOIN
(SELECT p_partkey AS k, p_retailprice AS v FROM part) c ON coalesce(a.k, b.k) = c.k""")
def coalesce_three_sources(t: Tables) -> DataFrame:
    return J.merged_sources(
        [
            t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")),
            t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")),
            t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")),
        ],
        ["k"],
    )


@query("SELECT c_custkey, coalesce(n_name, 'none') AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def value_conversion(t: Tables) -> DataFrame:
    table = t.nation.select("n_nationkey", "n_name")
    keyed = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    named = table.select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return J.converted(keyed, "c_nationkey", named, "k", "n_name", F.lit("none"))


@query("""WITH s AS (SELECT s_nationkey AS a, c_nationkey AS b, avg(l_discount) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT least(a, b) AS a, greatest(a, b) AS b, avg(1 - v) AS distance FROM s WHERE a <> b GROUP BY 1, 2""")
def symmetric_distance(t: Tables) -> DataFrame:
    s = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
        .agg(F.avg("l_discount").alias("v"))
    )
    return J.symmetric(s, "a", "b", "v")


@query("""WITH r AS (SELECT p_brand, p_size, p_retailprice,
  rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry FROM part)
SELECT p_brand, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1""")
def spearman_by_group(t: Tables) -> DataFrame:
    return A.spearman(t.part.select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query("SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS r, var_samp(l_quantity) AS var_q, stddev_pop(l_discount) AS sd_d FROM lineitem GROUP BY 1")
def pearson_and_variance(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.corr("l_quantity", "l_extendedprice").alias("r"), F.var_samp("l_quantity").alias("var_q"), F.stddev_pop("l_discount").alias("sd_d")
    )


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c)
SELECT lang, -sum(p * log2(p)) AS entropy FROM p GROUP BY 1""")
def shannon_entropy(t: Tables) -> DataFrame:
    return A.entropy(t.documents, ["lang"], "source")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
g AS (SELECT user_id, place, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS run FROM e WHERE event_type <> 'error')
SELECT user_id, min(place) AS first, max(place) AS last, count(*) AS n FROM g GROUP BY user_id, run HAVING count(*) >= 3""")
def gaps_islands(t: Tables) -> DataFrame:
    return W.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", 3)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events""")
def carry_forward(t: Tables) -> DataFrame:
    last = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return W.carried_forward(t.events, ["user_id"], ["ts", "event_id"], last, "signup_id").select("event_id", "signup_id")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type""")
def consecutive_dedup(t: Tables) -> DataFrame:
    return W.changes(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_hit(t: Tables) -> DataFrame:
    return W.first_rows(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, max(value) AS best, arg_max(event_id, {'v': value, 'e': event_id}) AS event_id FROM events GROUP BY 1")
def best_by_max(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("""WITH z AS (SELECT l_suppkey, (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, avg(CASE WHEN z >= 1 THEN 1.0 ELSE 0.0 END) AS high FROM z GROUP BY 1""")
def zscore_high_fraction(t: Tables) -> DataFrame:
    z = W.z_scores(t.lineitem.select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", "z")
    return z.groupBy("l_suppkey").agg(F.avg((F.col("z") >= 1).cast("double")).alias("high"))


@query("""SELECT doc_id, CASE WHEN n_chars <= 1000 THEN 0 ELSE ceil(5 * row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) / count(*) OVER (PARTITION BY lang)) END::INT AS score FROM documents""")
def length_quintile(t: Tables) -> DataFrame:
    return W.length_quintile(t.documents, ["lang"], "n_chars", "doc_id", "score", 1000).select("doc_id", "score")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
FROM events GROUP BY 1""")
def sample_type_pivot(t: Tables) -> DataFrame:
    return A.pivot_counts(t.events, "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("""SELECT CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice < 10000 THEN 1 WHEN o_totalprice < 50000 THEN 2 WHEN o_totalprice < 200000 THEN 3 ELSE 4 END AS bin,
count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice BETWEEN 0 AND 1000000 GROUP BY 1""")
def hist_fixed_bins(t: Tables) -> DataFrame:
    return A.histogram(t.orders, "o_totalprice", [0, 1000, 10_000, 50_000, 200_000, 1_000_000])


@query("""WITH k AS (SELECT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, 'only1' AS side FROM (SELECT k FROM k EXCEPT SELECT k FROM o) UNION ALL
SELECT k, 'only2' FROM (SELECT k FROM o EXCEPT SELECT k FROM k) UNION ALL SELECT k, 'both' FROM (SELECT k FROM k INTERSECT SELECT k FROM o)""")
def list_differences(t: Tables) -> DataFrame:
    return P.list_sides(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")).distinct(), "k")


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 100")
def top_k_multi_key(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(100).select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 1000, event_id) AS place FROM events""")
def natural_sort_rank(t: Tables) -> DataFrame:
    name = F.concat(F.lit("K"), F.col("event_id") % 1000)
    w = Window.partitionBy("user_id").orderBy(X.natural_key(name), "event_id")
    return t.events.select("event_id", F.row_number().over(w).alias("place"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_params_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "map<string,string>")["k"].cast("int").alias("k"))


@query("""WITH r AS (SELECT o_orderkey, 100 * avg(l_tax * 12) AS complete, 100 * avg(l_discount * 4) AS contam FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN complete < 30 THEN 'junk' WHEN complete >= 80 THEN CASE WHEN contam / complete <= 0.15 THEN 'quality' WHEN contam / complete >= 0.75 THEN 'sibling' ELSE 'contaminated' END
  ELSE CASE WHEN contam / complete <= 0.15 THEN 'incomplete' ELSE 'junk' END END AS class FROM r""")
def case_quality_class(t: Tables) -> DataFrame:
    joined = t.orders.join(A.in_file_order(t.lineitem, "at"), F.col("o_orderkey") == F.col("l_orderkey"))
    mean = lambda x: 100 * A.ordered_mean(F.col("at"), x)
    r = joined.groupBy("o_orderkey").agg(mean(F.col("l_tax") * 12).alias("complete"), mean(F.col("l_discount") * 4).alias("contam"))
    return r.select("o_orderkey", D.bin_class(F.col("complete"), F.col("contam")).alias("class"))


@query("""SELECT c_custkey, CASE WHEN (c_acctbal > 0)::INT * 5 + (c_acctbal > 5000)::INT * 6 + (c_mktsegment = 'BUILDING')::INT * 4 >= 13 THEN 'Plasmid' ELSE 'Chromosome' END AS class FROM customer""")
def weighted_score_class(t: Tables) -> DataFrame:
    votes = [(F.col("c_acctbal") > 0, 5), (F.col("c_acctbal") > 5000, 6), (F.col("c_mktsegment") == "BUILDING", 4)]
    return t.customer.select("c_custkey", D.plasmid_by_votes(votes).alias("class"))


@query("""WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2)
SELECT n.o_orderpriority, n.y, (n.v - o.v) / o.v AS fold FROM y n JOIN y o ON n.o_orderpriority = o.o_orderpriority AND n.y = o.y + 1""")
def fold_difference(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    w = Window.partitionBy("o_orderpriority").orderBy("y").rangeBetween(-1, -1)
    return y.withColumn("old", F.max("v").over(w)).filter("old IS NOT NULL").select("o_orderpriority", "y", ((F.col("v") - F.col("old")) / F.col("old")).alias("fold"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def html_title_extract(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang")
    )


@query("SELECT doc_id AS id, 'document' AS kind, length(text) AS n FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark")
def concat_union_all(t: Tables) -> DataFrame:
    n = F.char_length("text").cast("long").alias("n")
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), n).unionByName(
        t.benchmark.select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"), n)
    )


@query("""WITH i AS (SELECT l_suppkey AS k, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem), p AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS place FROM i)
SELECT k, count(*)::BIGINT AS covered FROM p GROUP BY 1""")
def subject_coverage(t: Tables) -> DataFrame:
    i = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    return A.covered(i, ["k"], "s", "e")


@query("""SELECT l_suppkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS weighted, avg(l_extendedprice) AS plain, median(l_extendedprice) AS med FROM lineitem GROUP BY 1""")
def weighted_coverage(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("weighted"), F.avg("l_extendedprice").alias("plain"), F.median("l_extendedprice").alias("med")
    )


@query("""SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS genomes, count(DISTINCT l_orderkey) AS contigs, count(*) / count(DISTINCT l_suppkey) AS ratio FROM lineitem GROUP BY 1""")
def genes_per_product(t: Tables) -> DataFrame:
    genomes = F.count_distinct("l_suppkey")
    return t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("n"), genomes.alias("genomes"), F.count_distinct("l_orderkey").alias("contigs"), (F.count("*") / genomes).alias("ratio")
    )


@query("""SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""")
def classification_roll_call(t: Tables) -> DataFrame:
    joined = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS d FROM events)
SELECT a.user_id AS a, b.user_id AS b, count(*) AS shared FROM d a JOIN d b ON a.d = b.d AND a.event_type = b.event_type AND a.user_id < b.user_id GROUP BY 1, 2""")
def co_membership(t: Tables) -> DataFrame:
    days = t.events.select("user_id", F.struct("event_type", F.date_trunc("day", "ts").alias("d")).alias("cluster"))
    return A.shared_clusters(days, "user_id", "cluster")


@query("""WITH u AS (SELECT p_brand AS c, p_size AS v FROM part UNION ALL SELECT p_type, p_size FROM part) SELECT c, var_samp(v) AS variance, avg(v) AS mean FROM u GROUP BY 1""")
def unpivoted_column_stats(t: Tables) -> DataFrame:
    long = t.part.unpivot(["p_partkey", "p_size"], ["p_brand", "p_type"], "column", "c")
    return long.groupBy("c").agg(F.var_samp("p_size").alias("variance"), F.avg("p_size").alias("mean"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY 1, 2""")
def threshold_filter_counts(t: Tables) -> DataFrame:
    kept = t.lineitem.filter("l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount BETWEEN 0.02 AND 0.08")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
