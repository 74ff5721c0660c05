"""Queries of the hit, classification and alignment operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.operators import aggregates as A, covers as C, domain as D, graph as G, intervals as I

from .registry import Tables, millis, query


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 905.5")
def comparator_thresholds(t: Tables) -> DataFrame:
    kept = D.thresholds(t.part, [("p_size", ">=", 10), ("p_size", "<", 40), ("p_retailprice", ">", 905.5)])
    return D.projected(kept, [kept.columns.index(c) for c in ("p_partkey", "p_size", "p_retailprice")])


@query("""WITH r AS (SELECT o_orderkey, 100 * avg(l_tax * 12) AS c, 100 * avg(l_discount * 4) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
k AS (SELECT CASE WHEN c < 30 THEN 'junk' WHEN c >= 80 THEN CASE WHEN x / c <= 0.15 THEN 'quality' WHEN x / c >= 0.75 THEN 'sibling' ELSE 'contaminated' END
  WHEN x / c <= 0.15 THEN 'incomplete' ELSE 'junk' END AS class FROM r) SELECT class, count(*) AS n FROM k GROUP BY 1""")
def bin_class_counts(t: Tables) -> DataFrame:
    joined = t.orders.join(A.in_file_order(t.lineitem, "at"), F.col("o_orderkey") == F.col("l_orderkey"))
    mean = lambda x: 100 * A.ordered_mean(F.col("at"), x)
    rows = joined.groupBy("o_orderkey").agg(mean(F.col("l_tax") * 12).alias("c"), mean(F.col("l_discount") * 4).alias("x"))
    return rows.groupBy(D.bin_class(F.col("c"), F.col("x")).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice DESC, l_linenumber) = 1""")
def best_hit_per_query(t: Tables) -> DataFrame:
    order = [F.col("l_discount"), F.desc("l_extendedprice"), F.col("l_linenumber")]
    return D.best_hits(t.lineitem, "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH c AS (SELECT l_suppkey, l_partkey % 11 AS taxid, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, taxid, n FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, taxid) = 1""")
def most_frequent_taxid(t: Tables) -> DataFrame:
    return D.most_frequent(t.lineitem.select("l_suppkey", (F.col("l_partkey") % 11).alias("taxid")), ["l_suppkey"], "taxid")


@query("""WITH tax AS (SELECT r_name, n_name, c_mktsegment, greatest(c_acctbal, 0.0)::DECIMAL(18,2) AS w
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s3 AS (SELECT r_name, n_name, c_mktsegment, sum(w) AS w FROM tax GROUP BY ALL),
k3 AS (SELECT * FROM s3 WHERE w >= 50000),
s2 AS (SELECT r_name, n_name, sum(w) AS w FROM s3 WHERE w < 50000 GROUP BY ALL),
k2 AS (SELECT * FROM s2 WHERE w >= 50000),
s1 AS (SELECT r_name, sum(w) AS w FROM s2 WHERE w < 50000 GROUP BY ALL)
SELECT r_name || '; ' || n_name || '; ' || c_mktsegment AS path, w::DOUBLE AS weight FROM k3 UNION ALL
SELECT r_name || '; ' || n_name, w::DOUBLE FROM k2 UNION ALL SELECT r_name, w::DOUBLE FROM s1""")
def small_bins_to_parents(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.select("r_name", "n_name", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(18,2)").alias("weight"))
    return D.small_groups_to_parents(rows, ["r_name", "n_name", "c_mktsegment"], "weight", 50_000).select("path", F.col("weight").cast("double").alias("weight"))


@query("""SELECT CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 0 WHEN NOT regexp_matches(text, '^[A-Z][a-z]+') THEN 1
WHEN NOT regexp_matches(text, '^[A-Z][a-z]+ [a-z]+') THEN 2 END AS place, count(*) AS n FROM documents GROUP BY 1""")
def first_mismatch_counts(t: Tables) -> DataFrame:
    return D.first_mismatch(t.documents, "text", ["^[A-Z]", "^[A-Z][a-z]+", "^[A-Z][a-z]+ [a-z]+"])


@query("""WITH d AS (SELECT doc_id, text, length(text) AS t, length(text) // 500 AS n FROM documents),
p AS (SELECT *, unnest(range(n)) AS piece FROM d WHERE n > 0)
SELECT doc_id, piece::INT AS piece, (piece * t // n)::INT AS start, substr(text, (piece * t // n) + 1, ((piece + 1) * t // n) - (piece * t // n)) AS seq FROM p""")
def sequence_pieces(t: Tables) -> DataFrame:
    return D.pieces(t.documents, "doc_id", "text", 500)


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey % 3 AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k, min(o_orderkey) % 3 AS v FROM orders GROUP BY 1)
SELECT count(*) FILTER (a.v = b.v) AS same, count(*) FILTER (a.v <> b.v) AS different,
count(*) FILTER (b.v IS NULL AND a.v IS NOT NULL) AS first_only, count(*) FILTER (a.v IS NULL AND b.v IS NOT NULL) AS second_only FROM a FULL JOIN b USING (k)""")
def assignment_agreement(t: Tables) -> DataFrame:
    a = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).alias("v"))
    b = t.orders.groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_orderkey") % 3).alias("v"))
    return D.agreement(a, b, "k", "v")


_CLUSTERS = "s AS (SELECT l_suppkey AS m, list(DISTINCT l_partkey % 500) AS has FROM lineitem WHERE l_quantity < 12 GROUP BY 1)"


def _clusters(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity < 12").select((F.col("l_partkey") % 500).alias("cluster"), "l_suppkey")


@query(f"""WITH RECURSIVE {_CLUSTERS},
r AS (SELECT 0 AS place, NULL::BIGINT AS m, 0::BIGINT AS new, 0::BIGINT AS total, (SELECT list(DISTINCT i) FROM (SELECT unnest(has) AS i FROM s)) AS remaining
UNION ALL SELECT place + 1, s.m, len(list_intersect(has, remaining))::BIGINT, total + len(list_intersect(has, remaining)), list_filter(remaining, lambda x: NOT list_contains(has, x))
  FROM r, s WHERE len(list_intersect(has, remaining)) > 0 QUALIFY row_number() OVER (ORDER BY len(list_intersect(has, remaining)) DESC, s.m DESC) = 1)
SELECT place, m AS l_suppkey, new, total FROM r WHERE place > 0""")
def greedy_genome_cover(t: Tables) -> DataFrame:
    """Suppliers by how many clusters of parts they add."""
    return C.greedy_cover(_clusters(t), "cluster", "l_suppkey")


@query(f"""WITH RECURSIVE {_CLUSTERS},
r AS (SELECT 0 AS place, NULL::BIGINT AS m, 0::BIGINT AS total, (SELECT list(DISTINCT i) FROM (SELECT unnest(has) AS i FROM s)) AS core, []::BIGINT[] AS used
UNION ALL SELECT place + 1, s.m, len(list_intersect(has, core))::BIGINT, list_intersect(has, core), list_append(used, s.m)
  FROM r, s WHERE NOT list_contains(used, s.m) QUALIFY row_number() OVER (ORDER BY len(list_intersect(has, core)) DESC, s.m DESC) = 1)
SELECT place, m AS l_suppkey, total FROM r WHERE place > 0""")
def greedy_core_curve(t: Tables) -> DataFrame:
    """Suppliers in the order that keeps most clusters of parts common to all so far."""
    return C.greedy_core(_clusters(t), "cluster", "l_suppkey")


@query("""WITH a AS (SELECT l_partkey::VARCHAR AS amp, l_returnflag AS g, l_linestatus || CASE WHEN l_quantity > 49 THEN 'N' ELSE '' END AS s FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) = 1),
v AS (SELECT amp, sum(length(s) - length(replace(s, 'N', '')))::BIGINT AS n_ambiguous FROM a GROUP BY 1
  HAVING count(*) = count(DISTINCT g) AND count(DISTINCT g) = (SELECT count(DISTINCT g) FROM a)),
k AS (SELECT amp, s, count(*) AS k FROM a GROUP BY 1, 2),
u AS (SELECT amp, count(*) FILTER (k = 1) AS n_unique, sum(CASE WHEN k > 1 THEN k ELSE 0 END)::BIGINT AS n_duplicated FROM k GROUP BY 1)
SELECT amp, n_unique, n_duplicated, n_ambiguous FROM v JOIN u USING (amp)""")
def amplicon_statistics(t: Tables) -> DataFrame:
    seq = F.concat("l_linestatus", F.when(F.col("l_quantity") > 49, "N").otherwise(""))
    one = A.in_file_order(t.lineitem, "at").groupBy(F.col("l_partkey").cast("string").alias("amp"), F.col("l_returnflag").alias("g")).agg(
        F.min_by(seq, F.struct("l_orderkey", "l_linenumber", "at")).alias("s")
    )
    return D.valid_amplicons(one, "amp", "g", "s", one)


@query("""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS id, epoch_ms(ts) AS s, epoch_ms(ts) + event_id % 7 * 3600000 AS e FROM events),
l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.k = b.k AND a.id <> b.id AND abs(a.s - b.s) <= 7200000 AND abs(a.e - b.e) <= 7200000),
r AS (SELECT id, id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY 1""")
def alignment_clusters(t: Tables) -> DataFrame:
    at = millis("ts")
    hits = t.events.select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), at.alias("s"), (at + F.col("event_id") % 7 * 3_600_000).alias("e"))
    return G.alignment_clusters(hits, "id", "s", "e", 7_200_000)


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS m, l_partkey % 300 AS i FROM lineitem), n AS (SELECT m, count(*) AS n FROM r GROUP BY 1),
k AS (SELECT x.m AS a, y.m AS b, count(*) AS k FROM r x JOIN r y ON x.i = y.i AND x.m < y.m GROUP BY 1, 2)
SELECT a.m AS a, b.m AS b, a.n + b.n - 2 * coalesce(k, 0) AS differing FROM n a JOIN n b ON a.m < b.m LEFT JOIN k ON k.a = a.m AND k.b = b.m WHERE a.n + b.n - 2 * coalesce(k, 0) <= 60""")
def duplicate_genomes(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 300).alias("i"))
    return G.near_equal_sets(rows, "m", "i", 60)


@query("""WITH RECURSIVE p AS (SELECT c_nationkey AS q, c_custkey % 25 AS r, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2),
l AS (SELECT least(q, r) AS a, greatest(q, r) AS b FROM p WHERE q <> r AND v > 9000 GROUP BY 1, 2),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT DISTINCT least(q, r) AS x FROM p WHERE q <> r UNION SELECT greatest(q, r) FROM p WHERE q <> r),
c AS (SELECT x AS id, x AS root FROM n UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT id AS node, min(root) AS root FROM c GROUP BY 1""")
def single_linkage_clusters(t: Tables) -> DataFrame:
    pairs = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("q"), (F.col("c_custkey") % 25).alias("r")).agg(F.avg("c_acctbal").alias("v")).filter("q <> r")
    d = pairs.select(F.least("q", "r").alias("a"), F.greatest("q", "r").alias("b"), F.when(F.col("v") > 9000, 0.0).otherwise(1.0).alias("distance"))
    return G.single_linkage(d, 0.5)


@query("""WITH g AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS place, unnest(string_split(translate(text, ' .', '--'), '')) AS nt FROM documents),
k AS (SELECT place FROM g GROUP BY 1 HAVING avg(CASE WHEN nt IN ('-', 'N') THEN 1.0 ELSE 0.0 END) < 0.2)
SELECT doc_id, md5(string_agg(nt, '' ORDER BY place)) AS digest FROM g JOIN k USING (place) GROUP BY 1""")
def gapless_alignment(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.translate("text", " .", "--").alias("seq"))
    kept = D.aligned_columns(rows, "doc_id", "seq", 0.2).filter("seq <> ''")
    return kept.select("doc_id", F.md5(F.encode("seq", "UTF-8")).alias("digest"))


@query("""SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0 AND length(text) - length(translate(text, ' ', '')) < 0.16 * length(text)""")
def alignment_rows_without_gaps(t: Tables) -> DataFrame:
    return D.gappy_rows(t.documents, "text", 0.16, " ").select("doc_id", F.char_length("text").cast("long").alias("n"))


def _tiers_sql(rows: str) -> str:
    """Tiers of rows (k, s, e, id) island by island, a row of each at a step, the longest first."""
    tier = "list_filter(range(len(done) + 1), lambda t: len(list_filter(done, lambda a: a.t = t AND a.s < x.e AND x.s < a.e)) = 0)[1]"
    return f"""WITH RECURSIVE {rows},
o AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY k ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS opens FROM i),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY k ORDER BY s, e, id) AS island FROM o),
x AS (SELECT *, row_number() OVER (PARTITION BY k, island ORDER BY s - e, id) AS step FROM g),
r AS (SELECT k, island, 0 AS step, NULL::BIGINT AS id, 0 AS tier, []::STRUCT(s BIGINT, e BIGINT, t INT)[] AS done FROM (SELECT DISTINCT k, island FROM g)
  UNION ALL SELECT r.k, r.island, x.step, x.id, {tier}, list_append(done, {{'s': x.s, 'e': x.e, 't': {tier}}})
  FROM r JOIN x ON x.k = r.k AND x.island = r.island AND x.step = r.step + 1)
SELECT i.*, r.tier::INT AS tier FROM i JOIN r USING (id)"""


@query(_tiers_sql("i AS (SELECT o_custkey AS k, epoch(o_orderdate::TIMESTAMP)::BIGINT // 86400 AS s, epoch(o_orderdate::TIMESTAMP)::BIGINT // 86400 + o_orderkey % 30 + 1 AS e, o_orderkey AS id FROM orders)"))
def order_tiers(t: Tables) -> DataFrame:
    """Each customer's orders as intervals without overlap in a tier."""
    day = F.floor(millis("o_orderdate") / 86_400_000)
    rows = t.orders.select(F.col("o_custkey").alias("k"), day.alias("s"), (day + F.col("o_orderkey") % 30 + 1).alias("e"), F.col("o_orderkey").alias("id"))
    return I.interval_tiers(rows, "k", "s", "e", "id")


@query(_tiers_sql("i AS (SELECT 1 AS k, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + (event_id % 7 + 1) * 60000 AS e, event_id AS id FROM events)"))
def event_tiers(t: Tables) -> DataFrame:
    """All events as intervals of one key."""
    at = millis("ts")
    rows = t.events.select(F.lit(1).alias("k"), at.alias("s"), (at + (F.col("event_id") % 7 + 1) * 60_000).alias("e"), F.col("event_id").alias("id"))
    return I.interval_tiers(rows, "k", "s", "e", "id")


@query("""SELECT k, arg_max(v, place) AS v FROM (
  SELECT o_custkey AS k, o_orderstatus AS v, o_orderkey AS place FROM orders UNION ALL SELECT l_suppkey, l_returnflag, -l_orderkey * 10 - l_linenumber FROM lineitem) GROUP BY 1""")
def union_last_wins(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("place"))
    b = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), (-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("place"))
    return a.unionByName(b).groupBy("k").agg(F.max_by("v", "place").alias("v"))
