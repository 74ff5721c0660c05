"""One query for each corpus operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bin_pack,
    bpe_fold,
    common,
    host_rules,
    image_features,
    lang_mixture,
    near_dedup,
    ordinal_quality,
    poisson_mix,
    spelling,
    token_frames,
    toxicity,
    url_cascade,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ordinal_quality.train(docs, ordinal_quality.grades_of(_table(spark, sf_dir, "labels")))
    return ordinal_quality.score(docs, model)


#: Rules of the contract, and a stand-in for a list of unwanted hosts: one in eight
#: hosts by md5, since the tables come with no list.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    hosts = pages.select(url_cascade.host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.filter(F.substring(F.md5(F.encode("key", "UTF-8")), 1, 1).isin("0", "1"))
    return url_cascade.filter_urls(pages, listed, URL_RULES)


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.replicate(_table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)
    return mixed.select(
        "doc_id", "source", "copy_no", "shuffle_key", F.md5(F.encode("text", "UTF-8")).alias("text_md5")
    )


def op4_lang_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_mixture.train(docs.filter(~lang_mixture.held_out(F.col("doc_id"))))
    found = lang_mixture.identify(docs, model)
    return found.select(
        "doc_id", lang_mixture.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares"
    )


#: Sources not named here have weight 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = host_rules.host_rules(_table(spark, sf_dir, "documents"))
    return rules.withColumn("host_rate", F.round("host_rate", 9))


def op7_bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bin_pack.shard(_table(spark, sf_dir, "documents"), n_shards=16)
    return packed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_frames.write(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
    )
    return token_frames.read_back(manifest)


def op9_image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every picture whose id is divisible by 20, against all pictures.

    The tables have no media column; pictures are rendered from embeddings. Every row of
    the table is given with its class: pictures that are equal, or equal but for noise, by
    their least id (null without a picture). Rows asked for come with a row for each class
    that an edited copy of their class's picture matches; its members are the rows with that
    class_id. A picture's own class always matches, with 0 votes if nothing else says so.
    """
    images = common.stored(image_features.rendered(_table(spark, sf_dir, "embeddings")), "images")
    equal = common.stored(image_features.classes(images), "image-classes")
    one_each = images.join(equal.filter("id = class_id"), "id").select("class_id", "image")
    found = image_features.features(one_each)
    near = common.stored(image_features.near_classes(found), "image-near")
    member = equal.join(near, "class_id", "left").select("id", F.coalesce("near_id", "class_id").alias("class_id"))
    member = common.stored(member, "image-members")
    index = found.join(near.filter("near_id <> class_id"), "class_id", "left_anti")
    asked = member.filter("id % 20 = 0")
    asked_classes = asked.select("class_id").distinct()
    queries = image_features.edited(one_each.join(asked_classes, "class_id"))
    matches = image_features.search(image_features.features(queries), index)
    own = asked_classes.select(F.col("class_id").alias("query_class"), "class_id", F.lit(0).cast("long").alias("votes"))
    pairs = matches.unionByName(own).groupBy("query_class", F.col("class_id").alias("match_class")).agg(F.max("votes").alias("votes"))
    matched = asked.join(pairs, asked["class_id"] == pairs["query_class"]).select(
        F.col("id").alias("vec_id"), "class_id", "match_class", "votes"
    )
    without = images.filter("id IS NULL OR image IS NULL").select("id", F.lit(None).cast("long").alias("class_id"))
    others = member.filter("id % 20 <> 0").unionByName(without)
    return matched.unionByName(others.withColumnRenamed("id", "vec_id"), allowMissingColumns=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_fold.encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe_fold.decode(encoded, ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_url_filter": op3_url_filter,
    "op4_lang_mixture": op4_lang_mixture,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_host_rules": op6_host_rules,
    "op7_bin_pack": op7_bin_pack,
    "op8_token_frames": op8_token_frames,
    "op9_image_features": op9_image_features,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_toxicity": op13_toxicity,
}

def _codes_sql() -> str:
    """Lloyd's rounds one after the other; the least of 256 * distance + entry, so that the lower entry wins ties."""
    rounds = []
    for i in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""
a{i} AS (
  SELECT p.rid, part, p.x,
         min(256 * list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k]))) + c.entry) AS best
  FROM p JOIN c{i} c USING (part) GROUP BY ALL)""")
        if i < vector_codes.ROUNDS:
            rounds.append(f"""
s{i} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS x FROM (
    SELECT part, (best % 256)::INT AS entry, k, sum(x[k]) AS s, count(*) AS n
    FROM a{i}, unnest(range(1, len(x) + 1)) AS u(k) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS (SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s USING (part, entry))""")
    return ",".join(rounds)


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS shingle
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
    "op3_url_filter": r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
m AS (
  SELECT u.*, (SELECT max_by({'rule': rule, 'verdict': verdict}, length(rule)) FROM r
               WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit
  FROM u)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN host <> '' AND md5(host)[1] IN ('0', '1') THEN 'block' ELSE 'allow' END) AS verdict
FROM m""",
    "op5_poisson_mix": r"""
WITH n AS (SELECT source, count(*) AS n,
                  CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END AS weight
           FROM documents GROUP BY source),
r AS (SELECT source, sum(n) OVER () * 1.0::DOUBLE * weight / sum(weight) OVER () / n AS rate FROM n),
t AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 12)::INT + 1)) AS k FROM r),
p AS (SELECT source, k, exp(sum(CASE WHEN k > 0 THEN ln(rate / k) ELSE 0.0::DOUBLE END) OVER (
               PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - rate) AS p FROM t),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM p),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(text) AS text_md5,
             ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM documents),
m AS (SELECT rid, doc_id, d.source, text_md5, count(*) AS times
      FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY ALL),
e AS (SELECT doc_id, source, text_md5, unnest(range(0, times))::INT AS copy_no FROM m)
SELECT doc_id, source, copy_no, text_md5,
       ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 13))::BIGINT AS shuffle_key
FROM e""",
    "op6_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
w AS (
  SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
win AS (
  SELECT rid, i, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s,
         count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM w),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS k FROM win WHERE n = 8),
marked AS (
  SELECT w.rid, w.word, max(CASE WHEN k > 1 THEN w.i END) OVER (
           PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered
  FROM w LEFT JOIN twice t ON t.rid = w.rid AND t.i = w.i),
a AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
         sum(CASE WHEN covered IS NOT NULL THEN 1 ELSE 0 END) AS n_repeat_words
  FROM marked GROUP BY rid),
l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN a USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
q AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM p),
r AS (SELECT source, (k + m * weight) / (n + weight) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate <= 0.5, TRUE) AS kept, round(host_rate, 9) AS host_rate
FROM f LEFT JOIN r USING (source)""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT run, k, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM runs),
h AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM b, t),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
words AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(p)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -n, 'form': other}) AS b FROM near GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.form END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
r AS (
  SELECT word, form, word AS root FROM f
  UNION ALL SELECT r.word, f.form, r.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL""",
    "op12_vector_codes": r"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, unnest(range(4)) AS u(part)),
c0 AS (SELECT part, (rid - 1)::INT AS entry, x FROM p WHERE rid <= 256),"""
    + _codes_sql()
    + r""",
e AS (
  SELECT rid, string_agg(lower(printf('%02x', (best % 256)::INT)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM a4 GROUP BY rid),
g AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN v USING (rid) GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM e JOIN v USING (rid) JOIN g ON g.label IS NOT DISTINCT FROM v.label""",
}
