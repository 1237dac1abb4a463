"""Registered queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwatch.llm import (language_id, line_rules, mixing, ngram_join, packing, periodic_runs, prefix_trie, quality, secrets, simhash,
                            token_counts, topk, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
KEEP_SCORE = 0.3


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_packing")
def op1_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_quality")
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, keep=["doc_id"]).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.KINDS]
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, "base_sha256", spans.alias("spans"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS full_size FROM totals),
ranked AS (
  SELECT *, full_size / w AS full_at, row_number() OVER (ORDER BY full_size / w, source NULLS LAST) AS place,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM weighed),
levels AS (
  SELECT *, (total - coalesce(sum(full_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM ranked),
chosen AS (SELECT min(place) AS first_place FROM levels WHERE lvl <= full_at),
targets AS (
  SELECT source, source_size, CASE WHEN full_at <= lv THEN full_size ELSE lv * w END AS target
  FROM levels, (SELECT lvl AS lv FROM levels, chosen WHERE place = first_place)),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
       / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""


@query("op4_mixing", OP4_SQL)
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    revisit = F.col("record_type") == "revisit"

    def page(name):
        return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")

    return records.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_length")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


@query("op6_ngram_join")
def op6_ngram_join(spark, sf_dir):
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.train(table(spark, sf_dir, "documents")))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op9_top_k", OP9_SQL)
def op9_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op10_line_rules")
def op10_line_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_rules.apply_rules(docs, line_rules.train(docs, table(spark, sf_dir, "labels")))


@query("op11_simhash")
def op11_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, md5(octet_length(encode(r)) || ':' || r || x) AS id, octet_length(encode(x)) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(r)) || ':' || r || x)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
s AS (
  SELECT c, count(*) AS own, c - c % 5 AS base, xor(list_reduce(list_transform(str_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda u, i: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END, xor(a, b)),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM t GROUP BY c),
p AS (SELECT s.*, least(s.h, coalesce(b.own, 0)) AS taken FROM s LEFT JOIN s b ON b.c = s.base),
r AS (
  SELECT p.c, t.pos + 1 AS depth, t.id, t.n FROM p JOIN t ON t.c = p.base AND t.pos < p.h
  UNION ALL SELECT p.c, t.pos - p.h + p.taken + 1, t.id, t.n FROM p JOIN t ON t.c = p.c AND t.pos >= p.h),
path AS (
  SELECT c, depth, n, md5(string_agg(id, ',') OVER (PARTITION BY c ORDER BY depth)) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM p),
node AS (SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM path GROUP BY k, depth),
up AS (SELECT node.*, a.k AS pk FROM node LEFT JOIN path a ON a.c = node.conv_id AND a.depth = node.depth - 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY pk),
full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (k)),
sub AS (
  SELECT a.k, sum((f.n_convs - 1) * f.n) AS saved_tokens, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM full_ f JOIN path a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY a.k),
ends AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS d
  FROM (SELECT c, k FROM path QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
  CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends.d, sha256('')) AS ends_sha256
FROM full_ f JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN node q ON q.k = f.pk AND q.depth = f.depth - 1
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    turns = prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))
    return prefix_trie.describe(*prefix_trie.build_trie(*prefix_trie.rebuild(turns)))


def planted_loop(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The loop that the query's contract puts into the end of some texts of n words."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), edit=planted_loop)
    # Numbers below 2 ** 26 or so: different exponents differ as doubles, equal ones do not.
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] / x["period"] > y["length"] / y["period"], -1)
                        .when(x["length"] / x["period"] < y["length"] / y["period"], 1)
                        .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int"))
                        .otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                            r["period"].cast("string")), F.lit("\n"))), "")
    top = found.withColumn("_best", F.get(best, F.lit(0)))
    return top.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
