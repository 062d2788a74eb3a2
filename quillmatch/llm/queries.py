"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lmscore, media, minhash, tokenstore, toxicity, urlfilter, warc
from .common import cut, result_path, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.process(media.rasters(table(spark, sf_dir, "embeddings")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files and reads their response records again."""
    spark.dataSource.register(warc.Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = result_path(spark, "warc")
    table(spark, sf_dir, "pages").select("page_id", "url", "html").write.format("warc").mode("append").save(path)
    found = spark.read.format("warc").load(path).filter("type = 'response' AND status = 200")
    return found.select("page_id", F.col("uri").alias("url"), F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.apply(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them as a loader would: the range of doc_ids from the metadata,
    without a page of tokens, and the tokens of that range, beside those of rows without doc_id."""
    manifest = cut(tokenstore.write(table(spark, sf_dir, "documents"), result_path(spark, "tokens")))
    names = tokenstore.files(manifest)
    low, high = tokenstore.read_metadata(spark, names).agg(F.min("doc_id"), F.max("doc_id")).first()
    ranged = tokenstore.read_tokens(spark, names, low or 0, high or 0)
    return ranged.unionByName(tokenstore.read(spark, names).filter("doc_id IS NULL")).select("doc_id", "lang", "n_tokens", "tokens")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_media, op3_warc, op4_minhash_near_dedup, op5_lm_scoring, op6_url_filter, op7_toxicity, op8_language_id, op9_token_output, op10_decontamination)
}
#: Rules whose expressions are written otherwise than in their canonical form.
_CANONICAL = {10: "therti.example.net/fr/", 11: "blog.tionsh.example.com/en/5485/", 14: "tiontion.example.net/"}
_RULES = ", ".join(f"({i}, '{_CANONICAL.get(i, e)}', '{a}', {p})" for i, e, a, p in urlfilter.DEFAULT_RULES)

ORACLE: dict[str, str] = {
    "op3_warc": "SELECT page_id, url, octet_length(encode(html)) AS bytes, md5(html) AS digest FROM pages WHERE html IS NOT NULL",
    # A URL is under an expression if its host is the expression's or ends with a dot and it, and its path begins with
    # the expression's path where that is a directory, or is it, with or without the query. Tables have no dot segments.
    "op6_url_filter": f"""
WITH listed(rule_id, expression, action, priority) AS (VALUES {_RULES}),
rules AS (SELECT *, split_part(expression, '/', 1) AS h, substr(expression, strpos(expression, '/')) AS t FROM listed),
parts AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bare, regexp_extract(url, '([?][^#]*)', 1) AS q FROM pages WHERE url IS NOT NULL),
whole AS (SELECT url, host, q, CASE WHEN bare = '' THEN '/' ELSE bare END AS path FROM parts),
met AS (
  SELECT url, r.rule_id, r.action, row_number() OVER (PARTITION BY url ORDER BY priority DESC, length(expression) DESC, action = 'allow' DESC, rule_id) AS n
  FROM whole JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND (path = t OR path || q = t OR ends_with(t, '/') AND starts_with(path, t)))
SELECT page_id, p.url, rule_id, coalesce(action, 'allow') AS action FROM pages p LEFT JOIN met ON p.url = met.url AND n = 1""",
}
