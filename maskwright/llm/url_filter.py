"""URL block and allow rules, in DataFrame functions only.

Every url is expanded into its host suffixes joined with its path prefixes, as the hash lists of safe-browsing
protocols do; the expressions are matched to the rules by an equi-join on a short prefix of their SHA-256, then
full digests are compared, then the longest rule wins. Only host depths and path lengths that some rule has are
expanded, so the number of expressions of a url is bounded by the rules, however long the url is.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets no rule; a url without a
path meets only rules with an empty path; of equally long rules the one with the longer host wins, and of
a rule listed with both verdicts ``block``; null rules are no rules. Repeated urls are judged once and the verdict is joined back, by salts
where urls with a rule are many, since one url may be on a third of the pages; null and repeated page ids are nothing special; an empty table gives an
empty result; other columns are passed through, and the new one is ``filter`` with underscores before it if that is taken.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, column, free_name, materialize, packed, table

#: (verdict, host, path); a rule holds for its host and all subdomains, where the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join is on.
PREFIX = 8
#: Rules are broadcast up to this many (about 150 bytes each); beyond, both sides are shuffled by hash prefix.
BROADCAST_RULES = 50_000
#: Verdicts are broadcast up to this many (a digest and a rule each).
BROADCAST_VERDICTS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def with_digest(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("full", F.sha2(expression, 256)).withColumn("prefix", F.substring("full", 1, PREFIX))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
    broadcast_verdicts: int = BROADCAST_VERDICTS,
) -> DataFrame:
    """pages with one column more, a struct (``filter``): host, path, rule and verdict."""
    listed = with_digest(rules.select("verdict", "host", "path").dropna(), F.concat("host", "path")).select("verdict", "host", "path", "full", "prefix")
    size, depths, lengths = listed.agg(
        F.count("*"), F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))
    ).first()
    host, path = host_and_path(F.col("url"))
    address = F.unhex(F.sha2("url", 256))
    urls = pages.select(column(url_col).alias("url")).filter("url is not null").distinct().select(address.alias("address"), host.alias("h"), path.alias("p"))
    labels = urls.withColumn("labels", F.split("h", "\\."))
    array = lambda xs: F.array(*(F.lit(int(x)) for x in sorted(xs))) if xs else F.array().cast("array<int>")
    hosts = labels.withColumn("depth", F.explode(F.filter(array(depths), lambda d: d <= F.size("labels"))))
    both = hosts.withColumn("cut", F.explode(F.filter(array(lengths), lambda n: n <= F.length("p"))))
    suffix = F.array_join(F.slice("labels", F.size("labels") - F.col("depth") + 1, F.col("depth")), ".")
    expanded = with_digest(both, F.concat(suffix, F.col("p").substr(F.lit(1), F.col("cut")))).select("address", "prefix", "full")
    near = expanded.join(F.broadcast(listed) if size <= broadcast_rules else listed, "prefix").filter(expanded["full"] == listed["full"])
    rank = F.struct(F.length("host") + F.length("path"), F.length("host"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = near.groupBy("address").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), rank).alias("best"))
    best = materialize(best, "verdicts")
    each = pages.select(packed(pages.columns).alias("row"), column(url_col).alias("url"))
    # many pages have the same url, or none: what spreads them is the whole row
    each = each.select("row", host.alias("h"), path.alias("p"), address.alias("address"), F.xxhash64("row").alias("spread"))
    judged = attach(each, best, "address", "spread", broadcast_verdicts)
    verdict = F.struct(F.col("h").alias("host"), F.col("p").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.select("row.*", verdict.alias(free_name(pages, "filter")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "filter.*")


OP7_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS row_id, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), hits AS (
  SELECT p.row_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.row_id = h.row_id AND h.place = 1
"""
