"""URL filters: a blocked Bloom filter in front of an exact hash join (DataFrame functions only).

A list holds canonical addresses of two kinds: `prefix` entries (a host with all its subdomains and a path
prefix) and `page` entries (one host and path). Each distinct (host, path) probes the filter with its host
suffixes and with those path prefixes whose length some entry has; probes that may be listed go to the exact
join, which removes the filter's false positives. The filter has a fixed number of 64-bit blocks, so what is
broadcast is bounded whatever the list's size; a fuller filter only passes more probes to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import lower_ascii

#: The rules of the URL contract (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or where `://` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^([^?#]*)", 1)
    return lower_ascii(host), path


def _bits(*key: Column) -> Column:
    """Four bits of a 64-bit block, from a hash independent of the one that picks the block."""
    h = F.xxhash64(F.lit("bits"), *key)
    mask = F.lit(0).cast("long")
    for i in range(4):
        at = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def _block(blocks: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as (block, held): at most `blocks` rows."""
    key = [F.col(c) for c in ("kind", "host", "prefix")]
    return listed.select(_block(blocks, *key).alias("block"), _bits(*key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("held"))


def judge_urls(df: DataFrame, url: str, listed: DataFrame, default: str = "allow", blocks: int = 1 << 15) -> DataFrame:
    """df with host, path, rule and verdict of each url (columns of these names are replaced).

    listed: kind ('prefix' or 'page'), host, path, verdict. The longest fitting prefix entry wins (of equal length
    the longer host, then 'allow'); where none fits, a page entry decides and rule stays null. Entries with a
    null are void. Null urls and urls without `://` get empty host and path, no rule and the default verdict. Repeated
    rows stay; an empty table gives an empty result; an empty list gives the default everywhere.
    """
    host, path = address(F.col(url))
    out = df.withColumn("__host", host).withColumn("__path", path).drop("host", "path", "rule", "verdict")
    out = out.withColumnsRenamed({"__host": "host", "__path": "path"})
    entries = listed.select("kind", "host", F.col("path").alias("prefix"), "verdict").dropna()
    # Distinct lengths of listed path prefixes: integers up to the longest listed path, a handful in practice.
    lengths = sorted(r[0] for r in entries.where("kind = 'prefix'").select(F.length("prefix")).distinct().collect())
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.flatten(F.transform(hosts, lambda h: F.transform(sizes, lambda n: F.struct(F.lit("prefix").alias("kind"), h.alias("host"), F.substring(F.col("path"), F.lit(1), n).alias("prefix")))))
    page = F.array(F.struct(F.lit("page").alias("kind"), F.col("host").alias("host"), F.col("path").alias("prefix")))
    seen = out.where("host <> '' or path <> ''").select("host", "path").distinct()
    probes = seen.select("host", "path", F.explode(F.concat(prefixes, page)).alias("k"))
    key = [F.col("k.kind"), F.col("k.host"), F.col("k.prefix")]
    probes = probes.withColumn("block", _block(blocks, *key)).withColumn("mask", _bits(*key))
    held = F.broadcast(bloom_blocks(entries, blocks))
    maybe = probes.join(held, "block").where("(held & mask) = mask").select(F.col("host").alias("h"), F.col("path").alias("p"), "k.*")
    rank = F.struct((F.col("kind") == "prefix").alias("prefix"), (F.length("host") + F.length("prefix")).alias("len"), F.length("host").alias("hlen"))
    hits = maybe.join(entries, ["kind", "host", "prefix"]).select("h", "p", rank.alias("rank"), F.when(F.col("kind") == "prefix", F.concat("host", "prefix")).alias("rule"), "verdict")
    best = hits.groupBy("h", "p").agg(F.max_by(F.struct("rule", "verdict"), F.struct("rank", F.col("verdict") == "allow")).alias("won"))
    won = best.select(F.col("h").alias("host"), F.col("p").alias("path"), F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))
    keep = [c for c in out.columns if c not in ("host", "path")]
    return out.join(won, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def contract_list(pages: DataFrame) -> DataFrame:
    """The contract's rules as prefix entries, and as page entries the addresses that only ever gave an empty page."""
    rules = pages.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("kind", "host", "path", "verdict"), ("prefix", *r), strict=True)]) for r in RULES])))
    host, path = address(F.col("url"))
    dead = pages.select(host.alias("host"), path.alias("path"), F.coalesce(F.length(F.trim("html")), F.lit(0)).alias("n")).where("host <> ''")
    dead = dead.groupBy("host", "path").agg(F.max("n").alias("n")).where("n = 0")
    return rules.unionByName(dead.select(F.lit("page").alias("kind"), "host", "path", F.lit("block").alias("verdict")))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the contract's list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    judged = judge_urls(pages.select("page_id", "url"), "url", contract_list(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         coalesce(length(trim(html)), 0) AS n
  FROM pages),
h AS (SELECT page_id, n, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
u AS (
  SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM h),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
pairs AS (SELECT DISTINCT host, path FROM u WHERE host <> ''),
won AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM pairs JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path),
dead AS (SELECT host, path FROM u WHERE host <> '' GROUP BY host, path HAVING max(n) = 0)
SELECT u.page_id, u.host, u.path, won.rule,
       coalesce(won.rv, CASE WHEN dead.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN won ON u.host = won.host AND u.path = won.path
       LEFT JOIN dead ON u.host = dead.host AND u.path = dead.path
"""
