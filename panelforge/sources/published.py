"""Local files against a published tree whose entries are kept in one of two ways: as objects with a digest of framed content, or as links whose target names size and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mode of links in a tree, and the key in a link's target.
LINK, KEY = "120000", r"SHA256E-s(\d+)--([0-9a-f]{64})"


def object_sha1(content: Column) -> Column:
    """SHA-1 of binary content behind its frame: the word blob, the number of bytes, a zero byte."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def verify(local: DataFrame, tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(relpath, in_published, local_exists, storage, match, detail) of every asked relpath.

    local: (relpath, content); tree: (relpath, mode, sha, target), target null but for links. An entry that is absent on either side
    doesn't match; nor does a link without a key. Digests are taken where a file is read; contents are not shuffled.
    """
    have = local.select("relpath", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), object_sha1(F.col("content")).alias("object"))
    size, sha = F.regexp_extract("target", KEY, 1), F.regexp_extract("target", KEY, 2)
    both = asked.select("relpath").join(tree.withColumn("listed", F.lit(True)), "relpath", "left").join(have, "relpath", "left")
    known, there, link = F.col("listed").isNotNull(), F.col("size").isNotNull(), F.col("mode") == LINK
    parsed = F.coalesce(sha != "", F.lit(False))
    match = F.when(~known | ~there, False).when(link, parsed & (F.col("size") == size.try_cast("long")) & (F.col("sha256") == sha)).otherwise(F.col("object") == F.col("sha"))
    detail = F.when(~known | ~there, "").when(link & ~parsed, "key not parsed").when(link, F.concat(F.lit("published sha256="), sha, F.lit(" size="), size)).otherwise(F.concat(F.lit("published object="), F.col("sha")))
    return both.select("relpath", known.alias("in_published"), there.alias("local_exists"), F.when(known & there, F.when(link, "link").otherwise("object")).alias("storage"), match.alias("match"), detail.alias("detail"))
