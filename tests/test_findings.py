"""What reviews found, one test a finding."""

from pathlib import Path

import duckdb
import pytest


def test_exceedance_takes_each_mean_once(spark, tmp_path, capsys):
    """Two sums of the same rows may differ in their last bits, so no mean is taken twice; regions without A, null regions and null conditions as in the SQL."""
    from pyspark.sql import functions as F

    from panelforge.jobs.catalog import CATALOG

    root, (run, sql) = str(tmp_path), CATALOG["exceedance"]
    spark.createDataFrame([(i, i % 5) for i in range(25)], "n_nationkey long, n_regionkey long").write.parquet(f"{root}/nation.parquet")
    spark.range(500).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).write.parquet(f"{root}/customer.parquet")
    spark.range(200).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("b"), F.col("id") % 7)).alias("p_brand")).write.parquet(f"{root}/part.parquet")
    spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey")).write.parquet(f"{root}/orders.parquet")
    flag = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("l_partkey") % 7 == 3, "R").otherwise(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")))
    lines = spark.range(4000).withColumn("l_partkey", F.xxhash64("id", F.lit(1)) % 100 + 100).select(
        (F.xxhash64("id") % 2500 + 2500).alias("l_orderkey"), "l_partkey", flag.alias("l_returnflag"),
        (F.exp(F.abs(F.xxhash64("id", F.lit(2)) % 3500) / 100.0)).alias("l_extendedprice"), F.lit(0.07).alias("l_discount"), F.lit(1.0).alias("l_quantity"),
    )
    lines.repartition(4).write.parquet(f"{root}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet/*.parquet'")
    want = sorted(duck.execute(sql).fetchall())
    got = run(spark, root)
    assert sorted(tuple(x) for x in got.select("roi", "k", "b").collect()) == want and len(want) == 5
    got.explain()
    assert capsys.readouterr().out.count("FileScan parquet") == 5  # a table each: nothing is summed twice


def test_lines_digest_has_the_levels_of_its_sql(spark, small):
    """With more than fan * fan lines, the level over the leaves is several nodes and no third level follows."""
    from panelforge.functions.digests import FAN
    from panelforge.jobs.inventories import QUERIES

    run, sql = QUERIES["lines_digest"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{small}/lineitem.parquet'")
    want = sorted(duck.execute(sql.replace(str(FAN), "50")).fetchall())
    assert len([x for x in want if x[0] == 1]) > 1
    assert sorted(tuple(x) for x in run(spark, small, fan=50).select("level", "node", "n", "sha256").collect()) == want


def test_alignment_searches_in_few_jobs(spark):
    """The bounded search is a pass over the scans, not a round of jobs for each of its 21 lines."""
    import numpy as np

    from panelforge.functions.alignment import Alignment

    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=27).tolist(), r.normal(size=27).tolist(), [1.0, 1.0, 1.0]) for i in range(9)]
    alignment = Alignment(spark.createDataFrame(rows, "scan long, values array<double>, anatomy array<double>, centre array<double>"), (3, 3, 3), 4)
    spark.sparkContext.setJobGroup("search", "search")
    try:
        best = alignment.optimum(1.0, 10.0).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("search")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(b.scan for b in best) == list(range(9)) and {b.evaluations for b in best} == {1 + 21 * 12} and all(b.best >= b.header for b in best)


def test_the_direction_that_gained_most_is_replaced():
    """Not the first one, as when all gains were kept as 0."""
    import numpy as np

    from panelforge.functions.alignment import search

    asked = []

    def score(m):
        asked.append(m.reshape(*m.shape[:2], 3, 4)[0, :, :, 3])
        return 9.0 - (asked[-1][:, 2][None] - 1.3) ** 2 - 0.1 * np.abs(m[..., 0] - 1)  # turns lose, only the third shift gains

    search(score, np.zeros((1, 3)), [2.0] * 3 + [20.0] * 3, 600)
    first, third = asked[8], asked[10]  # the second sweep's first and third lines
    assert np.ptp(first[:, 0]) == 2 and np.ptp(first[:, 2]) == 0 and 0 < np.ptp(third[:, 2]) < 2


#: Queries on bundles of documents as files.
BUNDLED = ["source_manifest", "source_gate", "source_status", "inventory_by_type"]


@pytest.mark.parametrize("name", BUNDLED)
def test_bundles_are_files_of_few_folders(spark, tmp_path, name):
    """A folder a source, not one a file: folders are listed and made one by one, and there is a file for every 64 ids of a source."""
    from pyspark.sql import functions as F

    from panelforge.functions.shared import scratch_dir
    from panelforge.jobs.artifacts import QUERIES

    text = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 300 == 7, "loud!!").when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.lit("a\nü"), "id"))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 < 39, F.concat(F.lit("src "), F.col("id") % 3)).alias("source"), text.alias("text"))
    docs.unionByName(docs.where("doc_id < 5")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")  # a few ids twice
    before = set(Path(scratch_dir(spark)).glob("bundles-*"))
    run, sql = QUERIES[name]
    got = run(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = duck.execute(sql)
    assert sorted(tuple(x) for x in got.select(*[c[0] for c in cursor.description]).collect()) == sorted(cursor.fetchall())
    (root,) = set(Path(scratch_dir(spark)).glob("bundles-*")) - before
    below = list(root.rglob("*"))
    assert len([p for p in below if p.is_dir()]) == 3 and len([p for p in below if p.is_file()]) == 3 * 79


def test_files_of_keys(spark, tmp_path):
    """As write_texts names and fills them, but the last key names the file; nothing half written is left, and a root with a scheme is the same root."""
    from panelforge.sources.files import inventory
    from panelforge.sources.sinks import write_files, write_texts

    rows = [("a/b", "x y", 1, "1"), ("a/b", "x y", 2, None), ("a/b", "z", 1, "é\n"), ("é%", None, 3, ""), (None, "", 0, "q"), ("", None, 1, "w"), ("{[^]}", "nii.gz", 1, "r"), ("é%", "z", 7, "s" * 99999)]
    df = spark.createDataFrame(rows, "k string, m string, n int, t string").repartition(3)
    root = write_files(df, ["k", "m"], ["n"], "t", str(tmp_path / "files"))
    got = {x.relpath: (x.bytes, x.sha256) for x in inventory(spark, root).collect()}
    want = {x.relpath.rsplit("/", 1)[0] + ".txt": (x.bytes, x.sha256) for x in inventory(spark, write_texts(df.where("k <> ''"), ["k", "m"], ["n"], "t", str(tmp_path / "texts"))).collect()}
    assert got.pop("k=__HIVE_DEFAULT_PARTITION__/m=__HIVE_DEFAULT_PARTITION__.txt")[0] == 4 and got == want and len(want) == 5
    assert not [p for p in Path(root).rglob(".*")]
    assert {x.relpath for x in inventory(spark, "file://" + root).collect()} - {*want} == {"k=__HIVE_DEFAULT_PARTITION__/m=__HIVE_DEFAULT_PARTITION__.txt"}
    assert inventory(spark, write_files(df.limit(0), ["k", "m"], ["n"], "t", str(tmp_path / "none"))).count() == 0
    with pytest.raises(FileExistsError):
        write_files(df, ["k", "m"], ["n"], "t", root)


def test_bundles_where_no_file_system_is_mounted(spark, small, monkeypatch):
    """Then Spark writes them, a folder a file, and the query reads the same."""
    from panelforge.jobs.artifacts import QUERIES
    from panelforge.sources import sinks

    monkeypatch.setattr(sinks, "qualified", lambda spark, path: "other:" + path)
    run, sql = QUERIES["source_manifest"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(tuple(x) for x in run(spark, small).select("relpath", "bytes", "sha256").collect()) == sorted(duck.execute(sql).fetchall())
