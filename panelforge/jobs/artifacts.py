"""Jobs on files: tables are written the way the analysis keeps them, read back by the file readers, and checked.

Each query writes to a fresh folder of the shared scratch space and returns what the readers found there. The SQL
beside it computes the expected rows from the tables alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.affine import angle, applied, as_columns, determinant, rigid, rotation
from panelforge.functions.ordering import numbered
from panelforge.functions.shared import materialised
from panelforge.operators.contracts import keyed, require, require_columns, require_finite
from panelforge.sources.adapters import LONG, TABLES, run_sql
from panelforge.sources.files import file_status, gate, inventory, read_tsv
from panelforge.sources.sinks import new_folder, portable, write_files, write_json_lines, write_tsv
from panelforge.sources.statistics import parse_region_statistics, region_statistics
from panelforge.sources.transforms import parse_transforms, world_transforms
from panelforge.sources.volumes import encode_mgh, encode_nifti, gate_report, label_volumes, volumes

#: Documents that one bundle file holds.
BUNDLE = 64


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# ---- delimited text


def scan_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The participant column of a roster file, with each line's place."""
    docs = _table(spark, sf_dir, "documents", "source", "lang").where("source is not null")
    roster = docs.groupBy("source").agg(F.count_distinct("lang").alias("n_langs")).select(F.col("source").alias("participant_id"), "n_langs").orderBy("participant_id").coalesce(1)
    lines = read_tsv(spark, write_tsv(roster, new_folder(spark, "roster")), "participant_id string, n_langs long")
    return numbered(lines.select("participant_id"), "participant_id", name="position")


def scan_manifest_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest file whose comment lines (one a document longer than 1,000 characters) don't count."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = docs.select(F.concat("source", F.lit("/"), "doc_id").alias("relpath"), F.length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    notes = docs.where("length(text) > 1000").select(F.concat(F.lit("# long: "), "doc_id").alias("relpath"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    path = new_folder(spark, "manifest")
    rows.unionByName(notes).select(F.concat_ws("\t", "relpath", "bytes", "sha256").alias("value")).write.text(path)
    return read_tsv(spark, path, "relpath string, bytes long, sha256 string", comment="#", header=False)


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles and awkward strings through a file: every value comes back as it was."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")) / 3)
    lines = lines.withColumn("note", F.when(F.col("l_discount") == 0, "NA").when(F.col("l_discount") > 0.08, "").when(F.col("l_discount") > 0.06, "nan").when(F.col("l_discount") > 0.04, "null"))
    back = read_tsv(spark, write_tsv(lines, new_folder(spark, "lines")), lines.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return require_columns(back, lines.columns, "lines")


def json_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with infinite and undefined numbers as JSON lines, read back as text."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    value = F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_quantity"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"))
    back = spark.read.schema("l_orderkey long, l_linenumber int, l_partkey long, value string").json(write_json_lines(rows, ["value"], new_folder(spark, "json")))
    return back.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("value", F.lit("null")).alias("portable"))


# ---- inventories and gates


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of the documents as text files, a bundle of ids of a source each: relpath like src1/3.txt."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text").where("source is not null and doc_id is not null").withColumn("bundle", F.floor(F.col("doc_id") / BUNDLE))
    most = max(256, 4 * spark.sparkContext.defaultParallelism)  # files are small, and Spark would read some 30 a task
    files = inventory(spark, write_files(docs, ["source", "bundle"], ["doc_id", "text"], "text", new_folder(spark, "bundles"))).coalesce(most)
    part = lambda i: F.regexp_extract("relpath", r"source=([^/]+)/bundle=([^/]+?)([.]txt$|/)", i)
    return files.select(F.concat(part(1), F.lit("/"), part(2), F.lit("."), "kind").alias("relpath"), "bytes", "sha256", "kind", part(1).alias("source"))


_BUNDLES = f"""b AS (
  SELECT concat(source, '/', CAST(doc_id // {BUNDLE} AS VARCHAR), '.txt') AS relpath, source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes,
         sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text)) AS sha256, count(CASE WHEN text LIKE '%!!%' THEN 1 END) AS shouts
  FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source, doc_id // {BUNDLE})"""


def inventory_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles(spark, sf_dir).groupBy("source", "kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as a manifest file, read back."""
    path = write_tsv(bundles(spark, sf_dir).select("relpath", "bytes", "sha256"), new_folder(spark, "manifest"))
    return read_tsv(spark, path, "relpath string, bytes long, sha256 string")


def _listed(local: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release's manifest of the bundles: where texts shout, it lists another digest; it also lists paths that climb out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    loud = docs.where("text like '%!!%'").select(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / BUNDLE), F.lit(".txt")).alias("relpath")).distinct().withColumn("loud", F.lit(True))
    rows = local.select("relpath", "bytes", "sha256").join(loud, "relpath", "left")
    rows = rows.select("relpath", "bytes", F.when(F.col("loud"), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return rows.unionByName(rows.select(F.concat(F.lit("../"), "relpath").alias("relpath"), "bytes", "sha256"))


def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the manifest lists with the same size and digest; the local side also shows climbing and absolute paths."""
    local = materialised(bundles(spark, sf_dir).select("relpath", "bytes", "sha256"))
    listed = read_tsv(spark, write_tsv(_listed(local, spark, sf_dir), new_folder(spark, "listed")), "relpath string, bytes long, sha256 string")
    seen = local
    for way in ("../", "/"):
        seen = seen.unionByName(local.select(F.concat(F.lit(way), "relpath").alias("relpath"), "bytes", "sha256"))
    return gate(listed, seen).select("relpath", "bytes")


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every listed file: OK, MISMATCH, or MISSING."""
    local = materialised(bundles(spark, sf_dir).select("relpath", "bytes", "sha256"))
    return file_status(_listed(local, spark, sf_dir), local)


# ---- statistics texts


def _statistics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statistics texts of each region and half (of order lines: even and odd positions), and the roster of brands."""
    lines = "SELECT r_name AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemi, p_brand AS structure, avg(l_quantity) AS thick, sum(l_extendedprice) AS area FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3"
    cells = materialised(run_sql(spark, sf_dir, lines))
    row = F.concat_ws(" ", "structure", F.lit("7"), F.col("area").cast("string"), F.lit("0"), F.col("thick").cast("string"))
    heads = ["# Table of statistics", "# subjectname {s}", "# hemi {h}", "# AnnotationFile ../label/{h}.aparc.annot", "# cmdline stats -a {s} {h} white", "# hemi other",
             "# TableCol 1 ColHeader StructName", "# TableCol 1 Units NA", "# TableCol 3 ColHeader SurfArea", "# TableCol 3 Units mm^2", "# TableCol 5 ColHeader ThickAvg", "# TableCol 5 Units mm",
             "# ColHeaders StructName NumVert SurfArea GrayVol ThickAvg"]
    head = F.lit("\n".join(heads))
    text = F.concat(F.replace(F.replace(head, F.lit("{s}"), F.col("subject")), F.lit("{h}"), F.col("hemi")), F.lit("\n"), F.array_join(F.array_sort("rows"), "\n"), F.lit("\n"))
    texts = cells.groupBy("subject", "hemi").agg(F.collect_list(row).alias("rows")).select("subject", "hemi", text.alias("text"))  # a line a brand
    roster = cells.select("hemi", "structure").distinct().withColumn("roi", F.concat("hemi", F.lit("."), "structure"))
    return texts, materialised(numbered(roster, "hemi", "structure", name="ord"))


def stats_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region statistics of all texts, under the contract that no text has a fault."""
    texts, roster = _statistics(spark, sf_dir)
    rows = region_statistics(texts, roster)
    return rows.select("subject", "hemi", "roi", "ord", F.round("thickness", 6).alias("thickness"), F.round("area", 4).alias("area"))


def stats_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser says of texts with a fault; which one hangs on the region."""
    texts, roster = _statistics(spark, sf_dir)
    last = F.regexp_extract("text", r"\n([^\n]+)\n$", 1)
    swapped = (
        F.when(F.col("subject") == "AFRICA", F.regexp_replace("text", "subjectname ", "subjectname x"))
        .when(F.col("subject") == "AMERICA", F.regexp_replace("text", r"Units mm\^2", "Units cm^2"))
        .when(F.col("subject") == "ASIA", F.concat("text", last, F.lit("\n")))
        .when(F.col("subject") == "EUROPE", F.concat(F.substring("text", F.lit(1), F.length("text") - F.length(last) - F.lit(1)), F.lit("nowhere 7 1 0 1\n")))
        .otherwise(F.concat(F.substring("text", F.lit(1), F.length("text") - F.length(last) - F.lit(1)), F.regexp_replace(last, r"^(\S+ \S+) \S+", "$1 -1.0"), F.lit("\n")))
    )
    rows = parse_region_statistics(texts.select("subject", "hemi", swapped.alias("text")), roster)
    return rows.where("problem is not null").groupBy("subject", "problem").agg(F.count("*").alias("n"))


# ---- volumes


def _volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each vector as a 4 x 4 x 4 volume, by its label as gzipped NIfTI or MGH, and its positive octants as a label volume."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where("size(v) = 64")
    octant = 1001 + np.add.outer(np.add.outer(4 * (np.arange(4) // 2), 2 * (np.arange(4) // 2)), np.arange(4) // 2)

    def encode(parts):
        for part in parts:
            out = []
            for scan, label, v in part.itertuples(index=False):
                a = np.reshape(v, (4, 4, 4)).astype(np.float32)
                affine = np.array([[2.0, 0, 0, -3], [0, 2, 0, -3], [0, 0, 2, -3 - label % 2], [0, 0, 0, 1]])
                out.append((f"{scan}/map.nii.gz", encode_nifti(a, affine)) if label % 2 else (f"{scan}/map.mgz", encode_mgh(a, affine)))
                out.append((f"{scan}/labels.mgz", encode_mgh(np.where(a > 0, octant, 0).astype(np.int32), affine)))
            yield pd.DataFrame(out, columns=["path", "content"])

    path = new_folder(spark, "volumes")
    vectors.select("vec_id", "label", "v").mapInPandas(encode, "path string, content binary").write.parquet(path)
    return spark.read.parquet(path)


def volume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, origin and values' sums of every volume file."""
    scans = volumes(_volume_files(spark, sf_dir))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return scans.select("path", "format", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.round(F.get("affine", F.lit(11)), 6).alias("origin_z"), F.round(total, 5).alias("total"), F.round(F.array_max("values"), 6).alias("greatest_"))


def integer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_report(volumes(_volume_files(spark, sf_dir)))


def label_grid_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels by label on each distinct grid; a label volume that isn't one would raise."""
    labels = label_volumes(volumes(_volume_files(spark, sf_dir).where(F.endswith("path", F.lit("labels.mgz")))))
    grids = labels.groupBy("shape", "affine").agg(F.count("*").alias("scans"))
    voxels = labels.select("shape", "affine", F.explode("labels").alias("label")).groupBy("shape", "affine", "label").agg(F.count("*").alias("voxels"))
    return voxels.join(grids, ["shape", "affine"]).select(F.round(F.get("affine", F.lit(11)), 6).alias("origin_z"), "scans", "label", "voxels")


# ---- transforms

#: Angles and shifts of an event's transform, from its value; the SQL has the same.
_ANGLES = {"rx": "value % 30 - 15", "ry": "value % 17 - 8", "rz": "value % 11"}
_SHIFT, _CENTRE = ("value % 7", "value % 5 - 2", "value % 3"), (1.5, 1.25, -0.5)


def _rigid_of(events: DataFrame):
    r = rotation(*[F.expr(_ANGLES[a]) for a in ("rx", "ry", "rz")])
    return rigid(r, [F.expr(s) for s in _SHIFT], [F.lit(c) for c in _CENTRE])


def rigid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigid transforms about three axes and a centre."""
    events = _table(spark, sf_dir, "events", "event_id", "value")
    return events.select("event_id", *as_columns(_rigid_of(events), 6))


def rigid_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle, determinant and displacement of a point under each transform."""
    events = _table(spark, sf_dir, "events", "event_id", "value")
    flat = events.select("event_id", *as_columns(_rigid_of(events)))
    m = [[F.col(f"m{i}{j}") for j in range(4)] for i in range(3)]
    point = [F.lit(c) for c in (2.0, -1.0, 0.5)]
    moved = [b - a for a, b in zip(point, applied(m, point), strict=True)]
    return flat.select("event_id", F.round(angle(m), 4).alias("angle"), F.round(determinant(m), 6).alias("det"), F.round(F.sqrt(sum((d * d for d in moved), F.lit(0.0))), 6).alias("displacement"))


def _transform_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the events' transforms: clicks as voxel-to-voxel, errors of a kind that isn't known, the rest in world coordinates."""
    from panelforge.functions.affine import compose, inverse, vox2ras

    lit = lambda xs: [F.lit(float(x)) for x in xs]
    side = {"src": ((4, 4, 4), (2, 2, 2), ((-1, 0, 0), (0, 0, -1), (0, 1, 0)), (0.5, -1, 2)), "dst": ((8, 6, 8), (1, 1.5, 1), ((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0, 3, -2.5))}
    geometry = {k: vox2ras(lit(d), lit(v), [[F.lit(float(c[j][i])) for j in range(3)] for i in range(3)], lit(o)) for k, (d, v, c, o) in side.items()}
    events = _table(spark, sf_dir, "events", "event_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 14).otherwise(1)
    events = events.select("event_id", kind.alias("kind"), *as_columns(_rigid_of(events)))
    m = [[F.col(f"m{i}{j}") for j in range(4)] for i in range(3)]
    inside = compose(inverse(geometry["dst"]), compose(m, geometry["src"]))
    rows = [F.concat_ws(" ", *[F.when(F.col("kind") == 0, b).otherwise(a).cast("string") for a, b in zip(x, y, strict=True)]) for x, y in zip(m, inside, strict=True)]
    words = lambda xs: " ".join(str(float(x)) for x in xs)
    blocks = "".join(
        f"{k} volume info\nvalid = 1  # volume info valid\nfilename = {k}.mgz\nvolume = {' '.join(map(str, d))}\nvoxelsize = {words(v)}\n" + "".join(f"{n} = {words(a)}\n" for n, a in zip(("xras", "yras", "zras"), c, strict=True)) + f"cras = {words(o)}\n"
        for k, (d, v, c, o) in side.items()
    )
    text = F.concat(F.lit("type      = "), F.col("kind").cast("string"), F.lit(" # kind\nnxforms   = 1\nmean      = 0.0 0.0 0.0\nsigma     = 1.0\n1 4 4\n"), F.concat_ws("\n", *rows, F.lit("0.0 0.0 0.0 1.0")), F.lit("\n" + blocks))
    path = new_folder(spark, "transforms")
    events.select("event_id", text.alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def lta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texts say: kind, first matrix row of world transforms, geometry of both sides."""
    parsed = parse_transforms(_transform_texts(spark, sf_dir))
    first = lambda i: F.round(F.when(F.col("kind") != 0, F.get("matrix", F.lit(i))), 6).alias(f"m0{i}")
    text = lambda field: F.array_join(F.transform(field, lambda x: (x * 2).cast("long").cast("string")), " ")
    return parsed.select("event_id", "kind", *[first(i) for i in range(4)], text("src.cras").alias("src_cras2"), text("dst.volume").alias("dst_volume2"))


def lta_ras2ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World transforms of all texts, whatever their kind; null for the unknown one."""
    found = world_transforms(parse_transforms(_transform_texts(spark, sf_dir)), "event_id")
    return found.select("event_id", "kind", *[(F.round(f"m{i}{j}", 6) + 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(4)])


def vox2ras_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel-to-world matrices of the parts: size and turn from the part's size, centre from its price."""
    from panelforge.functions.affine import vox2ras

    turn = rotation(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"))
    m = vox2ras([F.lit(4.0), F.col("p_size").cast("double"), F.lit(6.0)], [F.lit(2.0), F.lit(1.0), F.col("p_size") / 10.0], turn, [F.col("p_retailprice"), F.lit(0.0), F.lit(-1.0)])
    return _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", *as_columns(m, 5))


# ---- schemas and the saved panel

#: The long table of regions instead of nations, whose cells are complete at every scale.
REGION_LONG = LONG.changed(("c_nationkey AS subject", "n_regionkey AS subject"))


def schema_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table's columns in order, their kind, and whether they are of an integer type (no data is read)."""
    kinds = {T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.DoubleType: "double", T.StringType: "string", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.ArrayType: "list"}
    rows = []
    for name in TABLES:
        fields = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema.fields
        rows += [(name, i, f.name, kinds.get(type(f.dataType), "other"), isinstance(f.dataType, T.IntegralType)) for i, f in enumerate(fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, name string, kind string, integral boolean")


def long_table_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table under its contract (raises where broken): complete keys in canonical order, value rules."""
    long = materialised(run_sql(spark, sf_dir, f"WITH {REGION_LONG} SELECT subject, roi, thickness, area, ln_area, cond_a, cond_n, cond_r, cond_mean FROM long_table"))
    rois = numbered(long.select("roi").distinct(), "roi", name="roi_index")
    want = run_sql(spark, sf_dir, "SELECT r_regionkey AS subject, r_name FROM region").join(long.select("subject").distinct(), "subject").crossJoin(F.broadcast(rois))
    require_finite(long, ["thickness"], "long table")
    require(long, "long table", area=~(F.col("area") > 0), ln=F.col("ln_area") != F.ln("area"), negative=F.least("cond_a", "cond_n", "cond_r") < 0, mean=F.col("cond_mean") != (F.col("cond_a") + F.col("cond_n") + F.col("cond_r")) / 3)
    return keyed(long, want, ["subject", "roi"], "long table").select("r_name", "roi", "roi_index", F.round("thickness", 6).alias("thickness"), F.round(F.col("cond_mean") + 3.7e-12, 9).alias("cond_mean"))


def lambda_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties from texts of the tables: the literal inf or a finite number not below zero; all else is rejected."""
    texts = run_sql(spark, sf_dir, _LAMBDA_TEXTS.replace("VARCHAR", "STRING"))
    number = F.when(F.col("v").rlike(r"^[0-9]+([.][0-9]+)?$"), F.col("v").try_cast("double"))
    lam = F.when(F.col("v") == "inf", F.lit(float("inf"))).otherwise(number)
    return texts.select("v", portable(lam).alias("lam"), lam.isNull().alias("rejected"))


_LAMBDA_TEXTS = """SELECT DISTINCT v FROM (SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) FROM customer
  UNION ALL SELECT event_type FROM events UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'inf' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'nan' WHEN 3 THEN 'true' ELSE '-inf' END FROM region) t"""


def camel_to_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts in camel case, and back to snake case."""
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    camel = F.regexp_replace(F.initcap(F.concat_ws(" ", "p_name", "p_type")), " ", "")
    return parts.select("p_partkey", camel.alias("camel"), F.lower(F.regexp_replace(camel, "(?<!^)(?=[A-Z])", "_")).alias("snake"))


_TRIG = f"""a AS (SELECT event_id, event_type, cos(radians({_ANGLES['rx']})) AS cx, sin(radians({_ANGLES['rx']})) AS sx, cos(radians({_ANGLES['ry']})) AS cy, sin(radians({_ANGLES['ry']})) AS sy,
  cos(radians({_ANGLES['rz']})) AS cz, sin(radians({_ANGLES['rz']})) AS sz, {_SHIFT[0]} AS tx, {_SHIFT[1]} AS ty, {_SHIFT[2]} AS tz FROM events),
r AS (SELECT event_id, event_type, tx, ty, tz, cz * cy AS r00, cz * sy * sx - sz * cx AS r01, cz * sy * cx + sz * sx AS r02, sz * cy AS r10, sz * sy * sx + cz * cx AS r11, sz * sy * cx - cz * sx AS r12,
  -sy AS r20, cy * sx AS r21, cy * cx AS r22 FROM a),
m AS (SELECT *, {', '.join(f'{_CENTRE[i]} - (r{i}0 * {_CENTRE[0]} + r{i}1 * {_CENTRE[1]} + r{i}2 * {_CENTRE[2]}) + {t} AS r{i}3' for i, t in enumerate(('tx', 'ty', 'tz')))} FROM r)"""
_M = ", ".join(f"round(r{i}{j}, 6) AS m{i}{j}" for i in range(3) for j in range(4))

#: name -> (job, SQL of what it must give)
QUERIES = {
    "scan_roster": (scan_roster, "SELECT source AS participant_id, row_number() OVER (ORDER BY source) - 1 AS position FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) t"),
    "scan_manifest_comments": (scan_manifest_comments, "SELECT concat(source, '/', CAST(doc_id AS VARCHAR)) AS relpath, CAST(length(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents"),
    "tsv_round_trip": (tsv_round_trip, """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) / 3 AS net,
  CASE WHEN l_discount = 0 THEN 'NA' WHEN l_discount > 8e-2 THEN '' WHEN l_discount > 6e-2 THEN 'nan' WHEN l_discount > 4e-2 THEN 'null' END AS note FROM lineitem"""),
    "json_portable": (json_portable, "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 'inf' WHEN l_tax = 0 THEN 'null' ELSE CAST(l_quantity AS VARCHAR) END AS portable FROM lineitem"),
    "inventory_by_type": (inventory_by_type, f"WITH {_BUNDLES} SELECT source, 'txt' AS kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY source"),
    "source_manifest": (source_manifest, f"WITH {_BUNDLES} SELECT relpath, bytes, sha256 FROM b"),
    "source_gate": (source_gate, f"WITH {_BUNDLES} SELECT relpath, bytes FROM b WHERE shouts = 0"),
    "source_status": (source_status, f"WITH {_BUNDLES} SELECT relpath, CASE WHEN shouts > 0 THEN 'MISMATCH' ELSE 'OK' END AS status FROM b UNION ALL SELECT concat('../', relpath), 'MISSING' FROM b"),
    "stats_parse": (stats_parse, """WITH c AS (SELECT r_name AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemi, p_brand, avg(l_quantity) AS thickness, sum(l_extendedprice) AS area
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3),
o AS (SELECT hemi, p_brand, row_number() OVER (ORDER BY hemi, p_brand) - 1 AS ord FROM (SELECT DISTINCT hemi, p_brand FROM c) t)
SELECT subject, c.hemi, concat(c.hemi, '.', c.p_brand) AS roi, ord, round(thickness, 6) AS thickness, round(area, 4) AS area FROM c JOIN o ON o.hemi = c.hemi AND o.p_brand = c.p_brand"""),
    "stats_faults": (stats_faults, """WITH s AS (SELECT DISTINCT r_name AS subject, l_linenumber % 2 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
f AS (SELECT * FROM (VALUES ('AFRICA', 'header mismatch'), ('AMERICA', 'units of SurfArea'), ('ASIA', 'repeated region'), ('EUROPE', 'unknown region'), ('EUROPE', 'missing region'), ('MIDDLE EAST', 'area not positive')) AS t(r, problem))
SELECT subject, problem, count(*) AS n FROM s JOIN f ON r = subject GROUP BY subject, problem"""),
    "volume_scan": (volume_scan, """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT concat(vec_id, '/map.', CASE WHEN label % 2 = 1 THEN 'nii.gz' ELSE 'mgz' END) AS path, CASE WHEN label % 2 = 1 THEN 'nifti' ELSE 'mgh' END AS format, '4x4x4' AS shape, round(-3e0 - label % 2, 6) AS origin_z,
       round(list_sum(e), 5) AS total, round(list_max(e), 6) AS greatest_ FROM v
UNION ALL SELECT concat(vec_id, '/labels.mgz'), 'mgh', '4x4x4', round(-3e0 - label % 2, 6),
       CAST(list_sum([CASE WHEN e[i] > 0 THEN 1001 + (i - 1) // 32 * 4 + (i - 1) % 16 // 8 * 2 + (i - 1) % 4 // 2 ELSE 0 END for i in range(1, 65)]) AS DOUBLE),
       CAST(list_max([CASE WHEN e[i] > 0 THEN 1001 + (i - 1) // 32 * 4 + (i - 1) % 16 // 8 * 2 + (i - 1) % 4 // 2 ELSE 0 END for i in range(1, 65)]) AS DOUBLE) FROM v"""),
    "integer_gate": (integer_gate, """SELECT concat(vec_id, '/map.', CASE WHEN label % 2 = 1 THEN 'nii.gz' ELSE 'mgz' END) AS path, 3 AS n_dims, CAST(len(list_filter(embedding, lambda x: x <> floor(x))) AS INTEGER) AS n_fractional, len(list_filter(embedding, lambda x: x <> floor(x))) = 0 AS is_label_volume FROM embeddings
UNION ALL SELECT concat(vec_id, '/labels.mgz'), 3, 0, true FROM embeddings"""),
    "label_grid_cache": (label_grid_cache, """WITH x AS (SELECT round(-3e0 - label % 2, 6) AS origin_z, vec_id, CASE WHEN embedding[i] > 0 THEN CAST(1001 + (i - 1) // 32 * 4 + (i - 1) % 16 // 8 * 2 + (i - 1) % 4 // 2 AS INTEGER) ELSE 0 END AS label FROM embeddings, range(1, 65) t(i)),
g AS (SELECT origin_z, count(DISTINCT vec_id) AS scans FROM x GROUP BY origin_z)
SELECT x.origin_z, max(scans) AS scans, label, count(*) AS voxels FROM x JOIN g ON g.origin_z = x.origin_z GROUP BY x.origin_z, label"""),
    "rigid_matrix": (rigid_matrix, f"WITH {_TRIG} SELECT event_id, {_M} FROM m"),
    "rigid_deviation": (rigid_deviation, f"""WITH {_TRIG} SELECT event_id, round(degrees(acos(least(greatest((r00 + r11 + r22 - 1) / 2, -1), 1))), 4) AS angle, 1e0 AS det,
  round(sqrt(pow(2 * r00 - r01 + r02 / 2 + r03 - 2, 2) + pow(2 * r10 - r11 + r12 / 2 + r13 + 1, 2) + pow(2 * r20 - r21 + r22 / 2 + r23 - 5e-1, 2)), 6) AS displacement FROM m"""),
    "lta_parse": (lta_parse, f"""WITH {_TRIG} SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 14 ELSE 1 END AS kind, {', '.join(f"round(CASE WHEN event_type <> 'click' THEN r0{j} END, 6) AS m0{j}" for j in range(4))}, '1 -2 4' AS src_cras2, '16 12 16' AS dst_volume2 FROM m"""),
    "lta_ras2ras": (lta_ras2ras, f"""WITH {_TRIG} SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 14 ELSE 1 END AS kind, {', '.join(f"round(CASE WHEN event_type <> 'error' THEN r{i}{j} END, 6) + 0e0 AS m{i}{j}" for i in range(3) for j in range(4))} FROM m"""),
    "vox2ras": (vox2ras_rows, """SELECT p_partkey, round(2 * cos(radians(p_size)), 5) AS m00, round(-sin(radians(p_size)), 5) AS m01, 0e0 AS m02, round(p_retailprice - 4 * cos(radians(p_size)) + sin(radians(p_size)) * p_size / 2e0, 5) AS m03,
  round(2 * sin(radians(p_size)), 5) AS m10, round(cos(radians(p_size)), 5) AS m11, 0e0 AS m12, round(-4 * sin(radians(p_size)) - cos(radians(p_size)) * p_size / 2e0, 5) AS m13, 0e0 AS m20, 0e0 AS m21, round(p_size / 1e1, 5) AS m22, round(-1 - 3 * p_size / 1e1, 5) AS m23 FROM part"""),
    "schema_exact": (schema_exact, """SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name AS name,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type LIKE '%[]' THEN 'list' ELSE 'other' END AS kind,
  data_type IN ('BIGINT', 'INTEGER', 'SMALLINT') AS integral FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")"),
    "long_table_contract": (long_table_contract, """WITH c AS (SELECT r_name, p_brand AS roi, l_returnflag, avg(l_extendedprice * l_discount / 1000) AS m, sum(l_quantity) AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3)
SELECT r_name, roi, dense_rank() OVER (ORDER BY roi) - 1 AS roi_index, round(sum(q) / sum(n), 6) AS thickness, round(sum(m) / 3 + 3.7e-12, 9) AS cond_mean FROM c GROUP BY r_name, roi"""),
    "lambda_parse": (lambda_parse, f"""SELECT v, CASE WHEN v = 'inf' THEN '"inf"' WHEN regexp_full_match(v, '[0-9]+([.][0-9]+)?') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE 'null' END AS lam, v <> 'inf' AND NOT regexp_full_match(v, '[0-9]+([.][0-9]+)?') AS rejected FROM ({_LAMBDA_TEXTS}) t"""),
    "camel_to_snake": (camel_to_snake, """SELECT p_partkey, concat(upper(p_name[1]), lower(split_part(p_name, ' ', 1)[2:]), upper(split_part(p_name, ' ', 2)[1]), lower(split_part(p_name, ' ', 2)[2:]), upper(p_type[1]), lower(p_type[2:])) AS camel,
  lower(concat(replace(p_name, ' ', '_'), '_', replace(p_type, ' ', '_'))) AS snake FROM part"""),
}
