"""Contracts raise and never repair; files become tables without inference."""

import hashlib

import pytest
from pyspark.sql import functions as F

from panelforge.operators.contracts import ContractError, key_report, keyed, require_columns, require_counts, require_finite
from panelforge.sources.files import file_status, gate, inventory, parse_statistics, read_tsv


def test_keys_fail_closed(spark):
    want = spark.createDataFrame([("s1", "a", 0), ("s1", "b", 1), ("s2", "a", 2), ("s2", "b", 3)], "s string, r string, ord int")
    good = spark.createDataFrame([("s2", "b", 4.0), ("s1", "a", 1.0), ("s2", "a", 3.0), ("s1", "b", 2.0)], "s string, r string, v double")
    assert [r.v for r in keyed(good, want, ["s", "r"], "t").orderBy("ord").collect()] == [1.0, 2.0, 3.0, 4.0]
    for bad, name in ((good.where("v < 4"), "missing"), (good.union(good.limit(1)), "duplicate"), (good.union(spark.createDataFrame([("s9", "a", 0.0)], good.schema)), "extra")):
        assert key_report(bad, want, ["s", "r"])[name] == 1
        with pytest.raises(ContractError):
            keyed(bad, want, ["s", "r"], "t")


def test_values_fail_closed(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    with pytest.raises(ContractError, match="3"):
        require_finite(df, ["v"], "t")
    assert require_finite(df.limit(1), ["v"], "t").count() == 1
    with pytest.raises(ContractError):
        require_columns(df, ["w"], "t")
    counts = spark.createDataFrame([(1000, 50, 0.05)], "n_voxels long, n_zero long, zero_fraction double")
    assert require_counts(counts, "t").count() == 1
    for change in ({"n_zero": F.lit(-1)}, {"n_voxels": F.lit(0)}, {"zero_fraction": F.lit(0.0500001)}):
        with pytest.raises(ContractError):
            require_counts(counts.withColumns(change), "t")


def test_tsv_keeps_na_and_exact_doubles(spark, tmp_path):
    values = [0.1 + 0.2, 1e-300, 123456789.123456789]
    (tmp_path / "t.tsv").write_text("# made by hand\nid\tv\n" + "".join(f"{n}\t{v!r}\n" for n, v in zip(["NA", "x", "nan"], values, strict=True)))
    got = read_tsv(spark, str(tmp_path / "t.tsv"), "id string, v double", comment="#").collect()
    assert [r.id for r in got] == ["NA", "x", "nan"] and [r.v for r in got] == values


def test_inventory_status_and_gate(spark, tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    for name, data in (("a.nii.gz", b"1"), ("sub/b.txt", b"22"), ("c.txt", b"333")):
        (root / name).write_bytes(data)
    local = inventory(spark, str(root))
    assert {(r.relpath, r.bytes, r.kind) for r in local.collect()} == {("a.nii.gz", 1, "nii.gz"), ("sub/b.txt", 2, "txt"), ("c.txt", 3, "txt")}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("a.nii.gz", 1, sha(b"1")), ("sub/b.txt", 2, sha(b"2x")), ("gone", 1, sha(b"1"))], "relpath string, bytes long, sha256 string")
    assert {r.relpath: r.status for r in file_status(listed, local).collect()} == {"a.nii.gz": "OK", "sub/b.txt": "MISMATCH", "gone": "MISSING"}
    assert [r.relpath for r in gate(listed, local).collect()] == ["a.nii.gz"]


def test_statistics_text(spark):
    text = "# Measure\n# ColHeaders a b\nbankssts 1 2.5\ncuneus x 3\n\nlonely\n"
    got = {r.name: r["values"] for r in parse_statistics(spark.createDataFrame([("f", text)], "source string, text string")).collect()}
    assert got == {"bankssts": [1.0, 2.5], "cuneus": None, "lonely": None}


def test_texts_as_files_and_portable_json(spark, tmp_path):
    from panelforge.sources.sinks import write_json_lines, write_texts

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y\nz")], "k string, n int, t string")
    files = {r.relpath.split("/")[0]: r for r in inventory(spark, write_texts(rows, ["k"], ["n"], "t", str(tmp_path / "texts"))).collect()}
    assert files["k=a"].sha256 == hashlib.sha256(b"x\n\n").hexdigest() and files["k=b"].bytes == 4
    values = spark.createDataFrame([(1, float("inf")), (2, float("-inf")), (3, float("nan")), (4, None), (5, 0.1)], "i int, v double")
    lines = sorted(r.value for r in spark.read.text(write_json_lines(values, ["v"], str(tmp_path / "json"))).collect())
    assert lines == ['{"i":1,"v":"inf"}', '{"i":2,"v":"-inf"}', '{"i":3,"v":null}', '{"i":4,"v":null}', '{"i":5,"v":0.1}']


def test_numbered_rows(spark):
    from panelforge.functions.ordering import numbered

    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS v", "id % 3 AS w").repartition(5)
    assert all(r.place == r.v for r in numbered(rows, "v").collect())
    assert numbered(rows.limit(0), "v").count() == 0
    tied = [(r.w, r.place) for r in numbered(rows, "w").collect()]
    assert sorted(p for _, p in tied) == list(range(1000)) and sorted(tied) == sorted(tied, key=lambda x: x[1])


STATS = """# subjectname s1
# hemi lh
# hemi rh
# AnnotationFile ../lh.aparc.annot
# cmdline x s1 lh white
# TableCol 1 ColHeader StructName
# TableCol 1 Units NA
# TableCol 2 ColHeader SurfArea
# TableCol 2 Units mm^2
# TableCol 3 ColHeader ThickAvg
# TableCol 3 Units mm
# ColHeaders StructName SurfArea ThickAvg
a 10 2.5

b 20 1.5
"""


@pytest.mark.parametrize(("old", "new", "problem"), [
    ("", "", None), ("subjectname s1", "subjectname s2", "header mismatch"), ("lh.aparc.annot", "lh.other.annot", "annotation"), ("lh white", "lh pial", "surface"),
    ("Units mm^2", "Units cm^2", "units of SurfArea"), ("# ColHeaders StructName SurfArea ThickAvg\n", "", "column headers"), ("b 20 1.5", "b 20", "malformed row"), ("b 20", "c 20", "unknown region"),
    ("b 20 1.5", "b 20 1.5\nb 20 1.5", "repeated region"), ("b 20 1.5", "b 20 NaN", "not finite"), ("b 20", "b 0", "area not positive"), ("b 20 1.5\n", "", "missing region"),
])
def test_region_statistics_fail_closed(spark, old, new, problem):
    from panelforge.operators.contracts import ContractError
    from panelforge.sources.statistics import parse_region_statistics, region_statistics

    roster = spark.createDataFrame([("lh", "a", "lh.a", 0), ("lh", "b", "lh.b", 1), ("rh", "a", "rh.a", 2)], "hemi string, structure string, roi string, ord long")
    texts = spark.createDataFrame([("s1", "lh", STATS.replace(old, new) if old else STATS)], "subject string, hemi string, text string")
    if problem is None:
        assert [tuple(r) for r in region_statistics(texts, roster).orderBy("ord").collect()] == [("s1", "lh", "lh.a", 0, 2.5, 10.0), ("s1", "lh", "lh.b", 1, 1.5, 20.0)]
    else:
        assert problem in {r.problem for r in parse_region_statistics(texts, roster).collect()}
        with pytest.raises(ContractError, match=problem):
            region_statistics(texts, roster)


def test_volumes_round_trip_and_gate(spark):
    import numpy as np

    from panelforge.operators.contracts import ContractError
    from panelforge.sources.volumes import decode, encode_mgh, encode_nifti, gate_report, label_volumes, volumes

    r = np.random.default_rng(1)
    affine = np.array([[0, -2.0, 0, 5], [1.5, 0, 0, -3], [0, 0, 1, 7], [0, 0, 0, 1]])
    for shape in ((2, 3, 4), (2, 3, 4, 2)):
        for kind in ("f4", "i4", "i2", "u1"):
            a = r.integers(0, 99, shape).astype(kind)
            for encode in (encode_nifti, encode_mgh):
                for packed in (True, False):
                    _, back, at = decode(encode(a, affine, packed))
                    assert (back == a).all() and back.shape == shape and np.allclose(at, affine, atol=1e-6)
    with pytest.raises(ValueError):
        decode(b"P5 1 1 255 x")
    whole, half, flat = np.arange(8, dtype=np.float32).reshape(2, 2, 2), np.full((2, 2, 2), 0.5, np.float32), np.zeros((2, 2, 2, 2), np.int32)
    files = spark.createDataFrame([("a", encode_nifti(whole, affine)), ("b", encode_mgh(half, affine)), ("c", encode_nifti(flat, affine))], "path string, content binary")
    scans = volumes(files)
    assert {x.path: x.is_label_volume for x in gate_report(scans).collect()} == {"a": True, "b": False, "c": False}
    assert label_volumes(scans.where("path = 'a'")).first().labels == list(range(8))
    with pytest.raises(ContractError, match="b, c"):
        label_volumes(scans)


def test_transforms_against_numpy(spark):
    import numpy as np

    from panelforge.functions.affine import angle, as_columns, determinant, rigid, rotation
    from panelforge.sources.transforms import parse_transforms, world_transforms

    rx, ry, rz, t, c = 10.0, -20.0, 33.0, (1.0, -2.0, 0.5), (4.0, 5.0, -6.0)
    turn = lambda a, i, j: np.array([[np.cos(a) if p == q in (i, j) or (p == q and p in (i, j)) else -np.sin(a) if (p, q) == (i, j) else np.sin(a) if (p, q) == (j, i) else float(p == q) for q in range(3)] for p in range(3)])
    full = turn(np.radians(rz), 0, 1) @ turn(np.radians(ry), 2, 0) @ turn(np.radians(rx), 1, 2)
    want = np.eye(4)
    want[:3, :3], want[:3, 3] = full, np.array(c) - full @ c + t
    m = rigid(rotation(F.lit(rx), F.lit(ry), F.lit(rz)), [F.lit(x) for x in t], [F.lit(x) for x in c])
    row = spark.range(1).select(*as_columns(m), angle(m).alias("angle"), determinant(m).alias("det")).first()
    assert np.allclose([[row[f"m{i}{j}"] for j in range(4)] for i in range(3)], want[:3]) and abs(row.det - 1) < 1e-12
    assert abs(row.angle - np.degrees(np.arccos((np.trace(full) - 1) / 2))) < 1e-9

    def geometry(dims, size, cosines, centre):
        a = np.eye(4)
        a[:3, :3] = np.array(cosines).T * size
        a[:3, 3] = centre - a[:3, :3] @ (np.array(dims) / 2)
        return a

    sides = {"src": ((256, 256, 256), (1, 1, 1), ((-1, 0, 0), (0, 0, -1), (0, 1, 0)), (3, -4, 5)), "dst": ((64, 60, 40), (2, 2, 3.5), ((0.8, 0.6, 0), (-0.6, 0.8, 0), (0, 0, 1)), (1, 2, 3))}
    src, dst = (geometry(*sides[k]) for k in ("src", "dst"))

    def text(kind, matrix):
        block = "".join(f"{k} volume info\nvalid = 1  # ok\nvolume = {' '.join(map(str, d))}\nvoxelsize = {' '.join(map(str, v))}\n" + "".join(f"{n} = {' '.join(map(str, x))}\n" for n, x in zip(("xras", "yras", "zras"), a, strict=True)) + f"cras = {' '.join(map(str, o))}\n" for k, (d, v, a, o) in sides.items())
        return f"# made\ntype      = {kind} # x\nnxforms   = 1\n1 4 4\n" + "\n".join(" ".join(map(repr, map(float, r))) for r in matrix) + "\n" + block

    rows = [("voxels", text(0, np.linalg.inv(dst) @ want @ src)), ("world", text(1, want)), ("other", text(14, want)), ("broken", "type = 1\n1 4 4\n1 0 0"), ("empty", ""), ("none", None)]
    got = {r.id: r for r in world_transforms(parse_transforms(spark.createDataFrame(rows, "id string, text string")), "id").collect()}
    for k in ("voxels", "world"):
        assert np.allclose([[got[k][f"m{i}{j}"] for j in range(4)] for i in range(3)], want[:3], atol=1e-9)
    assert all(got[k].m00 is None for k in ("other", "broken", "empty", "none"))


def test_components_and_distances_on_a_winding_mask(spark):
    from panelforge.jobs.volumes import clusters

    path = {(i, j, 0) for j in (0, 2) for i in range(4)} | {(3, 1, 0)} | {(0, j, 2) for j in range(4)}  # a U of nine voxels, and a bar
    cells = [(i, j, k) for i in range(4) for j in range(4) for k in range(4)]
    volumes = spark.createDataFrame([(1, [c in path for c in cells], [4, 4, 4]), (2, [True] * 64, [4, 4, 4])], "scan long, mask array<boolean>, shape array<int>")
    assert {(r.scan, r.component, r.size) for r in clusters(volumes).collect()} == {(1, 0, 9), (1, 2, 4), (2, 0, 64)}
    assert clusters(volumes.limit(0)).count() == 0


def test_stream_equals_batch(spark, small):
    from panelforge.streaming.windows import stream_tumbling

    batch = spark.read.parquet(f"{small}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()
    assert {(r.d, r.event_type): r["count"] for r in batch} == {(r.day_, r.event_type): r.n for r in stream_tumbling(spark, small).collect()}


def test_late_events_are_left_out(spark, tmp_path):
    """Three batches: the second's old event comes after the watermark has closed its day; the third adds to an open day."""
    import time

    from panelforge.streaming.windows import EVENTS, latest_windows

    batches = [[(1, "2024-01-10 10:00:00"), (2, "2024-01-10 11:00:00")], [(3, "2024-01-11 09:00:00")], [(4, "2024-01-02 08:00:00"), (5, "2024-01-10 12:00:00")]]
    for k, rows in enumerate(batches):
        events = spark.createDataFrame(rows, "event_id long, at string").selectExpr("event_id", "CAST(at AS timestamp_ntz) AS ts", "1L AS user_id", "'click' AS event_type", "1.5D AS value", "'' AS props")
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their age
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(str(r.day_), r.n, r.total) for r in latest_windows(spark, stream).collect()}
    assert got == {("2024-01-10", 3, 4.5), ("2024-01-11", 1, 1.5)}
