"""Artifacts that refuse what was tampered with, cut, added to or left unfinished; the published tree; nested cells."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from panelforge.sources import artifact
from panelforge.sources.artifact import ArtifactError, load, save


@pytest.fixture
def saved(spark, tmp_path):
    one = spark.range(100).select("id", (F.col("id") / 3).alias("v")).repartition(3)
    two = spark.createDataFrame([("a", [1, 2]), ("b", None)], "k string, xs array<int>")
    return save(spark, str(tmp_path / "run"), {"one": one, "two": two}, {"seed": 7}), tmp_path


def test_a_saved_artifact_loads(spark, saved):
    folder, _ = saved
    got = load(spark, folder, "one")
    assert got.count() == 100 and {r.id: r.v for r in got.collect()} == {i: i / 3 for i in range(100)}
    assert {(r.k, tuple(r.xs or ())) for r in load(spark, folder + "/", "two").collect()} == {("a", (1, 2)), ("b", ())}
    status = json.loads((saved[1] / "run" / "status.json").read_text())
    assert status["status"] == "completed" and status["facts"] == {"seed": 7} and status["tables"]["one"]["rows"] == 100
    assert not (saved[1] / "run.partial").exists()
    with pytest.raises(ArtifactError, match="no table"):
        load(spark, folder, "three")
    with pytest.raises(ArtifactError, match="already"):
        save(spark, folder, {"one": got})


@pytest.mark.parametrize("harm", ["tampered", "truncated", "missing", "extra", "manifest", "status", "unfinished", "no status"])
def test_a_harmed_artifact_is_refused(spark, saved, harm):
    folder, tmp = saved
    root = tmp / "run"
    for crc in root.rglob(".*.crc"):  # checksums of the local file system, which a real tampering would pass
        crc.unlink()
    file = sorted(root.glob("tables/one/part-*.parquet"))[0]
    if harm == "tampered":
        data = bytearray(file.read_bytes())
        data[20] ^= 1
        file.write_bytes(bytes(data))
        says = "altered"
    elif harm == "truncated":
        file.write_bytes(file.read_bytes()[:-9])
        says = "altered"
    elif harm == "missing":
        file.unlink()
        says = "missing"
    elif harm == "extra":
        shutil.copy(file, file.with_name("part-more.parquet"))
        says = "extra"
    elif harm == "manifest":  # a consistent lie: another file, and its digest in the manifest
        file.write_bytes(file.read_bytes() + b"x")
        for m in root.glob("manifest/one/part-*.csv"):
            m.write_text("".join(line.replace(line.split("\t")[3].strip(), hashlib.sha256(file.read_bytes()).hexdigest()) if file.name in line else line for line in m.read_text().splitlines(True)))
        says = "manifest"
    elif harm == "status":
        (root / "status.json").write_text("{")
        says = "can't be read"
    elif harm == "unfinished":
        (root / "status.json").write_text('{"status": "started", "tables": ["one", "two"]}')
        says = "not completed"
    else:
        (root / "status.json").unlink()
        says = "no status.json"
    with pytest.raises(ArtifactError, match=says):
        load(spark, folder, "one")


def test_a_lost_job_is_taken_up_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "run")
    one, bad = spark.range(10), spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        save(spark, folder, {"one": one, "two": bad})
    assert not (tmp_path / "run").exists() and json.loads((tmp_path / "run.partial" / "status.json").read_text())["status"] == "started"
    with pytest.raises(ArtifactError, match="no status"):
        load(spark, folder, "one")
    with pytest.raises(ArtifactError, match="not completed"):
        load(spark, folder + ".partial", "one")
    with pytest.raises(ArtifactError, match="another job"):
        save(spark, folder, {"other": one})
    kept = {p.name for p in (tmp_path / "run.partial" / "tables" / "one").glob("part-*")}
    save(spark, folder, {"one": one, "two": spark.range(3)})
    assert {p.name for p in (tmp_path / "run" / "tables" / "one").glob("part-*")} == kept and load(spark, folder, "two").count() == 3


def test_published_tree(spark):
    from panelforge.sources.published import verify

    files = {"a": b"alpha\n", "b": b"", "c": "é\0x".encode(), "d": b"d", "e": b"e", "f": b"f"}
    blob = lambda b: hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest()
    key = lambda b, n=None: f"../.x/SHA256E-s{len(b) if n is None else n}--{hashlib.sha256(b).hexdigest()}.nii.gz"
    tree = [("a", "100644", blob(files["a"]), None), ("b", "100755", blob(b""), None), ("c", "120000", None, key(files["c"])), ("d", "120000", None, key(files["d"], 2)), ("e", "120000", None, "elsewhere"), ("f", "100644", blob(b"F"), None), ("gone", "100644", blob(b""), None)]
    got = verify(
        spark.createDataFrame(list(files.items()), "relpath string, content binary"), spark.createDataFrame(tree, "relpath string, mode string, sha string, target string"),
        spark.createDataFrame([(x,) for x in [*files, "gone", "never"]], "relpath string"),
    ).collect()
    assert {r.relpath: (r.storage, r.match) for r in got} == {"a": ("object", True), "b": ("object", True), "c": ("link", True), "d": ("link", False), "e": ("link", False), "f": ("object", False), "gone": (None, False), "never": (None, False)}
    said = {r.relpath: r.detail for r in got}
    assert said["e"] == "key not parsed" and said["gone"] == said["never"] == "" and said["b"].endswith("e69de29bb2d1d6434b8b29ae775ad8c2e48c5391")


def test_nested_cells_round_trip(spark, tmp_path):
    from panelforge.sources.sinks import read_nested, write_nested

    schema = "k string, xs array<double>, m map<string,array<int>>, s struct<a:string,b:struct<c:long,d:boolean>>"
    rows = [("tab\tand \"quote\"", [0.1, None, 1e-300, float("inf")], {"x": [1, None], "y\n": []}, ("NA", (2**62, True))), ("", [], {}, (None, None)), (None, None, None, None), ("null", [1.0], {"": None}, ("", (None, False)))]
    df = spark.createDataFrame(rows, schema).repartition(2)
    back = read_nested(spark, write_nested(df, str(tmp_path / "n")), df.schema)
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("k\txs\tm\ts\na\t[1,\t{}\t{}\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_nested(spark, str(tmp_path / "bad"), df.schema).collect()


def test_blocks_draw_what_one_stream_draws(spark):
    """Redrawn blocks equal the whole stream; the digest is that of all donors at once, whatever the block."""
    import numpy as np

    from panelforge.functions.draws import assignment_blocks, digest
    from panelforge.functions.nested_loso import assignments

    strata = [[4, 0, 2], [1, 3], [5]]
    whole = assignments(strata, 57, 20260929)
    for block in (10, 57, 500):
        got = sorted(assignment_blocks(spark, strata, 57, 20260929, block).collect())
        assert [r.replicate for r in got] == list(range(57)) and (np.array([r.donors for r in got]) == whole).all()
        head = json.dumps({"dtype": "<i8", "shape": [57, 6], "subjects": list("abcdef")}, sort_keys=True).encode() + b"\n"
        assert digest(list("abcdef"), strata, 57, 20260929, block) == hashlib.sha256(head + whole.astype("<i8").tobytes()).hexdigest()
