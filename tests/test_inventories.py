"""Inventories against a walk of the folder, digest trees against hashlib, the frozen configuration against its departures."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    r = random.Random(3)
    for name, text in {"participants.tsv": b"participant_id\nsub-1\n", "README": b"caf\xe9 and more", "notes.txt": b"-"}.items():
        (root / name).write_bytes(text)
    for top in ("", "derivatives/maps/", "derivatives/surfaces/"):
        for sub in range(5):
            for ses in range(r.randrange(1, 4)):
                for name in r.sample(["a.nii.gz", "b.json", "LICENSE", "c.d.tsv", "e.gz"], 3):
                    path = root / f"{top}sub-{sub}/ses-{ses}/anat/{name}"
                    path.parent.mkdir(parents=True, exist_ok=True)
                    path.write_bytes(bytes(r.randrange(1, 50)))
    (root / "sub-1" / "scans.tsv").write_text("x")
    (root / "derivatives" / "maps" / "sub-file").write_text("a file, not a folder")
    (root / "derivatives" / "maps" / "sub-2" / "ses-file").write_text("nor this")
    (root / "derivatives" / "loose.txt").write_text("in no data set")
    return root


def kind(p: Path) -> str:
    return ".nii.gz" if p.name.endswith(".nii.gz") else p.suffix or p.name


def test_inventory_is_that_of_a_walk(spark, folder):
    from panelforge.sources.files import inventory
    from panelforge.sources.inventories import derivative_summaries, subject_entries, top_level

    files = inventory(spark, str(folder))
    assert {x.name for x in top_level(files).collect()} == {p.name for p in folder.iterdir()}
    got = {x.subject: (x.entries, x.n_files, x.bytes) for x in subject_entries(files).collect()}
    below = lambda d: [p for p in d.rglob("*") if p.is_file()]
    assert got == {d.name: (sorted(p.name for p in d.iterdir()), len(below(d)), sum(p.stat().st_size for p in below(d))) for d in folder.glob("sub-*")}
    for x in derivative_summaries(files).collect():
        d = folder / "derivatives" / x.derivative
        assert x.n_files == len(below(d)) and x.bytes == sum(p.stat().st_size for p in below(d))
        assert x.subjects == sorted(p.name for p in d.glob("sub-*") if p.is_dir()) and x.n_subjects == len(x.subjects)
        assert {s.ses: s.n for s in x.sessions} == Counter(s.name for u in d.glob("sub-*") for s in u.glob("ses-*") if s.is_dir())
        want = Counter(map(kind, below(d)))
        assert [(k.kind, k.n) for k in x.kinds] == sorted(want.items(), key=lambda e: (-e[1], e[0]))


def test_kinds_and_hidden_names(spark):
    from panelforge.sources.inventories import file_kind, top_level, visible

    names = ["a/.bidsignore", "b.c.txt", "x.nii.gz", "y.tar.gz", "plain", "..odd", "end.", ".a.b", ".nii.gz"]
    rows = spark.createDataFrame([(n,) for n in [*names, "q/.DS_Store", ".DS_Store", None]], "relpath string")
    assert {x.relpath: x.kind for x in visible(rows).select("relpath", file_kind().alias("kind")).collect()} == {
        "a/.bidsignore": ".bidsignore", "b.c.txt": ".txt", "x.nii.gz": ".nii.gz", "y.tar.gz": ".gz", "plain": "plain", "..odd": "..odd", "end.": "end.", ".a.b": ".b", ".nii.gz": ".nii.gz",
    }
    assert {x.name for x in top_level(rows).collect()} == {n.split("/")[0] for n in names}


def test_metadata_files(spark, folder):
    from panelforge.sources.inventories import metadata_files

    rows = spark.createDataFrame([(p.name, p.read_bytes()) for p in folder.iterdir() if p.is_file()] + [("sub-1/README", b"deeper")], "relpath string, content binary")
    got = {x.relpath: x for x in metadata_files(rows, ["README", "participants.tsv", "absent"]).collect()}
    assert set(got) == {"README", "participants.tsv"} and got["README"].text == "caf� and more"
    for name, x in got.items():
        content = (folder / name).read_bytes()
        assert (x.bytes, x.sha256) == (len(content), hashlib.sha256(content).hexdigest())


def tree(lines: list[str], fan: int) -> dict:
    digest = lambda part: hashlib.sha256("".join(f"{x}\n" for x in part).encode()).hexdigest()
    level, now, out = 0, lines, {}
    while True:
        now = [digest(now[i : i + fan]) for i in range(0, len(now), fan)]
        out |= {(level, i): d for i, d in enumerate(now)}
        if len(now) == 1:
            return out
        level += 1


@pytest.mark.parametrize("n", [1, 4, 5, 70])
def test_digest_tree(spark, n):
    from pyspark.sql import functions as F

    from panelforge.functions.digests import differing_leaves, digest_tree

    rows = [(i // 3, f"line {i % 7}" if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)
    lines = [x for _, x in sorted((k, v or "") for k, v in rows)]
    found = digest_tree(df, ["k"], F.col("v"), fan=4)
    assert {(x.level, x.node): x.sha256 for x in found.collect()} == tree(lines, 4)
    top = max(found.collect(), key=lambda x: x.level)
    assert top.n == n and (n < 70 or top.level == 3)
    other = digest_tree(df.withColumn("v", F.when(F.col("k") == n // 3 - 1, "changed").otherwise(F.col("v"))), ["k"], F.col("v"), fan=4)
    assert differing_leaves(found, found).count() == 0 and (n < 5 or {x.node for x in differing_leaves(found, other).collect()} <= {(n - 6) // 4, (n - 3) // 4, (n - 1) // 4})


def test_digest_tree_of_nothing(spark):
    from pyspark.sql import functions as F

    from panelforge.functions.digests import digest_tree

    assert [tuple(x) for x in digest_tree(spark.createDataFrame([], "k long"), ["k"], F.lit("x")).collect()] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_configuration_must_be_the_frozen_one(spark):
    from panelforge.operators.contracts import ContractError, config_rows, require_config

    config = {"target": {"transform": "none", "scale": 1.5}, "rois": {"n": 68, "list": ["b", "a"]}, "pet": False, "more": None}
    rows = config_rows(spark, config)
    assert {x.path for x in rows.collect()} == {"target", "target.transform", "target.scale", "rois", "rois.n", "rois.list", "pet", "more"}
    frozen = {"target": '{"scale": 1.5, "transform": "none"}', "rois.n": "68", "rois.list": '["b", "a"]', "pet": "false", "more": "null"}
    assert require_config(rows, frozen) is rows
    for path, value in {"rois.n": "67", "rois.list": '["a", "b"]', "target": '{"transform": "none"}', "absent": "1", "pet": "0"}.items():
        with pytest.raises(ContractError, match=path):
            require_config(rows, frozen | {path: value})
