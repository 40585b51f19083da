"""Registered queries against their SQL, on the small tables; and the contracts of the entry module."""

import math
import subprocess
import sys

import duckdb
import pytest

from panelforge.jobs.catalog import CATALOG
from panelforge.operators import model, permutation
from panelforge.sources.adapters import TABLES

#: Queries that run the whole nested model or permutation test; of these a few are run here, all are compared by the driver's gate.
MODEL = set(model.BOOK) | set(permutation.BOOK)
CHOSEN = {"nested_loso", "descriptives_d1", "loso_splits", "permutation_test", "block_integrity", "assignment_valid", "p_value", "study_tasks", "attainable_level", "roi_centre"}
COMPARED = sorted(n for n, (_, sql) in CATALOG.items() if sql and (n not in MODEL or n in CHOSEN))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: "null" if v is None else repr(float(v) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, small, duck, name):
    run, sql = CATALOG[name]
    got = run(spark, small)
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert shown(got.collect(), got.columns) == shown(cursor.fetchall(), names)


def test_every_sql_text_runs(duck):
    assert len(CATALOG) >= 190 and all(callable(run) for run, _ in CATALOG.values())
    for _, sql in CATALOG.values():
        if sql:
            duck.execute(sql).fetchone()


def test_rest_imports_without_the_corpus_operators(tmp_path):
    """With the corpus subpackage gone, the entry module imports and keeps the other queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "panelforge"), tmp_path / "panelforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'roi_stats' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
