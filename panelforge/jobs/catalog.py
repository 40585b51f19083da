"""Every registered query of the analytics part: name -> (callable, SQL or None)."""

from __future__ import annotations

from panelforge.jobs import aligned, artifacts, boosted, flagship, inference, inventories, kept, relations, ridge, volumes
from panelforge.operators import aggregates, generic, grids, keys, model, permutation, records, rows
from panelforge.streaming import windows
from panelforge.sources.adapters import DuckDialect, SparkDialect, run_sql


def _from_book(book: dict, run=run_sql) -> dict:
    def entry(text):
        return (lambda spark, sf_dir: run(spark, sf_dir, text(SparkDialect())), str(text(DuckDialect())))

    return {name: entry(text) for name, text in book.items()}


CATALOG: dict = {}
for _module in (rows, keys, aggregates, grids, records, generic):
    CATALOG |= _from_book(_module.BOOK)
for _module in (model, permutation):
    CATALOG |= _from_book(_module.BOOK, model.staged)
CATALOG["roi_stats"] = (flagship.roi_stats, CATALOG["roi_stats"][1])
CATALOG["exceedance"] = (relations.exceedance, CATALOG["exceedance"][1])
for _name, _run in inference.QUERIES.items():
    CATALOG[_name] = (_run, None)
CATALOG["clopper_pearson"] = (inference.QUERIES["clopper_pearson"], inference.CLOPPER_PEARSON_SQL)
CATALOG |= relations.QUERIES | artifacts.QUERIES | ridge.QUERIES | volumes.QUERIES | aligned.QUERIES | kept.QUERIES | inventories.QUERIES | windows.QUERIES | boosted.QUERIES
CATALOG["generic_stream_tumbling"] = (windows.stream_tumbling, CATALOG["generic_tumbling"][1])
