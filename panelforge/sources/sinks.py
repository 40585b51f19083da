"""Writers: delimited text that reads back exactly, portable JSON lines, texts as one file a key."""

from __future__ import annotations

import os
import re
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.shared import qualified, scratch_dir
from panelforge.sources.files import NEVER, read_tsv


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared scratch space."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_tsv(df: DataFrame, path: str) -> str:
    """Tab-separated text with a header in each part; doubles in their shortest exact form, empty strings quoted, nulls apart from them."""
    df.write.option("sep", "\t").option("header", True).option("nullValue", NEVER).csv(path)
    return path


def portable(c: Column) -> Column:
    """A double as JSON text: infinities as the strings "inf" and "-inf", NaN and null as null."""
    return F.when(c == float("inf"), '"inf"').when(c == float("-inf"), '"-inf"').when(c.isNull() | F.isnan(c), "null").otherwise(c.cast("string"))


def write_json_lines(df: DataFrame, doubles: list[str], path: str) -> str:
    """One JSON object a row: the other columns as they are, then the named doubles in portable form."""
    rest = [c for c in df.columns if c not in doubles]
    head = F.rtrim(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), F.lit("}"))
    parts = [F.concat(F.lit(f'"{c}":'), portable(F.col(c))) for c in doubles]
    df.select(F.concat(head, F.lit("," if rest else ""), F.concat_ws(",", *parts), F.lit("}")).alias("value")).write.text(path)
    return path


def write_texts(df: DataFrame, keys: list[str], order: list[str], text: str, path: str) -> str:
    """One text file for each value of the keys (folders key=value): the texts in order, a line end after each."""
    rows = df.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "__text").write.partitionBy(*keys).text(path)
    return path


#: What Spark's writers put as %XX into the names of folders (fixed values).
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _named(key: str, value: str | None) -> str:
    return f"{key}=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def write_files(df: DataFrame, keys: list[str], order: list[str], text: str, path: str) -> str:
    """write_texts() for very many files: on a mounted file system the last key names the file (key=value.txt), so a folder holds many.

    There the tasks write their files themselves, one at a time, under a hidden name until it is whole: Spark's writer makes a folder
    for every file, moves all of them in the driver, and its local file system starts a process or more for each. Elsewhere
    it is write_texts().
    """
    root = qualified(df.sparkSession, path)
    if not root.startswith("file:"):
        return write_texts(df, keys, order, text, path)
    top = "/" + root[5:].lstrip("/")
    os.makedirs(top)

    def write(batches):
        now, out, part, n = None, None, None, 0

        def close():
            out.close()
            os.replace(part, f"{top}/{now}.txt")

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            texts = batch.column("__text").cast(pa.large_binary())
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int64)[texts.offset :] if len(texts) else None
            for name, rows in groupby(range(len(names)), names.__getitem__):
                rows = list(rows)
                at = "/".join(_named(k, v) for k, v in zip(keys, name, strict=True))
                if at != now:
                    if out:
                        close()
                    now, n = at, n + 1
                    folder, file = f"{top}/{at}".rsplit("/", 1)
                    os.makedirs(folder, exist_ok=True)
                    part = f"{folder}/.{file}.{uuid.uuid4().hex}"
                    out = open(part, "wb")
                out.write(data.slice(ends[rows[0]], ends[rows[-1] + 1] - ends[rows[0]]))
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    own = [F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]  # null and empty share a name
    rows = df.select(*own, *[F.col(c).alias(f"__by{i}") for i, c in enumerate(order)], F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).cast("binary").alias("__text"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__by{i}" for i in range(len(order))]).select(*keys, "__text")
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return path


def _is_nested(kind) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def write_nested(df: DataFrame, path: str) -> str:
    """Delimited text in which arrays, structs and maps are JSON (nulls inside are kept; infinities and NaN are the words that read_nested takes)."""
    flat = [F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"}).alias(f.name) if _is_nested(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return write_tsv(df.select(*flat), path)


def read_nested(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_nested wrote, by its schema; a cell that isn't of its kind raises."""
    flat = T.StructType([T.StructField(f.name, T.StringType() if _is_nested(f.dataType) else f.dataType) for f in schema.fields])
    rows = read_tsv(spark, path, flat)
    return rows.select(*[F.from_json(F.col(f"`{f.name}`"), f.dataType, {"mode": "FAILFAST"}).alias(f.name) if _is_nested(f.dataType) else F.col(f"`{f.name}`") for f in schema.fields])
