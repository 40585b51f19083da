"""Seeded assignments in blocks: the generator's state at each block's start is found in one light pass, and tasks draw their block again from it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Replicates of a block: what is held at a time.
BLOCK = 500


def drawn(rng: np.random.Generator, strata: list[list[int]], n: int) -> np.ndarray:
    """donors[replicate, subject] of the next n replicates: a permutation inside each stratum, in listed order."""
    out = np.empty((n, sum(map(len, strata))), np.int64)
    for row in out:
        for members in strata:
            m = np.asarray(members)
            row[m] = m[rng.permutation(len(m))]
    return out


def blocks(strata: list[list[int]], replicates: int, seed: int, block: int = BLOCK) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(first replicate, how many, the generator's state before them as JSON, donors) of one block after another."""
    rng = np.random.Generator(np.random.PCG64(seed))
    for first in range(0, replicates, block):
        n = min(block, replicates - first)
        state = json.dumps(rng.bit_generator.state)
        yield first, n, state, drawn(rng, strata, n)


def assignment_blocks(spark: SparkSession, strata: list[list[int]], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(replicate, donors) of all replicates, drawn in tasks; the driver holds a state a block."""
    known = [(first, n, state) for first, n, state, _ in blocks(strata, replicates, seed, block)]
    rows = spark.createDataFrame(known, "first long, n int, state string").repartition(max(1, len(known)), F.col("first"))

    def draw(parts):
        for part in parts:
            for first, n, state in part.itertuples(index=False):
                rng = np.random.Generator(np.random.PCG64())
                rng.bit_generator.state = json.loads(state)
                yield pd.DataFrame({"replicate": np.arange(first, first + n), "donors": list(drawn(rng, strata, n).astype(np.int32))})

    return rows.mapInPandas(draw, "replicate long, donors array<int>")


def digest(subjects: list, strata: list[list[int]], replicates: int, seed: int, block: int = BLOCK) -> str:
    """SHA-256 over a JSON header line and the little-endian donors, fed block by block in order."""
    sha = hashlib.sha256(json.dumps({"dtype": "<i8", "shape": [replicates, sum(map(len, strata))], "subjects": subjects}, sort_keys=True).encode() + b"\n")
    for _, _, _, donors in blocks(strata, replicates, seed, block):
        sha.update(donors.astype("<i8").tobytes())
    return sha.hexdigest()
