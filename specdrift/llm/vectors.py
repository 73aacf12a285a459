"""Distributed sums of dense vectors with bounded memory in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Doubles in one shuffled block.
BLOCK = 8192


def split_blocks(name: str, values: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """(name, block, float64 bytes) rows of a flat vector; blocks of zeros are left out."""
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        if part.any():
            yield name, i // BLOCK, part.astype(np.float64).tobytes()


def sum_blocks(parts: DataFrame, tasks: int = 32) -> DataFrame:
    """Sums rows (name, block, value binary) that have the same name and block.

    Two rounds of partial sums: each partition first adds up what it holds, block by block, so a
    second round gets at most ``tasks`` rows for a block however many partitions there were.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, value in zip(batch["name"], batch["block"], batch["value"], strict=True):
                got = np.frombuffer(value, np.float64)
                key = (name, block)
                if key in sums:
                    sums[key] += got
                else:
                    sums[key] = got.copy()
        if sums:
            yield pd.DataFrame(
                [(n, b, v.tobytes()) for (n, b), v in sums.items()], columns=["name", "block", "value"]
            )

    once = parts.repartition(tasks).mapInPandas(add, parts.schema)
    return once.repartition(max(1, tasks // 4), "name", "block").mapInPandas(add, parts.schema)


def collect_vectors(sums: DataFrame, length: int) -> dict[str, np.ndarray]:
    """The summed vectors on the driver. Their number times ``length`` must be bounded by the model."""
    out: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        vec = out.setdefault(row["name"], np.zeros(length))
        part = np.frombuffer(row["value"], np.float64)
        vec[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return out
