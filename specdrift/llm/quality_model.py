"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A document becomes a short vector of statistics, computed by built-in functions. Standardised, it is
mapped to random Fourier features cos(w x + b), which approximate a Gaussian kernel. Ridge weights
solve the normal equations, whose sums (features x features) each partition adds up by itself and
which are then summed block by block: their size depends on the model only. The sums are kept for two
halves of the training rows (by a hash of their statistics), so that each half can be scored by weights
fitted on the other. These scores, counted in 2,000 bins, are calibrated by the pool-adjacent-violators
rule, so a score is the share of label 1 among rows that the weights had not seen and scored alike.

Defined results: null texts count as empty. Rows with a null label, and labels without a document,
teach nothing; repeated labels count one by one. With one class only, every score is that class; with
no label at all it is 0.5. Ties have equal scores; repeated rows are scored one by one, all alike; an
empty table gives no rows. Columns named like the result's are replaced, all others stay. Every
statistic takes time in proportion to the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.llm.io import extended
from specdrift.llm.vectors import collect_vectors, split_blocks, sum_blocks

FEATURES = 256
BANDWIDTH = 2.0
RIDGE = 1e-3
BINS = 2_000
SEED = 20_240_229
SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> list[Column]:
    """Document statistics as doubles; an empty text has finite ones too."""
    body = F.coalesce(text, F.lit(""))
    chars = F.length(body)
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    found = lambda pattern: F.regexp_count(body, F.lit(pattern))
    words = F.regexp_count(body, F.lit(r"(?:^|[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"))
    return [
        F.log1p(chars.cast("double")),
        share(chars, words + 1),
        share(found(r"[#*$%&|<>@\[\]{}=_^~\\]"), words + 1),
        share(found(r"\p{Lu}\p{Lu}"), words + 1),
        share(found(r"[!?]"), words + 1),
        share(found(r"[0-9]{2}"), words + 1),
        share(found(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]\1(?![^\x20\x09-\x0D])"), words + 1),
        share(found(r"[.,]"), words + 1),
        share(found("\n"), words + 1),
        share(found("https?:"), words + 1),
        share(F.size(F.array_distinct(F.split(body, "\n"))), F.size(F.split(body, "\n"))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.shift
        return np.concatenate((np.cos(z) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), self.values[0])
        return np.interp(self.raw(x), self.edges, self.values)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def _sums(rows: DataFrame, step, length: int) -> np.ndarray:
    """Adds ``step(x, y)`` over the batches of all partitions, as one vector of ``length``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for b in batches:
            if len(b):
                total += step(_matrix(b["x"], 0), b["y"].to_numpy(float))
        yield pd.DataFrame(list(split_blocks("s", total)), columns=["name", "block", "value"])

    return collect_vectors(sum_blocks(rows.mapInPandas(run, "name string, block int, value binary")), length).get(
        "s", np.zeros(length)
    )


def _second_half(x: np.ndarray) -> np.ndarray:
    """Whether a row belongs to the second half, by a hash of its statistics."""
    return np.array([zlib.crc32(np.ascontiguousarray(r).tobytes()) & 1 for r in x], bool)


def fit(rows: DataFrame, seed: int = SEED) -> Model:
    """From rows (x array<double>, y 0/1). They are read three times: store them first."""
    first = rows.limit(1).collect()
    width = len(first[0]["x"]) if first else 1
    sums = _sums(rows, lambda x, y: np.concatenate((x.sum(0), (x * x).sum(0), [len(x), y.sum()])), 2 * width + 2)
    n, ones = sums[-2], sums[-1]
    flat = lambda v: Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(2), np.empty(0), np.array([v]))
    if n == 0:
        return flat(0.5)
    if ones in (0, n):
        return flat(float(ones > 0))
    mean = sums[:width] / n
    scale = np.sqrt(np.maximum(sums[width : 2 * width] / n - mean**2, 1e-9))
    rng = np.random.default_rng(seed)
    model = Model(
        mean, scale, rng.normal(0, 1 / BANDWIDTH / np.sqrt(width) * 2, (width, FEATURES)),
        rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.empty(0), np.empty(0),
    )
    d = FEATURES + 1
    half = d * d + d + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, second = model.features(x), _second_half(x)
        parts = [(z[m], y[m]) for m in (~second, second)]
        return np.concatenate([np.concatenate(((u.T @ u).ravel(), u.T @ v, [len(v)])) for u, v in parts])

    both = _sums(rows, normal, 2 * half).reshape(2, half)

    def solved(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[: d * d].reshape(d, d) / max(1.0, sums[-1]) + RIDGE * np.eye(d) / 10, sums[d * d : -1] / max(1.0, sums[-1]))

    model.ridge = solved(both.sum(axis=0))
    # without rows in one half there is nothing else to score the other by
    by_other = [solved(both[1 - h]) if both[:, -1].all() else model.ridge for h in range(2)]

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, second = model.features(x), _second_half(x)
        raw = np.where(second, z @ by_other[1], z @ by_other[0])
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)))

    counts = _sums(rows, count, 2 * BINS)
    model.edges, model.values = isotonic(counts[:BINS], counts[BINS:])
    return model


def isotonic(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: (bin centres, values that never decrease)."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n):
        blocks.append([i, i, n[i], ones[i]])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    centre = lambda i: (i + 0.5) * 2 / BINS - 0.5
    edges = np.array([centre(e) for b in blocks for e in (b[0], b[1])])
    values = np.array([b[3] / b[2] for b in blocks for _ in range(2)])
    return edges, values


def with_statistics(docs: DataFrame, text: str = "text", into: str = "x") -> DataFrame:
    """``docs`` with its statistics as one array<double> column, computed once for each row."""
    return docs.drop(*[into] if into != text else []).withColumn(into, F.array(*statistics(F.col(f"`{text}`"))))


def score_rows(rows: DataFrame, model: Model, x: str = "x") -> DataFrame:
    """``rows`` without column ``x``, with ``score`` and ``predicted``; the model is a few KB."""
    kept = rows.drop("score", "predicted")
    out = extended(kept.drop(x).schema, "score double, predicted int")
    width = len(model.mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = model.score(_matrix(b[x], width)) if len(b) else np.empty(0)
            yield b.drop(columns=[x]).assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    return kept.mapInPandas(run, out)
