"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters of a text (lower-cased code points; everything that is not a letter counts as one blank)
are hashed in runs of one to three into a fixed number of buckets. Training adds up counts for each
language and bucket over all labelled documents: each task adds up dense vectors, puts them out
whenever it holds ``HELD`` languages, and the vectors are summed block by block. The model is a table of these sums. ``GROUP``
languages of it at a time, a proven size, become a matrix of log probabilities (1 MB for each language at the default)
that is broadcast; neither the driver nor a worker ever holds more. Each group is one pass that scores documents in batches:
the buckets of many texts are counted to one sparse matrix, whose product with the group's matrix gives
all scores at once. Long texts are cut into pieces whose scores are added up, so they cost time in
proportion and no more memory. Passes carry on the best score so far and the sum of the others over it,
so any number of languages is learned and compared; between passes rows are written, and a pass's matrix is given up.

Priors are uniform, so that a hot language or source gets no advantage. The score is the posterior
probability of the language predicted. Defined results: null texts and texts without a letter are ``und``
with score 0. Ties go to the first language in code point order. Repeated rows are counted, and
scored, one by one. Without a labelled document every prediction is ``und``; an empty table gives no
rows. Columns named like the result's are replaced, all others stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdrift.llm.io import discard, extended, stored
from specdrift.llm.textnum import with_columns
from specdrift.llm.vectors import collect_vectors, split_blocks, sum_blocks

BUCKETS = 1 << 18
SMOOTHING = 0.5
#: Languages whose matrix is broadcast at once, and whose counts a training task holds.
GROUP, HELD = 64, 64
UNKNOWN = "und"
#: Buckets of texts scored at a time.
BATCH = 1 << 20
#: Code points hashed at a time.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def pieces(text: str) -> Iterator[np.ndarray]:
    """Folded code points of a text, in pieces that overlap by two."""
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "replace")
        yield _fold()[np.frombuffer(part, np.uint32)]


def buckets(points: np.ndarray, skip: int, size: int) -> np.ndarray:
    """Buckets of the n-grams that end after ``skip``; those of blanks alone are left out."""
    p = points.astype(np.uint32)
    one, two, three = p * np.uint32(0x9E3779B1), None, None
    out = []
    mask = np.uint32(size - 1)
    for n in (1, 2, 3):
        if len(p) < n:
            break
        if n == 1:
            h, seen = one, p > 0
        elif n == 2:
            two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + p[1:] * np.uint32(0xC2B2AE35)
            h, seen = two, (p[:-1] | p[1:]) > 0
        else:
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + p[2:] * np.uint32(0x165667B1)
            h, seen = three, (p[:-2] | p[1:-1] | p[2:]) > 0
        h = (h ^ (h >> np.uint32(16)) ^ np.uint32(n)) & mask
        keep = seen[max(0, skip - n + 1) :]
        out.append(h[max(0, skip - n + 1) :][keep])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _text_buckets(text: str, size: int) -> Iterator[np.ndarray]:
    for k, points in enumerate(pieces(text)):
        yield buckets(points, 2 if k else 0, size)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = BUCKETS) -> tuple[list[str], DataFrame]:
    """(languages in code point order, model (name, block, value): counts of buckets) from rows whose
    language and text are not null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            rows = [r for name, vec in sums.items() for r in split_blocks(name, vec)]
            # a language without a single letter is still learned
            rows += [(name, 0, np.zeros(1).tobytes()) for name, vec in sums.items() if not vec.any()]
            if rows:
                yield pd.DataFrame(rows, columns=["name", "block", "value"])
            sums.clear()

        for batch in batches:
            for t, name in zip(batch["t"], batch["l"], strict=True):
                if name not in sums and len(sums) >= HELD:
                    yield from flush()
                vec = sums.setdefault(name, np.zeros(size))
                for found in _text_buckets(t, size):
                    if len(found) * 4 > size:
                        vec += np.bincount(found, minlength=size)
                    else:
                        np.add.at(vec, found, 1.0)
        yield from flush()

    labelled = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).dropna()
    counts = labelled.mapInPandas(count, "name string, block int, value binary")
    model = stored(sum_blocks(counts), "languages")
    names = sorted((r[0] for r in model.select("name").distinct().collect()), key=lambda n: n.encode())
    return names, model


def log_probabilities(model: DataFrame, names: list[str], size: int = BUCKETS) -> np.ndarray:
    """[language, bucket] of some languages of a model."""
    sums = collect_vectors(model.filter(F.col("name").isin(names)), size)
    matrix = np.stack([sums[n] for n in names]) + SMOOTHING
    return np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def _sparse(texts: Iterator[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (text number, bucket) pairs, one for each n-gram."""
    rows, found, held = [], [], 0
    for i, t in enumerate(texts):
        for some in _text_buckets(t, size) if t is not None else ():
            rows.append(np.full(len(some), i))
            found.append(some)
            held += len(some)
            if held >= BATCH:
                yield np.concatenate(rows), np.concatenate(found)
                rows, found, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(found)


def _scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores [text, language], number of n-grams) of texts; ``table`` is [bucket, language]."""
    total, letters = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for row, found in _sparse(texts, len(table)):
        # the n-grams of a text come together, so a sparse row is a run
        lead = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        own = row[lead]
        letters[own] += np.diff(np.concatenate((lead, [len(row)])))
        for j in range(table.shape[1]):
            total[own, j] += np.add.reduceat(table[:, j][found], lead, dtype=np.float64)
    return total, letters


def predict(docs: DataFrame, names: list[str], model: DataFrame | np.ndarray, text: str = "text", size: int = BUCKETS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced. ``model`` is what ``train`` returns, or
    log probabilities [language, bucket]."""
    spark, before = docs.sparkSession, None
    kept = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    columns = kept.columns
    free = "_" * (1 + max(map(len, kept.columns)))  # no column starts like this
    best_at, top_at, rest_at = (free + c for c in ("best", "top", "rest"))
    state = extended(kept.schema, f"`{best_at}` string, `{top_at}` double, `{rest_at}` double")
    rows = kept.withColumns({best_at: F.lit(None).cast("string"), top_at: F.lit(None).cast("double"), rest_at: F.lit(0.0)})
    for at in range(0, len(names), GROUP):
        mine = names[at : at + GROUP]
        logp = model[at : at + GROUP] if isinstance(model, np.ndarray) else log_probabilities(model, mine, size)
        sent = spark.sparkContext.broadcast((mine, np.asfortranarray(logp.T)))

        def score(batches: Iterator[pa.RecordBatch], model=sent) -> Iterator[pa.RecordBatch]:
            group, table = model.value
            for batch in batches:
                total, letters = _scores(batch.column(text).to_pylist(), table)
                k = total.argmax(axis=1)
                top = total[np.arange(len(k)), k]
                rest = np.exp(total - top[:, None]).sum(axis=1)
                old, sums = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (top_at, rest_at))
                first = np.isnan(old)
                wins = first | (top > old)
                most = np.where(wins, top, old)
                sums = rest * np.exp(top - most) + sums * np.exp(np.where(first, -np.inf, old - most))
                best = np.where(wins, np.array(group, object)[k], np.array(batch.column(best_at).to_pylist(), object))
                none = letters == 0
                made = (pa.array(best, pa.string(), mask=none), pa.array(most, mask=none), pa.array(np.where(none, 0.0, sums)))
                yield with_columns(batch.select(columns), dict(zip((best_at, top_at, rest_at), made, strict=True)))

        rows = rows.mapInArrow(score, state)
        if at + GROUP < len(names):
            rows = stored(rows, "scored")
            sent.destroy()
            discard(before)
            before = rows
    best, rest = F.col(f"`{best_at}`"), F.col(f"`{rest_at}`")
    return rows.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(best.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), 1.0 / rest)).alias("score"),
    )
