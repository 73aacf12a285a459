"""Near-duplicates: ProbMinHash signatures of weighted shingles, banding, exact verification.

Shingles are runs of ``k`` words, weighted by how often a text has them (a text of fewer words is
one shingle). ProbMinHash lets every shingle arrive at random registers as a Poisson process whose
rate is its weight; a register keeps the earliest arrival. Two texts agree in a register with the
probability Jaccard similarity

    J(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)   (i over common shingles),

which is plain Jaccard when weights are equal. A shingle stops as soon as its next arrival is later
than the text's latest register, so long texts cost little more than one arrival for each shingle.

Registers are grouped into bands; texts that agree in a band are candidates. Copies are collapsed
first, so a group of copies is one member of its buckets. All members of a bucket are compared with a
pivot, the member with the largest buckets over all bands. Where that leaves a bucket in several
components, the members outside the one with most members are compared with about 64 of its members,
and those still outside with every member of another component. So every pair of a bucket that is not
in one component is compared, and a large group of near copies costs a few comparisons for each member;
only members that stay outside meet all others. There is no cap on buckets or partners.

Pairs whose registers agree too rarely for the threshold are not formed; the others are verified
exactly on their shingles. After the first comparison one bit is taken of each of ``FINE`` registers of the
texts concerned, which tells pairs below the threshold better from those above. A pair at the threshold
loses its link if it meets in no band (1.3e-5), or if the registers that it is tested by agree by 4 standard
deviations too rarely (3e-5). More similar pairs are lost less often.

Defined results: texts without a word (null, empty, blank) are singletons. Classes are connected
components of verified links and exact copies; ``class_id`` is the least doc_id of the class. Rows of
null doc_id link to nothing, and each has a row of nulls in the result. Repeated rows are copies. Where
rows of one doc_id have different texts, the document takes part with each of them and is in the least
of their classes. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.llm.graph import components
from specdrift.llm.io import discard, stored
from specdrift.llm.textnum import flat_texts, inside, mix64, rolling, sliced, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at 0.8 meets in at least one of 48 bands of 7 with probability 1 - 1.3e-5. Wide bands keep
#: texts apart that only share a very common passage.
BANDS, ROWS = 48, 7
U64 = np.uint64
#: Registers of the finer sketch of texts that stay outside a bucket's main component or meet one that does.
FINE = 1_344
#: Members of a bucket's main component, about, that those outside are compared with before all.
SOME = (64,)
#: Arrivals that one step over few shingles makes at once.
AT_ONCE = 65_536
_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a column of texts: where each text's begin (and the last ends), their 64-bit
    hashes, in order within a text, and their counts."""
    data, begins = flat_texts(texts)
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    begins = np.searchsorted(starts, begins)
    size = np.diff(begins)
    found, rows = [rolling(words, k)[inside(begins, k)]], [np.repeat(np.arange(len(size)), np.maximum(size - k + 1, 0))]
    for n in range(1, k):
        if (short := np.flatnonzero(size == n)).size:
            found.append(rolling(words, n)[begins[short]])
            rows.append(short)
    row, item = np.concatenate(rows), np.concatenate(found)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, item = row[order], item[order]
    edges = np.searchsorted(row, np.arange(len(size) + 1)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        item[a:b].sort()
    lead = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (row[1:] != row[:-1])))) if len(item) else np.empty(0, np.int64)
    return np.searchsorted(row[lead], np.arange(len(size) + 1)), item[lead], np.diff(np.concatenate((lead, [len(item)])))


def shingles(text: str | None, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles, and their counts."""
    return shingle_sets(pa.array([text], pa.string()), k)[1:]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J of two (hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(both) / (len(ha) + len(hb) - len(both))
    # group common shingles by the ratio of their weights: the inner sum depends on it alone
    x = np.concatenate((wa[ia], np.delete(wa, ia), np.zeros(len(hb) - len(both)))).astype(float)
    y = np.concatenate((wb[ib], np.zeros(len(ha) - len(both)), np.delete(wb, ib))).astype(float)
    ratio = x[: len(both)] / y[: len(both)]
    # sum_j max(x_j / x_i, y_j / y_i) = (1 / x_i) sum_j max(x_j, y_j x_i / y_i)
    order = np.argsort(np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0), kind="stable")
    xs, ys = x[order], y[order]
    key = np.divide(xs, ys, out=np.full(len(xs), np.inf), where=ys > 0)
    below = np.concatenate(([0.0], np.cumsum(ys)))
    above = np.concatenate((np.cumsum(xs[::-1])[::-1], [0.0]))
    cut = np.searchsorted(key, ratio, side="right")
    return float((x[: len(both)] / (above[cut] + below[cut] * ratio)).sum())


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """[text, register] shingle hashes of the earliest arrivals; texts without shingles have zeros."""
    begins = np.concatenate(([0], np.cumsum([len(h) for h, _ in sets], dtype=np.int64)))
    item = np.concatenate([np.empty(0, U64), *[h for h, _ in sets]])
    return _registers(begins, item, np.concatenate([np.empty(0), *[w for _, w in sets]]), m)


def _registers(begins: np.ndarray, item: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """``signatures`` of flat sets. A register holds its earliest arrival as one number: the time's 32 bits
    (positive floats sort as integers), then the arrival's place in ``item``."""
    n = len(begins) - 1
    best = np.full((n, m), _NEVER)
    flat = best.reshape(-1)
    at = np.arange(len(item), dtype=np.int64)
    row = np.repeat(np.arange(n), np.diff(begins))
    rate, time = 1.0 / weight, np.zeros(len(item))
    turn = 0
    while len(at):
        # the fewer shingles go on, the more turns are taken at once
        turns = max(1, min(256, AT_ONCE // len(at)))
        steps = np.arange(turn + 1, turn + 1 + turns, dtype=U64) * U64(0x9E3779B97F4A7C15)
        turn += turns
        r = mix64(item[at][:, None] + steps)
        times = np.log(_uniform(r))
        times *= -rate[at][:, None]
        times[:, 0] += time
        np.cumsum(times, axis=1, out=times)
        register = ((r * U64(0x5851F42D4C957F2D) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        bits = times.astype(np.float32).view(np.uint32).astype(U64) << U64(32)
        np.minimum.at(flat, (register + (row * m)[:, None]).ravel(), (bits | at.astype(U64)[:, None]).ravel())
        lead = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        latest = best[row[lead]].max(axis=1)
        alive = bits[:, -1] <= np.repeat(latest, np.diff(np.concatenate((lead, [len(row)]))))
        at, row, time = at[alive], row[alive], times[alive, -1]
    who = np.zeros((n, m), U64)
    some = np.diff(begins) > 0
    who[some] = item[(best[some] & U64(0xFFFFFFFF)).astype(np.int64)]
    return who


def _brief(sig: np.ndarray) -> np.ndarray:
    """A byte of each register, eight to a long; registers past the end are 0."""
    low = np.zeros((len(sig), -(-sig.shape[1] // 8) * 8), np.uint8)
    low[:, : sig.shape[1]] = (mix64(sig) & U64(0xFF)).astype(np.uint8)
    return low.view(np.int64)


def _differing(a: Column, b: Column) -> Column:
    """Registers in which two briefs differ."""

    def bytes_apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for n in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, n))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, bytes_apart), F.lit(0), lambda s, n: s + n)


def _band_rows(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = sig.reshape(len(sig), bands, rows)
    out = np.full((len(sig), bands), U64(0))
    for r in range(rows):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return mix64(out ^ np.arange(1, bands + 1, dtype=U64))


def _lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    edges = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(values.reshape(-1)), mask=None if mask is None else pa.array(mask))


_WORDS = [f"f{i}" for i in range(FINE // 64)]


def fine_sketch(texts: DataFrame, k: int) -> DataFrame:
    """(rep, f0, f1, ...): a bit of each of ``FINE`` registers of texts (id, t), 64 to a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            bits = (mix64(_registers(*shingle_sets(batch.column("t"), k), FINE)) & U64(1)).astype(bool)
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(w)) for w in words.T]], names=["rep", *_WORDS])

    return texts.mapInArrow(run, "rep bigint, " + ", ".join(f"{w} bigint" for w in _WORDS))


def _most_apart(registers: int, least: float) -> int:
    """4 standard deviations below the threshold, so that a pair at it passes but for 3 in 100,000. ``least`` is
    the share of registers that a pair at the threshold has in common."""
    return int(registers * (1 - least + 4 * (least * (1 - least) / registers) ** 0.5))


def sketch(docs: DataFrame, k: int, bands: int, rows: int, text: str, doc_id: str) -> DataFrame:
    """(id, copy_key binary, bands, brief: arrays of bigint) for each row with a doc_id; bands are null
    without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            begins, item, weight = shingle_sets(batch.column("t"), k)
            sig = _registers(begins, item, weight, bands * rows)
            keys = [hashlib.sha256(t or b"").digest() for t in batch.column("t").cast(pa.binary()).to_pylist()]
            columns = [batch.column("id"), pa.array(keys, pa.binary()), _lists(_band_rows(sig, bands, rows).view(np.int64), np.diff(begins) == 0), _lists(_brief(sig))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "copy_key", "bands", "brief"])

    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return named.filter("id is not null").mapInArrow(run, "id bigint, copy_key binary, bands array<bigint>, brief array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b, ca, cb) whose texts, rows (id, t), have J of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "tb", 4_000_000):
            a = batch.column("a").to_numpy()
            lead = np.concatenate(([True], a[1:] != a[:-1]))
            sets = [shingle_sets(t, k) for t in (batch.column("ta").filter(pa.array(lead)), batch.column("tb"))]
            (fa, ia, wa), (fb, ib, wb) = sets
            keep = [
                probability_jaccard((ia[fa[x] : fa[x + 1]], wa[fa[x] : fa[x + 1]]), (ib[fb[y] : fb[y + 1]], wb[fb[y] : fb[y + 1]])) >= least
                for y, x in enumerate((np.cumsum(lead) - 1).tolist())
            ]
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
    both = with_b.join(texts.withColumnsRenamed({"id": "a", "t": "ta"}), "a")
    return both.select("a", "b", "ca", "cb", "ta", "tb").mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint")


def _merged(comps: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``comps`` (node, root) after the links between components (ca, cb), and the new root of each of these."""
    new = stored(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "roots")
    if comps is None:
        return new, new
    moved = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = comps.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(old.union(new.join(comps.select("node"), "node", "left_anti")), "components"), new


def _open(members: DataFrame) -> DataFrame:
    """Members (bucket, rep, comp, bands, and fine bits) of buckets with more than one component, with ``main``, that
    of most members, and the bucket's size ``n``."""
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    state = parts.groupBy("bucket").agg(F.max(F.struct("size", (-F.col("comp")).alias("neg"))).alias("m"), F.count("*").alias("parts"), F.sum("size").alias("n"))
    more = state.filter("parts > 1").select("bucket", (-F.col("m.neg")).alias("main"), "n")
    return stored(members.join(more, "bucket").select("bucket", "rep", "comp", "main", "n", "bands", *_WORDS), "open")


def classes(
    docs: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id bigint, class_id bigint): one row for each distinct doc_id, and one for each row without."""
    sketches = stored(sketch(docs, k, bands, rows, text, doc_id), "sketch")
    firsts = sketches.filter("bands is not null").groupBy("copy_key").agg(F.min("id").alias("rep"))
    reps = sketches.join(firsts.withColumnRenamed("copy_key", "ck"), F.col("id") == F.col("rep")).filter("copy_key = ck")
    buckets = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(buckets.join(sizes, "bucket"), "shared")
    # degree: how many members the buckets of a text have
    degree = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    texts = stored(texts.join(degree.select(F.col("rep").alias("id")), "id", "left_semi").distinct(), "texts")
    briefs = stored(reps.select("rep", "bands", "brief").join(degree, "rep"), "briefs")
    alike = _differing(F.col("brief"), F.col("p_brief")) <= _most_apart(bands * rows, least)
    # of two different registers, half have the same bit
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"p_{w}"))) for w in _WORDS])
    finely = bits <= _most_apart(FINE, (1 + least) / 2)

    # every member with its bucket's pivot
    slim = shared.join(briefs.select("rep", "brief"), "rep").select("bucket", "rep", "brief")
    best = shared.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("neg"))).alias("p"))
    best = best.select("bucket", (-F.col("p.neg")).alias("rep"))
    pivots = best.join(briefs.select("rep", F.col("brief").alias("p_brief")), "rep").withColumnRenamed("rep", "pivot")
    pairs = slim.join(pivots, "bucket").filter((F.col("rep") != F.col("pivot")) & alike)
    pairs = pairs.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    tested = [stored(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "pairs")]
    found = stored(verify(tested[0], texts, k, least), "found")
    comps, _ = _merged(None, found)
    discard(found)
    # buckets of one component need neither texts nor bands again
    at = shared.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("comp"))
    ends = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    rest = stored(at.join(ends, "bucket", "left_semi"), "rest")
    fine = fine_sketch(texts.join(rest.select(F.col("rep").alias("id")), "id", "left_semi"), k)
    members = _open(rest.join(briefs.select("rep", "bands"), "rep").join(fine, "rep"))
    discard(shared, briefs, rest)

    # then those outside their bucket's main component: with some of its members, with more, with all others
    for some in (*SOME, None):
        if members.isEmpty():
            break
        p = members if some is None else members.filter(
            (F.col("comp") == F.col("main")) & (F.pmod(F.xxhash64("rep", "bucket"), F.greatest(F.lit(1), F.floor(F.col("n") / some))) == 0)
        )
        p = p.select("bucket", *[F.col(c).alias(f"p_{c}") for c in ("rep", "comp", "bands", *_WORDS)])
        # a pair of two outside is formed from one side, and one that shares several buckets in the least of them
        one_side = (F.col("p_comp") == F.col("main")) | (F.col("rep") < F.col("p_rep"))
        once = F.array_min(F.array_intersect("bands", "p_bands")) == F.col("bucket")
        outside = members.filter("comp <> main").select("bucket", "rep", "comp", "main", "bands", *_WORDS)
        pairs = outside.join(p, "bucket").filter((F.col("comp") != F.col("p_comp")) & one_side & finely & once)
        mine = F.col("rep") < F.col("p_rep")
        either = lambda x, y: F.when(mine, F.col(x)).otherwise(F.col(y))
        pairs = pairs.select(either("rep", "p_rep").alias("a"), either("p_rep", "rep").alias("b"), either("comp", "p_comp").alias("ca"), either("p_comp", "comp").alias("cb")).distinct()
        for before in tested:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        tested.append(stored(pairs.select("a", "b", "ca", "cb"), "pairs"))
        found = stored(verify(tested[-1], texts, k, least), "found")
        before, (comps, new) = comps, _merged(comps, found)
        moved = members.join(new.select(F.col("node").alias("comp"), F.col("root").alias("to")), "comp", "left")
        last, members = members, _open(moved.select("bucket", "rep", F.coalesce("to", "comp").alias("comp"), "bands", *_WORDS))
        discard(before, found, last)
    discard(texts, members, *tested)

    # stored, so that the join can split a group of copies that holds a large part of all rows
    by_copy = stored(firsts.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("copy_key", F.coalesce("root", "rep").alias("class_id")), "copies")
    own = sketches.select("id", "copy_key").join(by_copy, "copy_key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    result = own.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"))
    none = docs.filter(F.col(f"`{doc_id}`").isNull()).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"))
    return result.union(none)
