"""The k most similar vectors of every vector, by multi-index hashing.

1. A rotation is learned on a bounded sample (principal axes, then iterative quantisation), so that the signs of a rotated vector
   form a 64-bit code whose Hamming distance follows the angle.
2. Vectors are routed to leaves by anchors (means of a few near rows of the sample, several thousand), each of which belongs to a leaf:
   the home leaf is that of the nearest anchor. A vector near the plane between that anchor and one of another leaf goes there as
   well, but to ``most`` leaves at most in all, and it is a query only in its home leaf, so each query ends in one task. Each leaf is
   a partition of its own, of up to WIDE times ``leaf_rows`` rows: few leaves part few neighbours. The task that holds it divides it
   again in the same way to ``leaf_rows``, with anchors learned from its own rows, which no bounded sample of a large table shows.
3. In a leaf the codes are split into eight substrings, each indexed. By the pigeonhole principle two codes within Hamming distance
   7 share a substring, so probing the eight tables returns every code of that radius (and most within ``radius``). A query that
   this leaves with fewer than k candidates probes the substrings at distance 1, which covers all codes within 15, then at distance 2,
   which covers 23, and so on, until it has 3 k. The candidates are reranked by their floats, the best by cosine in double precision.

Costs at scale: one shuffle by id (latest row), one by leaf (at most ``most`` times the vectors), narrow otherwise; what finds
the hot directions carries two numbers a row. Vectors of one
direction, whatever their length, are collapsed to their k + 1 smallest ids before routing, so that a hot group never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, RADIUS, LEAF_ROWS, MARGIN, MOST = 10, 16, 16_384, 0.1, 4
#: Bounds of the sample that the rotation and the routing are fitted on: N / 32 rows, between these.
SAMPLE_LEAST, SAMPLE_MOST = 20_000, 400_000
#: Routing: anchors a leaf at most, anchors in a cell, cells that are looked through for a row.
ANCHORS, CELL, PROBES = 256, 16, 48
#: A leaf that is shuffled holds so many times ``leaf_rows`` at most, and less while there would be fewer than TASKS of them; its task divides it to ``leaf_rows``, knowing all its rows.
WIDE, TASKS = 8, 32
#: Decimals of a unit vector's components to which directions count as one, and the share of all rows from which a group of one direction is joined by broadcast (so at most 1 / HOT_SHARE groups are).
DECIMALS, HOT_SHARE = 5, 1e-4
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


@dataclass
class Model:
    """mean and rotation of the codes; the routing as arrays: centres of cells of anchors, where each cell's anchors begin, the anchors, the leaf of each; and the margin."""

    mean: np.ndarray
    rotation: np.ndarray
    centres: np.ndarray
    begins: np.ndarray
    anchors: np.ndarray
    leaf: np.ndarray
    margin: float

    def __post_init__(self) -> None:
        self.leaves = int(self.leaf.max()) + 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (iterative quantisation over principal axes) of unit rows ``x``."""
    dim = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dim)
    _, axes = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(dim))
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    for _ in range(rounds if len(x) > 1 else 0):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return mean, axes @ r


def _halves(x: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` by two means, neither side below a quarter of the weight if a row's own weight allows."""
    s, w = x[rows], weight[rows]
    some = s[:: -(-len(s) // 4_000)]
    _, axes = np.linalg.eigh(np.cov((some - some.mean(0)).T))
    at = (s - np.average(s, axis=0, weights=w)) @ axes[:, -1].astype(s.dtype)
    for _ in range(7):
        order = np.argsort(at, kind="stable")
        upto = np.cumsum(w[order])
        low, high = np.clip(np.searchsorted(upto, [upto[-1] * 0.25, upto[-1] * 0.75]), 1, len(rows) - 1)
        cut = int(np.clip(np.searchsorted(at[order], 0), low, high))
        left, right = order[:cut], order[cut:]
        a, b = np.average(s[left], axis=0, weights=w[left]), np.average(s[right], axis=0, weights=w[right])
        at = (s - (a + b) / 2) @ (b - a)
    return rows[left], rows[right]


def _parts(x: np.ndarray, weight: np.ndarray, most: float) -> list[np.ndarray]:
    """The rows in parts of weight ``most`` at most, halved by two means; rows that are all equal stay together."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if weight[rows].sum() <= most or len(rows) < 2 or not np.ptp(x[rows], axis=0).any():
            parts.append(rows)
        else:
            todo += _halves(x, weight, rows)[::-1]
    return parts


def _means(x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The means of the rows of each owner that has any, and their numbers."""
    count = np.bincount(owner, minlength=n)
    total = np.stack([np.bincount(owner, x[:, j], n) for j in range(x.shape[1])], axis=1)
    return (total[count > 0] / count[count > 0, None]).astype(np.float32), count[count > 0]


def _lloyd(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """``n`` means of the rows, or fewer."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        half = (c * c).sum(1) / 2
        c, _ = _means(x, np.concatenate([(half - x[i : i + 10_000] @ c.T).argmin(1) for i in range(0, len(x), 10_000)]), len(c))
    return c


def _cells(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of cells of about CELL anchors, the anchors' order by cell, and where each cell begins in it."""
    centres = _lloyd(anchors, max(1, len(anchors) // CELL), 5)
    half = (centres * centres).sum(1) / 2
    of = np.concatenate([(half - anchors[i : i + 10_000] @ centres.T).argmin(1) for i in range(0, len(anchors), 10_000)])
    return centres, np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(len(centres) + 1))


def _near(x: np.ndarray, centres: np.ndarray, begins: np.ndarray, anchors: np.ndarray, each: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, half its squared distance less a constant of the row) by distance: three times the ``each`` nearest, ``each`` at most from each of the ``probes`` nearest cells (-1, inf where there are fewer)."""
    probes = min(probes, len(centres))
    half, own = (centres * centres).sum(1) / 2, (anchors * anchors).sum(1) / 2
    which, far = np.full((len(x) * probes, each), -1, np.int64), np.full((len(x) * probes, each), np.inf, np.float32)
    cell = np.empty((len(x), probes), np.int64)
    for i in range(0, len(x), 10_000):
        d = half - x[i : i + 10_000] @ centres.T
        cell[i : i + 10_000] = np.argpartition(d, probes - 1, axis=1)[:, :probes]
    order = np.argsort(cell.ravel(), kind="stable")
    start = np.searchsorted(cell.ravel()[order], np.arange(len(centres) + 1))
    for c in np.flatnonzero(np.diff(start)):
        a, b = begins[c], begins[c + 1]
        for i in range(start[c], start[c + 1], 10_000):
            at = order[i : min(i + 10_000, start[c + 1])]
            d = own[a:b] - x[at // probes] @ anchors[a:b].T
            n = min(each, b - a)
            if n:
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                which[at, :n], far[at, :n] = best + a, np.take_along_axis(d, best, 1)
    which, far = which.reshape(len(x), -1), far.reshape(len(x), -1)
    if far.shape[1] > 3 * each:
        some = np.argpartition(far, 3 * each - 1, axis=1)[:, : 3 * each]
        which, far = np.take_along_axis(which, some, 1), np.take_along_axis(far, some, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(which, order, 1), np.take_along_axis(far, order, 1)


def learn_routing(x: np.ndarray, leaf: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Anchors over unit rows, each with the leaf it belongs to: means of a few rows near each other, joined to leaves of ``leaf`` rows at most.

    A leaf is bounded by what lies nearest to its anchors, not by planes through the whole, so that a group of near rows is seldom cut.
    """
    x = x.astype(np.float32)
    if not len(x):
        x = np.zeros((1, x.shape[1]), np.float32)
    parts = _parts(x, np.ones(len(x), np.float32), leaf)
    anchors = np.concatenate([_lloyd(x[rows], min(ANCHORS, -(-len(rows) // 4)), 3) for rows in parts])
    for _ in range(3):
        centres, order, begins = _cells(anchors)
        nearest = np.concatenate([_near(x[i : i + 50_000], centres, begins, anchors[order], 1, 8)[0][:, 0] for i in range(0, len(x), 50_000)])
        anchors, weight = _means(x, nearest, len(anchors))
    number = np.empty(len(anchors), np.int64)
    for n, rows in enumerate(_parts(anchors, weight.astype(np.float32), leaf)):
        number[rows] = n
    centres, order, begins = _cells(anchors)
    return centres, begins, anchors[order], number[order], margin


def route(x: np.ndarray, model: Model, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is home) of unit rows ``x``: the leaf of the nearest anchor, and the leaves of the next ones where the row lies within the margin of the plane between, ``most`` in all."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
    for i in range(0, len(x), 10_000):
        which, far = _near(x[i : i + 10_000].astype(np.float32), model.centres, model.begins, model.anchors, 4)
        leaf, a = model.leaf[which], model.anchors
        far -= far[:, :1]
        taken = np.full((len(which), most), -1)
        taken[:, 0], count = leaf[:, 0], np.ones(len(which), np.int64)
        for j in range(1, which.shape[1]):
            rows = np.flatnonzero((count < most) & (which[:, j] >= 0) & (far[:, j] <= 2 * model.margin))  # anchors are at most 2 apart
            rows = rows[(taken[rows] != leaf[rows, j, None]).all(1)]
            rows = rows[far[rows, j] <= model.margin * np.linalg.norm(a[which[rows, j]] - a[which[rows, 0]], axis=1)]
            taken[rows, count[rows]] = leaf[rows, j]
            count[rows] += 1
        row, place = np.nonzero(taken >= 0)
        out.append((row + i, taken[row, place], place == 0))
    return tuple(np.concatenate(c) for c in zip(*out))


def direction_hash(x: np.ndarray) -> np.ndarray:
    """A hash of each unit row, its components rounded to DECIMALS."""
    z = np.floor(x * 10.0**DECIMALS + 0.5).astype(np.int64).view(np.uint64)
    z = (z ^ (z >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    odd = np.random.default_rng(11).integers(0, 1 << 63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    return (z * odd).sum(axis=1, dtype=np.uint64).view(np.int64)


def codes_of(x: np.ndarray, model: Model) -> np.ndarray:
    """64-bit codes: the signs of the rotated rows (shorter vectors leave the upper bits 0)."""
    bits = (x - model.mean) @ model.rotation[:, :64] > 0
    full = np.zeros((len(x), 64), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.uint64).ravel()


def _tables(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight substrings: its value in every row, the rows by value, and where each value's rows begin and how many they are."""
    subs = codes.view(np.uint8).reshape(-1, 8)
    out = []
    for j in range(8):
        sizes = np.bincount(subs[:, j], minlength=256)
        out.append((subs[:, j].copy(), np.argsort(subs[:, j], kind="stable").astype(np.int32), np.cumsum(sizes) - sizes, sizes))
    return out


def _probe(codes: np.ndarray, tables: list, queries: np.ndarray, radius: int, mask: int = 0, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs whose codes differ by ``mask`` in a substring and lie within ``radius``, in blocks; for mask 0 each pair once."""
    for j, (sub, order, starts, sizes) in enumerate(tables):
        own = sub[queries] ^ np.uint8(mask)
        counts, first = sizes[own], starts[own]
        ends = np.cumsum(counts)
        cut = 0
        earlier = np.uint64((1 << (8 * j)) - 1)
        while cut < len(queries):
            done = ends[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(ends, done + block, side="right")))
            c = counts[cut:stop]
            total = int(c.sum())
            q = np.repeat(queries[cut:stop], c)
            r = order[np.arange(total) + np.repeat(first[cut:stop] - (np.cumsum(c) - c), c)]
            x = codes[q] ^ codes[r]
            keep = (np.bitwise_count(x) <= radius) & (r != q)
            if j and not mask:  # met in an earlier table: one of the lower bytes is equal there
                low = x | ~earlier
                keep &= ((low - _LOW) & ~low & _HIGH) == 0
            yield q[keep], r[keep]
            cut = stop


def nearest_in_leaf(x: np.ndarray, home: np.ndarray, model: Model, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of the home rows; rows are in order of their ids, which breaks ties."""
    full = unit(x)
    small = full.astype(np.float32)
    queries = np.flatnonzero(home).astype(np.int32)
    codes = codes_of(full, model)
    tables = _tables(codes)
    n = len(x)
    width = max(1, int(n - 1).bit_length())
    best = np.empty(0, np.int64)
    floor = np.full(n, -1.0, np.float32)

    def key(q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return ((q.astype(np.int64) << np.int64(22 + width)) | (np.rint((1 - s) * 1e6).astype(np.int64).clip(0, (1 << 22) - 1) << np.int64(width))) | r.astype(np.int64)

    def top(keys: np.ndarray, most: int) -> np.ndarray:
        keys = np.sort(keys)
        q = keys >> np.int64(22 + width)
        new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        start = np.flatnonzero(new)
        pos = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return keys[pos < most]

    def rerank(best: np.ndarray, q: np.ndarray, r: np.ndarray, spare: int, again: bool) -> np.ndarray:
        parts = []
        for i in range(0, len(q), 200_000):
            a, b = q[i : i + 200_000], r[i : i + 200_000]
            s = np.einsum("ij,ij->i", small[a], small[b])
            good = s > floor[a] - 2e-6
            parts.append(key(a[good], b[good], s[good]))
        best = np.concatenate([best, *parts])
        if again:
            best = np.sort(best)
            best = best[np.r_[True, best[1:] != best[:-1]]] if len(best) else best
        best = top(best, spare)
        q_of = best >> np.int64(22 + width)
        full_rows = np.flatnonzero(np.bincount(q_of, minlength=n) >= spare)
        last = np.searchsorted(q_of, full_rows, side="right") - 1
        floor[full_rows] = 1 - ((best[last] >> np.int64(width)) & ((1 << 22) - 1)) / 1e6
        return best

    for q, r in _probe(codes, tables, queries, radius):
        best = rerank(best, q, r, k + 6, False)
    least, left = min(k, n - 1), queries
    for far in range(1, 9):  # the substrings at distance ``far``: with those before, every code within 8 * far + 7
        found = np.bincount(best >> np.int64(22 + width), minlength=n)
        left = left[found[left] < least]
        if not len(left):
            break
        least = min(3 * k, n - 1)  # where codes tell little apart, so many candidates are needed for a good choice
        poor = np.isin(best >> np.int64(22 + width), left)
        own, rest = best[poor], best[~poor]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for mask in (m for m in range(256) if m.bit_count() == far):
            for q, r in _probe(codes, tables, left, max(radius, 8 * far + 7), mask):
                waiting.append((q, r))
                if sum(len(w[0]) for w in waiting) > 500_000:
                    own = rerank(own, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), 3 * k, True)
                    waiting = []
        if waiting:
            own = rerank(own, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), 3 * k, True)
        best = np.sort(np.concatenate([rest, own]))
    q, r = best >> np.int64(22 + width), best & ((1 << width) - 1)
    cos = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", full[q[i : i + 100_000]], full[r[i : i + 100_000]]) for i in range(0, len(q), 100_000))])
    cos = np.round(cos, 6)
    order = np.lexsort((r, -cos, q))
    q, r, cos = q[order], r[order], cos[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    pos = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[pos < k], r[pos < k], cos[pos < k]


def neighbours(x: np.ndarray, home: np.ndarray, model: Model, k: int, radius: int, leaf_rows: int, margin: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, neighbour, cosine) of the home rows of one leaf; one of more than twice ``leaf_rows`` rows is divided by a routing of its own."""
    if len(x) > 2 * leaf_rows:
        full = np.concatenate([unit(x[i : i + 50_000]).astype(np.float32) for i in range(0, len(x), 50_000)])
        learn = full[:: max(1, len(full) // 40_000)]
        tree = Model(model.mean, model.rotation, *learn_routing(learn, max(1, leaf_rows * len(learn) // len(full)), margin))
        if tree.leaves > 1:
            row, leaf, own = route(full, tree, most)
            del full, learn
            order = np.lexsort((row, leaf))
            row, leaf, own = row[order], leaf[order], own[order]
            start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            for a, b in zip(start, np.r_[start[1:], len(leaf)]):
                rows = row[a:b]
                q, r, cos = nearest_in_leaf(x[rows], home[rows] & own[a:b], model, k, radius)
                yield rows[q], rows[r], cos
            return
    yield nearest_in_leaf(x, home, model, k, radius)


def latest_vectors(df: DataFrame, key: str, vector: str, at: str, dim: int) -> DataFrame:
    """(id, v): the vector of each id's latest row, where it is ``dim`` long, finite and not all zero. A null time counts as the oldest;
    of rows of one time a vector goes before null, and the greater one before the smaller."""
    newest = df.select(F.col(key).alias("id"), F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col(vector).cast("array<float>").alias("v"))
    last = newest.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("at", "v")).getField("v").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return last.filter((F.size("v") == dim) & finite & F.exists("v", lambda e: e != 0))


def fit(df: DataFrame, key: str, vector: str, dim: int, rows: int, leaf_rows: int, margin: float) -> Model:
    """The model from a bounded sample: the ids whose hashes come first, about N / 32 of them within SAMPLE_LEAST and SAMPLE_MOST."""
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, rows // 32))
    good = df.filter((F.size(vector) == dim) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(vector, lambda e: e != 0))
    whole = 1 << 63
    upto = -whole + int(2 * whole * min(1.0, size / max(1, rows)))  # so many ids lie below it that about ``size`` are taken
    taken = good.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("h") < min(upto, whole - 1))
    sample = taken.groupBy("h").agg(F.max("v").alias("v")).toArrow().sort_by("h")  # an id once, however often it is repeated
    flat = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if sample.num_rows else np.empty(0)
    x = unit(flat.reshape(-1, dim)) if len(flat) else np.empty((0, dim))
    x = x[np.sort(np.unique(direction_hash(x), return_index=True)[1])]  # a direction once, as in the leaves
    mean, rotation = learn_rotation(x[:20_000])
    wide = min(WIDE * leaf_rows, max(leaf_rows, rows // TASKS))
    leaf = max(64, int(len(x) * wide / max(1, rows)))
    return Model(mean, rotation, *learn_routing(x, leaf, margin))


def similar_vectors(
    df: DataFrame, key: str, vector: str, at: str, k: int = K, dim: int = 64, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, margin: float = MARGIN, most: int = MOST
) -> DataFrame:
    """(id, neighbour_id, similarity): the k most similar other ids of every id with a usable vector.

    similarity: the cosine in double precision, rounded to 6 decimals; of equals the smaller id (by bytes) comes first. An id counts
    with its latest row; vectors that are null, of another length, all zero or not finite take no part; null ids take no part. Where
    more than k + 1 vectors have one direction (to DECIMALS), those besides the k + 1 smallest ids find the smallest with similarity 1
    and are nobody's neighbours. Repeated rows of an id are one. A table without usable vectors gives no rows. Further columns are
    not read.
    """
    rows = df.count()  # from Parquet footers alone
    model = fit(df, key, vector, dim, rows, leaf_rows, margin)
    last = latest_vectors(df, key, vector, at, dim)
    key_type = df.schema[key].dataType.simpleString()

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(direction_hash(unit(x)) if len(x) else np.empty(0, np.int64))], names=["id", "h"])

    hashed = last.mapInArrow(directions, f"id {key_type}, h bigint")  # four reads of one shuffle
    # a hot direction: only its k + 1 smallest ids can be anyone's neighbours; the group limit also holds before the shuffle
    heads = hashed.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("n") <= k + 1)
    crowded = heads.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") == k + 1)  # k + 1 ids at most
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.filter(F.col("n") >= max(float(k + 2), HOT_SHARE * rows)).select("h"))  # at most 1 / HOT_SHARE rows
    hottest = F.broadcast(crowded.join(hot, "h", "left_semi"))
    one_of = hashed.join(hottest, "h").unionByName(hashed.join(hot, "h", "left_anti").join(crowded.join(hot, "h", "left_anti"), "h"))
    surplus = one_of.filter(~F.array_contains("ids", F.col("id")))
    kept = last.join(surplus.select("id"), "id", "left_anti")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1)
            x = unit(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            row, leaf, home = route(x, model, most)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(home), batch.column(0).take(take), v.take(take)], names=["leaf", "home", "id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one leaf
        if not parts:
            return
        group = pa.Table.from_batches(parts)
        ids = group["id"].combine_chunks()
        order = pc.sort_indices(ids)
        ids, home = ids.take(order), group["home"].combine_chunks().take(order).to_numpy(zero_copy_only=False)
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order.to_numpy()]
        for q, r, cos in neighbours(x, home, model, k, radius, leaf_rows, margin, most):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), ids.take(pa.array(r)), pa.array(cos)], names=["id", "neighbour_id", "similarity"])

    routed = kept.mapInArrow(send, f"leaf int, home boolean, id {key_type}, v array<float>")
    found = routed.repartitionById(model.leaves, "leaf").select("home", "id", "v").mapInArrow(search, f"id {key_type}, neighbour_id {key_type}, similarity double")
    copies = surplus.select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    return found.unionByName(copies)
