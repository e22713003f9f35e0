"""Embedding near-duplicates by sorted projection passes.

Every pass orders all distinct vectors lexicographically by concatenated bits of its own random projections and compares each
with its ``window`` successors; pairs with cosine >= ``THRESHOLD`` (double precision) are verified links. The first bits
split at medians and the later ones at the medians of the cell that the first ones lead to, so that a crowded cone is
split as finely as evenly spread vectors are. The medians come from a sample of at most ``SAMPLE`` distinct vectors (those
of the least digests, ``SAMPLE_BYTES`` at most); every vector takes part in every pass.

Links of all passes are united to components, and inside each component all links are counted by blocks of vectors, so
that ``n_links`` is complete within a component and no pair is ever a row. Equal vectors (128-bit digests of length,
width and bytes) form one class and count as often as they occur. Links between vectors that no pass brings within a window and no chain of links joins are missed. So
the first ``PROBES`` vectors of the sample are compared with all vectors, and rounds of further passes, each with twice the
window of the round before, follow until the passes have found ``TARGET`` of their links (of all, and on average over
the probes that have any). As the window reaches the number of vectors in the end, the rounds always stop.

Cases: null or zero vectors, and those with null or non-finite components, link with nothing; vectors of different
lengths do not link; a null ``vec_id`` stands alone with null component; repeated rows count as vectors of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, buckets, by_key, connected, exchange, segments, stored

THRESHOLD = 0.9
PASSES = 16
BITS = 32
WINDOW = 256
BLOCK = 512
SEED = 20240501
SAMPLE = 8192
SAMPLE_BYTES = 32 << 20
PROBES = 4096
LEVELS = 8  # bits that split at the medians of all cells before
CELL = 32  # sampled vectors that a cell has at least on average
TARGET = 0.95

_VECTORS = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary())])


def _digest(v: np.ndarray) -> bytes:
    """128 bits by which equal vectors are told: of the number of components, their width and their bytes."""
    return hashlib.blake2b(np.array([len(v), v.itemsize]).tobytes() + v.tobytes(), digest_size=16).digest()


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            row = {"vec_id": i, "digest": None, "dim": None, "vec": None}
            values = x.values
            if x.is_valid and i is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    raw = v.astype(np.float32)
                    keep = raw if (raw == v).all() else v  # single precision where that loses nothing
                    row |= {"digest": _digest(keep), "dim": len(v), "vec": keep.tobytes()}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=_VECTORS)


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in blobs])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(dim: int, number: int) -> np.ndarray:
    """Random directions of one pass."""
    return np.random.default_rng([SEED, dim, number]).standard_normal((dim, BITS))


def _sample(distinct: DataFrame) -> dict[int, tuple[list[int], np.ndarray]]:
    """Classes and unit vectors of a bounded sample for each length of vectors: those of the least digests."""
    widest = distinct.agg(F.max(F.length("vec"))).first()[0] or 1
    rows = distinct.orderBy("digest").select("cls", "dim", "vec").limit(max(1, min(SAMPLE, SAMPLE_BYTES // widest))).collect()
    dims = sorted({r.dim for r in rows})
    return {d: ([r.cls for r in rows if r.dim == d], _matrix([bytes(r.vec) for r in rows if r.dim == d], d)) for d in dims}


def _medians(x: np.ndarray, number: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Where one pass splits: for each of the first bits a place for each cell so far, for the others one for each last cell."""
    z = x @ _signs(x.shape[1], number)
    levels = max(0, min(LEVELS, int(np.log2(max(1, len(x) / CELL)))))
    cell, splits = np.zeros(len(x), dtype=np.int64), []
    for level in range(levels):
        splits.append(np.array([np.median(z[cell == c, level]) if (cell == c).any() else 0.0 for c in range(1 << level)]))
        cell = 2 * cell + (z[:, level] >= splits[-1][cell])
    last = [np.median(z[cell == c, levels:], axis=0) if (cell == c).any() else np.zeros(BITS - levels) for c in range(1 << levels)]
    return splits, np.array(last)


def _key(x: np.ndarray, number: int, places: tuple[list[np.ndarray], np.ndarray] | None) -> np.ndarray:
    """The bits of one pass as one number; without a sample of such vectors, the signs of the projections."""
    z = x @ _signs(x.shape[1], number)
    splits, last = places or ([], np.zeros((1, BITS)))
    key = np.zeros(len(x), dtype=np.int64)
    for level, at in enumerate(splits):
        key = 2 * key + (z[:, level] >= at[key])
    later = z[:, len(splits) :] >= last[key]
    return (key << later.shape[1]) + later @ (np.int64(1) << np.arange(later.shape[1] - 1, -1, -1, dtype=np.int64))


_SORTED = pa.schema([("pass", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("cls", pa.int64()), ("vec", pa.binary())])


def _keys(numbers: range, places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(part.column(2).to_pylist(), dim)
                for p in numbers:
                    key = _key(x, p, places.value.get((dim, p)))
                    yield batch(_SORTED, **{"pass": np.full(len(x), p, dtype=np.int32), "dim": np.full(len(x), dim, dtype=np.int32), "key": key, "cls": part.column(0), "vec": part.column(2)})

    return run


class _Forest:
    """Union-find that gives each joining link once."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[p]
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("side", pa.int64()), ("pass", pa.int32()), ("dim", pa.int32()), ("place", pa.int64()), ("cls", pa.int64()), ("vec", pa.binary())])
_LINKS_DDL = "a long, b long, side long, pass int, dim int, place long, cls long, vec binary"


def _compare(passes: np.ndarray, dims: np.ndarray, cls: np.ndarray, vecs: list[bytes], window: int, forest: _Forest, old: int = 0) -> list[tuple[int, int]]:
    """Verified links among ordered rows within the window; the first ``old`` rows are already compared among themselves."""
    out = []
    for key in sorted(set(zip(passes.tolist(), dims.tolist(), strict=True))):
        at = np.flatnonzero((passes == key[0]) & (dims == key[1]))
        x = _matrix([vecs[i] for i in at], key[1])
        for lo in range(0, len(at), BLOCK):
            hi = min(len(at), lo + BLOCK)
            s = x[lo:hi] @ x[lo : hi + window].T
            i, j = np.nonzero(s >= THRESHOLD)
            near = (j > i) & (j - i <= window) & (at[lo + np.minimum(j, len(at) - 1 - lo)] >= old)
            i, j = i[near], j[near]
            group = np.arange(min(len(at), hi + window) - lo)  # rows of this block that are joined already
            for begin, end in zip(*segments(i), strict=True):
                row, others = i[begin], j[begin:end]
                while len(others := others[group[others] != group[row]]):
                    a, b = int(cls[at[lo + row]]), int(cls[at[lo + others[0]]])
                    if forest.join(a, b):
                        out.append((a, b))
                    group[group == group[others[0]]] = group[row]
    return out


def _windows(window: int):
    """Ordered rows of one range -> links inside it, and its first and last rows for the neighbouring ranges."""

    def ends(side: int, first: int, rows: tuple) -> pa.RecordBatch:
        p, d, c, v = rows
        n = len(p)
        return batch(_LINKS, a=[None] * n, b=[None] * n, side=np.full(n, side), **{"pass": p, "dim": d}, place=np.arange(first, first + n), cls=c, vec=v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        forest, tail, head = _Forest(), None, None
        for b in batches:
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist())
            if not b.num_rows:
                continue
            old = 0
            if tail is not None:
                old = len(tail[0])
                now = (*(np.concatenate([t, x]) for t, x in zip(tail[:3], now[:3], strict=True)), tail[3] + now[3])
            links = _compare(*now, window, forest, old)
            yield batch(_LINKS, a=[x for x, _ in links], b=[y for _, y in links], **{k: [None] * len(links) for k in ("side", "pass", "dim", "place", "cls", "vec")})
            if head is None or len(head[0]) < window:
                head = tuple(x[:window] for x in now)
            tail = tuple(x[-window:] for x in now)
        if head is not None:
            yield ends(part - 1, window, head)
            yield ends(part, 0, tail)

    return run


def _seams(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "side"):
            links = _compare(np.array([r["pass"] for r in rows]), np.array([r["dim"] for r in rows]), np.array([r["cls"] for r in rows], dtype=np.int64), [r["vec"] for r in rows], window, _Forest())
            yield batch(_LINKS, a=[x for x, _ in links], b=[y for _, y in links], **{k: [None] * len(links) for k in ("side", "pass", "dim", "place", "cls", "vec")})

    return run


def pass_links(distinct: DataFrame, sample: dict[int, tuple[list[int], np.ndarray]], numbers: range, window: int = WINDOW) -> DataFrame:
    """Spanning links (a, b) between classes that the passes of these numbers verify."""
    n = distinct.count() * len(numbers)
    parts = max(1, min(buckets(distinct.sparkSession) // 4, n // (16 * window)))
    places = distinct.sparkSession.sparkContext.broadcast({(d, p): _medians(x, p) for d, (_, x) in sample.items() for p in numbers})  # at most BITS x 2^LEVELS numbers a pass
    keyed = distinct.select("cls", "dim", "vec").mapInArrow(_keys(numbers, places), "pass int, dim int, key long, cls long, vec binary")
    order = ["pass", "dim", "key", "cls"]
    found = stored(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(window), _LINKS_DDL))
    # the last rows of one range and the first of the next have the same ``side``
    seams = exchange(found.filter("a is null"), 4 * parts, "side", "pass", "dim", "place").mapInArrow(_seams(window), _LINKS_DDL)
    return found.filter("a is not null").select("a", "b").unionByName(seams.select("a", "b"))


def recall(distinct: DataFrame, roots: DataFrame, sample: dict[int, tuple[list[int], np.ndarray]]) -> float:
    """Share of the probes' links, by comparison with all vectors, whose ends are in one component: the lesser of the share
    of all their links and its average over the probes that have any. 1 where they have none."""
    spark = distinct.sparkSession
    probes = {d: (c[:PROBES], x[:PROBES]) for d, (c, x) in sample.items()}
    asked = spark.createDataFrame([(c,) for cs, _ in probes.values() for c in cs], "cls long")
    root = {r.cls: r.root for r in asked.join(roots, asked.cls == roots.node).select("cls", "root").collect()}  # one row a probe at most
    sent = spark.sparkContext.broadcast({d: (np.array(c), x, np.array([root.get(k, k) for k in c])) for d, (c, x) in probes.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((2, len(c)), dtype=np.int64) for d, (c, _, _) in sent.value.items()}
        for b in batches:
            dims, cls, tops = (b.column(k).to_numpy() for k in (0, 1, 2))
            for dim in set(np.unique(dims).tolist()) & set(sums):
                c, x, r = sent.value[dim]
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), BLOCK):
                    at = rows[lo : lo + BLOCK]
                    near = (_matrix(b.column(3).take(pa.array(at)).to_pylist(), dim) @ x.T >= THRESHOLD) & (cls[at][:, None] != c)
                    sums[dim] += np.stack([near.sum(axis=0), (near & (tops[at][:, None] == r)).sum(axis=0)])
        for dim, (links, found) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[dim][0][links > 0]), pa.array(links[links > 0]), pa.array(found[links > 0])], names=["cls", "links", "found"])

    placed = distinct.join(roots, distinct.cls == roots.node, "left").select("dim", "cls", F.coalesce("root", "cls").alias("root"), "vec")
    per = placed.mapInArrow(compare, "cls long, links long, found long").groupBy("cls").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    got = per.agg(F.sum("found") / F.sum("links"), F.avg(F.col("found") / F.col("links"))).first()
    return 1.0 if got[0] is None else min(got)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a pair of blocks of a component: linked copies of each class on the other side."""
    schema = pa.schema([("cls", pa.int64()), ("linked", pa.int64())])
    for _, rows in by_key(batches, "pair"):
        for dim in sorted({r["dim"] for r in rows}):
            left = [r for r in rows if r["dim"] == dim and r["side"] == 0]
            same = bool(left) and left[0]["same"]
            right = left if same else [r for r in rows if r["dim"] == dim and r["side"] == 1]
            if not left or not right:
                continue
            x, y = _matrix([r["vec"] for r in left], dim), _matrix([r["vec"] for r in right], dim)
            s = (x @ y.T >= THRESHOLD).astype(np.int64)
            if same:
                np.fill_diagonal(s, 0)
            yield batch(schema, cls=[r["cls"] for r in left], linked=s @ np.array([r["copies"] for r in right], dtype=np.int64))
            if not same:
                yield batch(schema, cls=[r["cls"] for r in right], linked=s.T @ np.array([r["copies"] for r in left], dtype=np.int64))


def near_duplicates(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    n = buckets(spark)
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_valid, "vec_id long, digest binary, dim int, vec binary"))
    good = rows.filter("digest is not null")
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    firsts = good.join(classes, "digest").filter("vec_id = class_id").dropDuplicates(["digest"])
    distinct = stored(firsts.select(F.monotonically_increasing_id().alias("cls"), "digest", "dim", "vec", "class_id", "copies"))  # numbers hold once they are written
    sample, rounds, roots = _sample(distinct), 0, None
    while roots is None or recall(distinct, roots, sample) < TARGET:
        links = pass_links(distinct, sample, range(rounds * passes, (rounds + 1) * passes), window << rounds)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected(stored(links), spark)
        rounds += 1
    members = distinct.join(roots, distinct.cls == roots.node).select("root", "cls", "dim", "vec", "copies")
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.expr("pmod(xxhash64(cls), blocks)").cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"), "cls", "dim", "vec", "copies")
    degree = exchange(paired, n, "pair").mapInArrow(_count, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))
    comp = distinct.join(roots, distinct.cls == roots.node, "left").select("cls", "digest", "class_id", "copies", F.coalesce("root", "cls").alias("root"))
    least = comp.groupBy("root").agg(F.min("class_id").alias("component_id"))
    comp = comp.join(least, "root").join(degree, "cls", "left").select("digest", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "digest").join(comp, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
