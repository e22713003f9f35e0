"""Spark-side helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def records(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (and ``more``) in the types that operators take.

    Rows go to Python in batches of BATCH_ROWS, so that whole texts need little memory on either side; a session that asks
    for smaller ones keeps its own."""
    spark = docs.sparkSession
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets of an exchange: four to each of the session's shuffle partitions, which follow the input.

    A task takes one bucket after the other, so its Python memory is that of a bucket."""
    return 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where that is unset on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (local tests) a folder is made. Shuffle
    files serve recovery while the rows are being written; then Spark drops them, as nothing reads them any more. The files
    themselves go with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def exchange(df: DataFrame, n: int, key: str = "bucket", *then: str) -> DataFrame:
    """Deal rows of ``n`` buckets out by ``key`` and let each task see one bucket after the other."""
    return df.repartition(max(1, n // 4), key).sortWithinPartitions(key, *then)


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows of equal ``key`` as (key, rows); rows hold payload blobs, so they are few."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r[key] != at:
                yield at, rows
                rows = []
            at = r[key]
            rows.append(r)
    if rows:
        yield at, rows


def by_group(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive rows of equal ``key`` (not null) as (key, one batch of them), for rows of plain columns."""
    at, held = None, []

    def close() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy()
        for lo, hi in zip(*segments(keys), strict=True):
            if held and keys[lo] != at:
                yield at, close()
                held = []
            at = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield at, close()


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


def u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark longs (same bits)."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the high bits of a hash; order of buckets is the order of hashes."""
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return begin, np.append(begin[1:], len(keys))


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo ``n``: the contracts' fold rule (null id: null)."""
    return F.expr(f"pmod(crc32(cast({doc_id} as string)), {n})")


def connected(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable over ``edges`` (a, b); only nodes with an edge are returned.

    Alternating large-star and small-star steps until every component is a star: every step is one grouped minimum and one
    join on the node, no group is ever gathered. Each task first shrinks its own edges to a spanning star forest, which
    keeps the steps few (their number grows with the logarithm of the edges). Raises where ``rounds`` steps don't do."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            r = x
            while (p := parent.setdefault(r, r)) != r:
                r = p
            while parent[x] != r:
                parent[x], x = r, parent[x]
            return r

        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ra, rc = root(a), root(c)
                if ra != rc:
                    parent[max(ra, rc)] = min(ra, rc)
        flat = [(x, root(x)) for x in list(parent)]
        flat = [(x, r) for x, r in flat if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in flat], pa.int64()), pa.array([r for _, r in flat], pa.int64())], names=["u", "v"])

    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = stored(e.mapInArrow(contract, "u long, v long").distinct())  # u > v
    for _ in range(rounds):
        if _is_star(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    raise RuntimeError(f"components are not found after {rounds} steps")


def _is_star(e: DataFrame) -> bool:
    """Does every node of the distinct edges (u, v) have one parent, and no parent a parent?"""
    up = e.groupBy("u").agg(F.count("*").alias("n"))
    bad = up.join(e.select(F.col("v").alias("u"), F.lit(1).alias("p")).distinct(), "u", "left").filter("n > 1 or p is not null")
    return bad.isEmpty()
