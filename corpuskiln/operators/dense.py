"""A stored index of vectors: cells around coarse centroids, as Parquet partitions that a search prunes.

The exact search is the default. It searches the cells nearest to a query first, takes the score that the last of its ``top`` hits
has there, and then searches every other cell that can hold a vector as near: no vector of a cell is nearer to a query than the angle
between query and centroid, less the cell's radius (its greatest angle). In this second step cells that lie together are one block of
about ``CORPUS_PART`` rows, so that a query that many cells can serve is sent once for each block, not once for each cell. With ``probes`` it ends after that many cells, and
``recall`` measures what that loses.

Centroids are fitted on a bounded sample (``sample_rows``, least hashes of the ids); every row is indexed. Vectors that are null or
hold null or non-finite components are left out, zero vectors have a cell of their own and a score of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.operators import search as S
from corpuskiln.operators.state import unseen
from corpuskiln.operators.store import shared_place

FIRST = 4  # cells of a query that the exact search looks at first


def _strips(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of which a matrix with ``width`` columns has at most ``PAIRS_HELD`` / 4 cells: a task holds several such."""
    step = max(1, S.PAIRS_HELD // 4 // max(1, width))
    for lo in range(0, b.num_rows, step):
        yield b.slice(lo, step)


def _usable(vec: str) -> Column:
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & good, F.lit(False))


def _to_cells(centres: np.ndarray, numbers: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from unit rows to their cosines to the centroids of the cells ``numbers``; -1 for the cell of zero vectors."""
    central = numbers < len(centres)

    def run(x: np.ndarray) -> np.ndarray:
        near = np.full((len(x), len(numbers)), -1.0)
        near[:, central] = x @ centres[numbers[central]].T if central.any() else 0
        return near

    return run


@dataclass
class DenseIndex:
    """Index at ``place``: folders ``centroids`` (cell, centre), ``cells`` (rows by cell) and ``stats`` (radius and rows of each cell)."""

    spark: SparkSession
    place: str

    @staticmethod
    def build(points: DataFrame, place: str, cell_rows: int = 2000, most_cells: int = 4096, sample_rows: int = 65_536, seed: int = 7) -> DenseIndex:
        """Indexes ``points`` (point_id, vec and any columns that searches filter by) in cells of about ``cell_rows`` rows.

        There are at most ``most_cells`` of them, so that the centroids stay small enough for every task; a cell may be of any size,
        as its rows are dealt to several tasks."""
        spark = points.sparkSession
        usable = points.filter(_usable("vec")).withColumn("vec", F.col("vec").cast("array<double>"))
        n, narrow, wide = usable.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if narrow != wide:
            raise ValueError("vectors of one table must have one number of components")
        cells = int(min(most_cells, max(1, n // cell_rows)))
        some = usable.filter(F.exists("vec", lambda v: v != 0)).orderBy(F.xxhash64("point_id"), "point_id").limit(sample_rows)
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, sample_rows) // 1000))
        some = some.select(array_to_vector("vec").alias("features")).repartition(parts)
        centres = []
        if not some.isEmpty():
            centres = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=8, seed=seed).fit(some).clusterCenters()
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]  # at most most_cells
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{place}/centroids")
        index = DenseIndex(spark, place)
        index._append(usable)
        return index

    def add(self, points: DataFrame) -> None:
        """Adds rows whose ids are not there yet; the centroids stay, the radii grow."""
        usable = points.filter(_usable("vec")).withColumn("vec", F.col("vec").cast("array<double>"))
        self._append(unseen(usable, self.rows().select("point_id"), ["point_id"]))

    def _append(self, points: DataFrame) -> None:
        """The radii are written before the rows: if a job dies between, searches look at more cells than they need, and lose none."""
        placed = self._placed(points)
        stats = placed.groupBy("cell").agg(F.max(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "near"))) + 1e-7).alias("radius"), F.count("*").alias("n"))
        stats.coalesce(1).write.mode("append").parquet(f"{self.place}/stats")
        placed.drop("near").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.place}/cells")
        self.__dict__.pop("stats", None)

    def _placed(self, points: DataFrame) -> DataFrame:
        """Points with the cell of their nearest centroid and the cosine to it; zero vectors go to the cell behind the last."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in _strips(batch, len(centres))):
                x = S.unit_rows(b.column("vec"))
                cell, near = np.full(len(x), len(centres), np.int32), np.full(len(x), -1.0)
                some = np.flatnonzero(np.any(x != 0, axis=1))
                if len(centres) and len(some):
                    s = x[some] @ centres.T
                    cell[some] = s.argmax(axis=1)
                    near[some] = s.max(axis=1)
                yield b.append_column("cell", pa.array(cell)).append_column("near", pa.array(near))

        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())]))

    @cached_property
    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.place}/centroids").orderBy("cell").collect()  # at most most_cells
        x = np.array([r.centre for r in found]).reshape(len(found), -1 if found else 0)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    @cached_property
    def stats(self) -> dict[int, tuple[float, int]]:
        """Radius and rows of each cell that has rows."""
        found = self.spark.read.parquet(f"{self.place}/stats").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
        return {r.cell: (r.radius, r.n) for r in found.collect()}  # at most most_cells + 1

    def rows(self) -> DataFrame:
        """All indexed rows."""
        return self.spark.read.parquet(f"{self.place}/cells")

    def _blocks(self) -> dict[int, int]:
        """Block of each cell: cells in the order of their centroids' main direction, joined to blocks of about ``CORPUS_PART`` rows."""
        cells = sorted(c for c in self.stats if c < len(self.centres))
        if cells:
            own = self.centres[cells]
            cells = np.array(cells)[np.argsort(own @ np.linalg.svd(own - own.mean(axis=0), full_matrices=False)[2][0], kind="stable")].tolist()
        out, block, held = {}, 0, 0
        for c in [*cells, *(c for c in self.stats if c >= len(self.centres))]:  # at most most_cells + 1
            if held and held + self.stats[c][1] > S.CORPUS_PART:
                block, held = block + 1, 0
            out[c], held = block, held + self.stats[c][1]
        return out

    def _routes(self, asked: DataFrame, probes: int, blocks: dict[int, int] | None = None) -> DataFrame:
        """(query_id, vec, block) of queries (query_id, vec, floor): the ``probes`` nearest cells, each its own block, or the ``blocks`` with other
        cells that can reach the floor."""
        centres, numbers = self.centres, np.array(sorted(self.stats), np.int32)
        radii = np.array([self.stats[c][0] for c in numbers.tolist()])
        central = numbers < len(centres)
        cosines = _to_cells(centres, numbers)
        block = numbers if blocks is None else np.array([blocks[c] for c in numbers.tolist()], np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in _strips(batch, len(numbers))):
                x = S.unit_rows(b.column("vec"))
                near = cosines(x)
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if blocks is not None:
                    most = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radii))  # no vector of the cell is nearer
                    most[:, ~central] = 0.0  # zero vectors
                    most[~np.any(x != 0, axis=1)] = 0.0
                    first = ~first & (most >= b.column("floor").to_numpy(zero_copy_only=False)[:, None] - 2 * S.SLACK)
                i, j = np.nonzero(first)
                sent = np.unique(np.column_stack([i, block[j]]), axis=0)
                part = b.take(pa.array(sent[:, 0]))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vec"), pa.array(sent[:, 1].astype(np.int32))], names=["query_id", "vec", "block"])

        return asked.select("query_id", "vec", "floor").mapInArrow(run, "query_id long, vec array<double>, block int")

    def _hits(self, routes: DataFrame, top: int, where: list[Column], blocks: dict[int, int] | None = None) -> DataFrame:
        """The best ``top`` of each query in the blocks that it is sent to. A block is dealt in tiles: groups of its queries by parts of its rows."""
        sent = {r.block: r["count"] for r in routes.groupBy("block").count().collect()}  # at most most_cells + 1
        cells, size = [], dict.fromkeys(sent, 0)
        for cell, (_, n) in self.stats.items():
            block = cell if blocks is None else blocks[cell]
            if block in sent:
                cells.append((cell, block))
                size[block] += n
        plan, tiles = [], 0
        for block, n in sorted(sent.items()):
            groups, parts = -(-n // S.QUERIES_HELD), max(1, -(-size[block] // S.CORPUS_PART))
            plan.append((block, groups, parts, tiles))
            tiles += groups * parts
        dealing = F.broadcast(self.spark.createDataFrame(plan, "block int, groups long, parts long, base long"))  # one row of each block
        of_cell = F.broadcast(self.spark.createDataFrame(cells, "cell int, block int"))  # one row of each cell
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
        queries = routes.join(dealing, "block").select("base", "parts", own("query_id", "groups").alias("g"), each("parts").alias("p"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "vec")
        stored = self.rows()
        for condition in [F.col("cell").isin([c for c, _ in cells]) if len(cells) < len(self.stats) else None, *where]:
            stored = stored if condition is None else stored.filter(condition)
        corpus = stored.join(of_cell, "cell").join(dealing, "block").select("base", "parts", each("groups").alias("g"), own("point_id", "parts").alias("p"), F.lit(1).alias("side"), F.col("point_id").cast("long").alias("id"), "vec")
        rows = queries.unionByName(corpus).withColumn("tile", F.col("base") + F.col("g") * F.col("parts") + F.col("p"))
        return S.scores_of_tiles(rows, max(1, min(tiles, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), top=top, digits=9)

    def search(self, queries: DataFrame, top: int, probes: int | None = None, where: list[Column] | None = None) -> DataFrame:
        """(query_id, point_id, score, rank): the ``top`` best rows of each query (query_id, vec) by cosine, ties by point.

        Exact, or among the ``probes`` nearest cells alone. ``where`` filters on the columns of the index before vectors are read.
        Scores have nine decimals, so that equal vectors tie."""
        asked = queries.filter(_usable("vec")).select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(-2.0).alias("floor"))
        if not self.stats:
            return self.spark.createDataFrame([], "query_id long, point_id long, score double, rank int")
        near = self._hits(self._routes(asked, probes or FIRST), top, where or [])
        if probes is not None:
            return S.ranked(near, "query_id", top)
        place = shared_place(self.spark, "near")
        near.write.parquet(place)
        near = self.spark.read.parquet(place)
        floor = near.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("_f"))
        again = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("_f", F.lit(-2.0)))
        blocks = self._blocks()
        far = self._hits(self._routes(again, FIRST, blocks), top, where or [], blocks)
        both = near.unionByName(far).groupBy("query_id", "point_id").agg(F.max("score").alias("score"))  # a block holds cells that were searched
        return S.ranked(both, "query_id", top)

    def recall(self, queries: DataFrame, top: int, probes: int) -> tuple[int, int]:
        """How many of the ``top`` best pairs of all rows are found with so many probes, and how many there are."""
        exact = S.similar_pairs(queries.filter(_usable("vec")), self.rows(), top=top).select("query_id", F.round("score", 9).alias("score"))
        last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
        found = self.search(queries, top, probes).join(last, "query_id").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("last") - S.SLACK).alias("found"))
        both = last.join(found, "query_id", "left").agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        return both.found, both.n

    def _needed(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """(rank) for each of ``hits`` (query_id, point_id): how many cells lie nearer to the query than the point's own. The hit is found with
        more probes than that. For a zero query all points are equal, and any cell's points serve."""
        centres, numbers = self.centres, np.array(sorted(self.stats), np.int32)
        cosines, sizes = _to_cells(centres, numbers), np.array([self.stats[c][1] for c in numbers.tolist()], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in _strips(batch, len(numbers))):
                x = S.unit_rows(b.column(0))
                order = np.argsort(-cosines(x), axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(numbers))[None, :], axis=1)
                of = pa.compute.list_parent_indices(b.column(1)).to_numpy()
                out = rank[of, np.searchsorted(numbers, pa.compute.list_flatten(b.column(1)).to_numpy())]
                for i in np.flatnonzero(~np.any(x != 0, axis=1)).tolist():
                    mine = np.flatnonzero(of == i)
                    out[mine] = np.searchsorted(np.cumsum(sizes[order[i]]), np.arange(len(mine)) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32))], names=["rank"])

        cells = hits.join(self.rows().select(F.col("point_id").cast("long").alias("point_id"), "cell"), "point_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # ``top`` of each query
        asked = queries.filter(_usable("vec")).select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
        return asked.join(cells, "query_id").select("vec", "cells").mapInArrow(run, "rank int")

    def tuned(self, queries: DataFrame, top: int, least: float = 0.95) -> tuple[int, int, int]:
        """Probes, doubled until the recall is at least ``least``, with the pairs found and there; all cells give all pairs.

        All pairs are compared once, and no search is run to count them: a hit is found when its cell is among the probed. Other rows with the
        score of a query's last hit do not stand in for better ones, as they do in ``recall``, so its count is no smaller."""
        if not self.stats:
            return 1, 0, 0
        place = shared_place(self.spark, "truth")
        S.similar_pairs(queries.filter(_usable("vec")), self.rows(), top=top).select("query_id", "point_id").write.parquet(place)
        exact = self.spark.read.parquet(place)
        n = exact.count()
        needed = {r["rank"]: r["count"] for r in self._needed(queries, exact).groupBy("rank").count().collect()} if n else {}  # at most most_cells + 1
        probes = 1
        while (found := sum(k for rank, k in needed.items() if rank < probes)) < least * n and probes < len(self.stats):
            probes *= 2
        return probes, found, n
