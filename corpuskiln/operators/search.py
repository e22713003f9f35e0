"""Hybrid retrieval for batches of queries: dense and sparse legs, fusion, gates, context.

A corpus stays partitioned; vectors of queries meet it in tiles of one exchange, and other query tables go to it by broadcast
only while ``small`` finds them under a checked number of rows. Per-query limits are window ranks, so they plan to WindowGroupLimit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions.text import SOURCE_TYPES

BROADCAST_ROWS = 20_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Has the table at most ``most`` rows? Reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, most) else df


def cosine(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


QUERIES_HELD = 65_536  # query vectors that a task holds at once
QUERY_STRIP = 512  # of these multiplied with a batch of the corpus at once
CORPUS_PART = 10_000  # corpus rows for which another part of the corpus is worth while


PAIRS_HELD = 1 << 20  # scores that a task holds at once

SLACK = 1e-9  # equal vectors may differ by this in their scores
TIE = 1e-12  # scores nearer than this are one
NO_KIND = -(1 << 63)  # stands for a null kind


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of length 1; zero vectors stay zero."""
    if pa.compute.count_distinct(pa.compute.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of one table must have one number of components")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _segments(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of rows that agree in all keys."""
    edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip(np.append(0, edges).tolist(), np.append(edges, len(keys[0])).tolist(), strict=True))


def scores_of_tiles(rows: DataFrame, partitions: int, least: float | None = None, top: int | None = None, digits: int | None = None, kinds: str | None = None) -> DataFrame:
    """(query_id, point_id, score) of rows (tile, side, id, vec): the queries of a tile (side 0) by its part of the corpus (side 1).

    All scores >= ``least``, or the ``top`` best of each query, ranked (by scores of ``digits`` decimals, if given). A task keeps the ``top`` best scores that each query of
    its tile has met, and hands on only what reaches them. With ``kinds`` rows have a column kind, a number, and so have the hits: the ``top`` best are those of each
    query in ``each`` kind of points (a task takes one kind after the other), or queries meet the points of their ``own`` kind alone."""
    rows = rows if kinds else rows.withColumn("kind", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            tiles, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            kind = pa.compute.fill_null(b.column(2), NO_KIND).to_numpy()
            for lo, hi in _segments(tiles, sides, kind):
                now = (tiles[lo], kind[lo] if kinds == "own" else None)
                if now != at:
                    at, held = now, []
                x, ids = unit_rows(b.column(4).slice(lo, hi - lo)), b.column(3).slice(lo, hi - lo)
                if sides[lo] == 0:
                    held.append((ids.to_numpy(), x, None if top is None else np.full((len(x), top), -np.inf)))
                    continue
                if kind[lo] != last:
                    last = kind[lo]
                    for _, _, best in held:
                        if best is not None:
                            best.fill(-np.inf)
                strip = max(1, min(QUERY_STRIP, PAIRS_HELD // len(x)))
                for asked, m, best in held:
                    for first in range(0, len(m), strip):
                        s = m[first : first + strip] @ x.T
                        if best is None:
                            floor = least if least is not None else -2.0
                        else:
                            met = np.concatenate([best[first : first + strip], np.where(np.isnan(s), -np.inf, s)], axis=1)
                            best[first : first + strip] = np.partition(met, met.shape[1] - top, axis=1)[:, met.shape[1] - top :]
                            floor = best[first : first + strip].min(axis=1, keepdims=True) - SLACK
                        i, j = np.nonzero(np.isfinite(s) & (s >= floor))
                        found = [pa.array(asked[first + i]), ids.take(pa.array(j)), pa.array(s[i, j]), pa.repeat(b.column(2)[lo], len(i))]
                        yield pa.RecordBatch.from_arrays(found, names=["query_id", "point_id", "score", "kind"])

    order = ("tile", "kind", "side") if kinds == "own" else ("tile", "side", "kind")
    dealt = rows.select("tile", "side", "kind", "id", "vec").repartition(partitions, "tile").sortWithinPartitions(*order)
    out = dealt.mapInArrow(run, "query_id long, point_id long, score double, kind long")
    out = out if kinds else out.drop("kind")
    out = out if digits is None else out.withColumn("score", F.round("score", digits))
    return out if top is None else ranked(out, ["query_id", "kind"] if kinds == "each" else "query_id", top)


def _tiles(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, int]:
    """Rows (tile, side, kind, id, vec) of both tables in tiles, a group of queries by a part of the corpus, and how many tiles there are."""
    spark = corpus.sparkSession
    groups = max(1, -(-queries.count() // QUERIES_HELD))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // CORPUS_PART)))

    def dealt(df: DataFrame, side: int, key: str, n: int, others: int, tile: Callable[[Column, Column], Column]) -> DataFrame:
        own, other = F.pmod(F.xxhash64(key), F.lit(n)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        kind = (F.col("kind") if "kind" in df.columns else F.lit(None)).cast("long").alias("kind")
        rows = df.filter("vec is not null").select(own.alias("_own"), other.alias("_other"), kind, F.col(key).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        return rows.select(tile(F.col("_own"), F.col("_other")).cast("long").alias("tile"), F.lit(side).alias("side"), "kind", "id", "vec")

    asked = dealt(queries, 0, "query_id", groups, parts, lambda group, part: group * parts + part)
    found = dealt(corpus, 1, "point_id", parts, groups, lambda part, group: group * parts + part)
    return asked.unionByName(found), groups * parts


def similar_pairs(queries: DataFrame, corpus: DataFrame, least: float | None = None, top: int | None = None, kinds: str | None = None) -> DataFrame:
    """(query_id, point_id, score) by cosine: all scores >= ``least``, or the ``top`` best of each query.

    ``queries``: query_id, vec; ``corpus``: point_id, vec; null vectors are left out. Both are dealt by hash to tiles, a group
    of queries by a part of the corpus, through one exchange: a task holds its group (``QUERIES_HELD`` on average) and
    multiplies it with one batch of its part after the other, and hands on only what passes. No vector reaches the driver.
    With ``kinds``, as in ``scores_of_tiles``, the corpus (and for ``own`` the queries too) has a column kind."""
    rows, tiles = _tiles(queries, corpus)
    return scores_of_tiles(rows, tiles, least, top, kinds=kinds)


def best_queries(queries: DataFrame, corpus: DataFrame, least: float | None = None) -> DataFrame:
    """(point_id, kind, query_id, score): for each point the best query of each kind, but for itself, among scores >= ``least``; ties by the least query.

    ``queries``: query_id, kind (a number), vec; ``corpus``: point_id, vec. A task hands on one row of a point and a kind, not its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            tiles, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            kind = pa.compute.fill_null(b.column(2), NO_KIND).to_numpy()
            for lo, hi in _segments(tiles, sides, kind):
                if tiles[lo] != at:
                    at, held = tiles[lo], []
                x, ids = unit_rows(b.column(4).slice(lo, hi - lo)), b.column(3).slice(lo, hi - lo).to_numpy()
                if sides[lo] == 0:
                    if held and held[-1][0] == b.column(2)[lo]:
                        held[-1][1].append((ids, x))
                    else:
                        held.append((b.column(2)[lo], [(ids, x)]))
                    continue
                strip = max(1, min(QUERY_STRIP, PAIRS_HELD // len(x)))
                for owner, asked in held:
                    best, who = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
                    for names, m in asked:  # by ascending id
                        for first in range(0, len(m), strip):
                            s, own = m[first : first + strip] @ x.T, names[first : first + strip]
                            s[np.isnan(s) | (own[:, None] == ids)] = -np.inf
                            most = s.max(axis=0)
                            better = most > best + TIE
                            who[better] = own[(s >= most - TIE).argmax(axis=0)][better]
                            best[better] = most[better]
                    some = np.flatnonzero(np.isfinite(best) & (best >= (-2.0 if least is None else least)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.repeat(owner, len(some)), pa.array(who[some]), pa.array(best[some])], names=["point_id", "kind", "query_id", "score"])

    rows, tiles = _tiles(queries, corpus)
    dealt = rows.repartition(tiles, "tile").sortWithinPartitions("tile", "side", "kind", "id")
    met = dealt.mapInArrow(run, "point_id long, kind long, query_id long, score double").withColumn("_raw", F.col("score")).withColumn("score", F.round("score", 12))
    return best_per_key(met, ["point_id", "kind"], F.asc("query_id")).select("point_id", "kind", "query_id", F.col("_raw").alias("score"))


def ranked(hits: DataFrame, query: str | list[str], limit: int, *ties: str) -> DataFrame:
    """First ``limit`` hits of each query by score; ties by point."""
    keys = [query] if isinstance(query, str) else query
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *(ties or ("point_id",))))).filter(F.col("rank") <= limit)


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of lower-cased words of letters and digits."""
    words = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("term")
    return df.select(key, words).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, idf: bool = True) -> DataFrame:
    """(query_id, point_id, score). ``queries`` and ``docs`` are term tables (query_id|point_id, term, tf).

    Only postings of query terms are kept before anything is joined; lengths are counted from all postings."""
    asked = queries.select("query_id", "term").distinct()
    length = docs.groupBy("point_id").agg(F.sum("tf").alias("len"))
    stats = length.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    vocabulary = asked.select("term").distinct()
    postings = docs.join(maybe_broadcast(vocabulary), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(df, "term").join(length, "point_id").crossJoin(F.broadcast(stats))  # stats is one row
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    if idf:
        weight = weight * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(scored.select("term", "point_id", weight.alias("w")), "term").groupBy("query_id", "point_id").agg(F.sum("w").alias("score"))


def fuse(legs: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, point_id, rank): one union and one grouped sum."""
    rows = legs[0].select("query_id", "point_id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "point_id", "rank"))
    out = rows.groupBy("query_id", "point_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))
    return out if limit is None else ranked(out, "query_id", limit)


def best_per_key(hits: DataFrame, keys: list[str], *ties: Column) -> DataFrame:
    """The best-scored row of each key; ties by the given columns."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *ties))).filter("_n = 1").drop("_n")


def gate(hits: DataFrame, low: float = -3.0, mid: float = 0.0) -> DataFrame:
    """Drops hits scored at most ``low``; those up to ``mid`` are ambiguous."""
    return hits.withColumn("status", F.when(F.col("score") <= low, "incorrect").when(F.col("score") <= mid, "ambiguous").otherwise("correct")).filter("status <> 'incorrect'")


def confidence(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Confidence of ranked hits (query, rank, score): best sigmoid and share of the first three at 0.60 or more."""
    s = 1 / (1 + F.exp(-F.col("score")))
    g = hits.select(query, "rank", s.alias("s")).groupBy(query).agg(F.max("s").alias("top"), F.count("*").alias("n"), F.count_if((F.col("rank") <= 3) & (F.col("s") >= 0.6)).alias("good"))
    mixed = F.round(0.6 * F.col("top") + 0.4 * F.col("good") / F.least(F.lit(3), "n"), 3)
    return g.select(query, mixed.alias("confidence")).withColumn("level", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low"))


def neighbours(hits: DataFrame, corpus: DataFrame, group: str, index: str, text: str, query: str = "query_id") -> DataFrame:
    """Text before and after each hit; chunks that are hits of the same query themselves are left out."""
    near = hits.select(query, group, index, F.explode(F.array(F.lit(-1), F.lit(1))).alias("d")).withColumn("at", F.col(index) + F.col("d"))
    near = near.join(hits.select(query, group, F.col(index).alias("at")), [query, group, "at"], "left_anti")
    found = near.join(corpus.select(group, F.col(index).alias("at"), F.col(text).alias("_t")), [group, "at"])
    sides = found.groupBy(query, group, index).agg(F.max(F.when(F.col("d") < 0, F.col("_t"))).alias("before"), F.max(F.when(F.col("d") > 0, F.col("_t"))).alias("after"))
    return hits.join(sides, [query, group, index], "left")


def lift_to_parent(hits: DataFrame, query: str = "query_id", act: str = "act_id", parent: str = "parent_text") -> DataFrame:
    """Children replaced by their parents, each parent once (known by act and its first 64 characters)."""
    key = F.substring(F.coalesce(parent, "text"), 1, 64)
    rows = hits.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy(query, act, "_k").orderBy("rank"))).filter("_n = 1")
    return rows.withColumn("text", F.coalesce(parent, "text")).drop("_k", "_n")


def within_budget(blocks: DataFrame, key: str, order: str, text: str, most: int, least_cut: int = 200, gap: int = 2) -> DataFrame:
    """Blocks of each key that fit the budget in order; the first that does not fit is cut if over ``least_cut`` is left."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_sum", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))
    rows = rows.withColumn("_over", (F.col("_sum") + F.length(text) > most).cast("int"))
    rows = rows.withColumn("_late", F.coalesce(F.max("_over").over(before), F.lit(0))).filter("_late = 0")
    room = F.lit(most) - F.col("_sum")
    cut = rows.withColumn(text, F.when(F.col("_over") == 0, F.col(text)).when(room > least_cut, F.concat(F.substring(F.col(text), F.lit(1), room.cast("int")), F.lit("…"))))
    return cut.filter(F.col(text).isNotNull()).drop("_sum", "_over", "_late")


def joined_context(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text of each key's blocks, a blank line between; ``blocks`` is bounded by the budget above."""
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda b: b[text]), "\n\n").alias("context"))


def per_kind(total: int, kinds: int) -> int:
    """How many hits of each kind are merged to ``total``."""
    return -(-total // kinds) + 2


def fan_out(hits: DataFrame, query: str, kind: str, total: int, kinds: int) -> DataFrame:
    """Best of each kind (ceil(total / kinds) + 2), merged, then the best ``total`` of each query."""
    return ranked(ranked(hits, [query, kind], per_kind(total, kinds)).drop("rank"), query, total)


PUBLISHERS: dict[str, list[str]] = {}  # of each source type
for _publisher, _kind in SOURCE_TYPES.items():
    PUBLISHERS.setdefault(_kind, []).append(_publisher)


def corpus_filters(
    source_type: str | None = None,
    publisher: str | None = None,
    year: int | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
    as_of_year: int | None = None,
    exclude_repealed: bool = False,
) -> list[Column]:
    """Filters on publisher, year, valid_from_year and is_repealed. What is repealed or not yet valid goes only where the
    source type may be legislation; an explicit publisher wins over those of the source type; an unknown source type filters
    nothing; years are compared as numbers."""
    may_be_law = source_type in (None, "legislation", "tax_interpretation")
    out = []
    if exclude_repealed and may_be_law:
        out.append(~F.col("is_repealed"))
    if as_of_year is not None and may_be_law:
        out.append(F.col("valid_from_year") <= as_of_year)
    number = F.col("year").try_cast("int")
    if year:
        out.append(number == year)
    if year_from:
        out.append(number >= year_from)
    if year_to:
        out.append(number <= year_to)
    if publisher:
        out.append(F.col("publisher") == publisher)
    elif source_type in PUBLISHERS:
        out.append(F.col("publisher").isin(PUBLISHERS[source_type]))
    return out


def second_ranking(pool: DataFrame, query: str, k: int, first: Column, second: Column) -> DataFrame:
    """The best ``k`` of each query by the second score, or by the first where no more than ``k`` candidates are there."""
    crowded = F.count("*").over(Window.partitionBy(query)) > k
    return pool.withColumn("reranked", crowded).withColumn("score", F.when(F.col("reranked"), second).otherwise(first))


def expandable(hits: DataFrame, query: str, kind: str) -> DataFrame:
    """Marks the queries whose hits may get their neighbours: those without any child chunk."""
    child = F.max(F.coalesce(F.col(kind) == "child", F.lit(False))).over(Window.partitionBy(query))
    return hits.withColumn("expand", ~child)


def with_private(public: DataFrame, private: DataFrame, owner: Column, query: str, most_private: int = 5, most: int = 8) -> DataFrame:
    """Public hits and the asking user's own, best first; private rows of other users never join."""
    own = ranked(private.filter(owner), query, most_private).drop("rank").withColumn("source", F.lit("private"))
    both = public.drop("rank").withColumn("source", F.lit("public")).unionByName(own.select(*public.drop("rank").columns, "source"))
    return ranked(both, query, most, "source", "point_id")


def gathered(steps: DataFrame, query: str, keys: list[str], step: str) -> DataFrame:
    """Hits of all steps of an agent, each once, as the first step that found it gave it."""
    first = F.min_by(F.struct(*(c for c in steps.columns if c not in (query, *keys))), step).alias("_first")
    return steps.groupBy(query, *keys).agg(first).select(query, *keys, "_first.*")
