"""Exact n-gram Jaccard join by T-occurrence search.

A document is the set of its distinct five-word shingles (64-bit hashes). Two documents link when
``100 * |A & B| >= 75 * |A | B|``. The join never forms the pairs of a group:

1. Documents of one and the same set (128-bit digest) form a class; copies collapse here, whatever their number.
2. Shingles are dealt out by hash; only shingles of two or more classes come back to their classes. A class with fewer
   than three quarters of its set shared can link with nothing and is dropped, so all later work is on the rest.
3. Rarest shingles first (number of places that hold it, then hash: one total order), linked classes share one of their
   first ``n - ceil(0.75 n) + 1`` shingles. Of those, the inverted lists of two or more classes count. The class of a list
   with the smallest set is its hub; a hub and the classes of all its lists make a star, so that every pair to look at lies
   in a star. What two sets share is at most the shared part of either, which bounds the size of a set that a class can
   link with; a class that cannot link with a set of the hub's size or more is left out of the star.
4. Every class is searched for among the hubs of its stars, and linked classes are joined to components.
5. A star whose classes still are of several components is searched whole: the classes outside its largest component
   against all others, in blocks of bounded size. Inside a component nothing is compared.

Searches run in index blocks: a block holds inverted lists of its classes; a query first tells by sizes and components
which classes it can still link with, and ends where there are none. Then it merges its short lists by counting,
probes the long lists by binary search (DivideSkip), keeps classes that reach the required number of occurrences, and
confirms each by the exact inequality. Blocks give only spanning links. Exchanges carry a row for each list entry, pair of
star and class, or class of a block; a large star is spread over blocks by class.

Cases: a null or empty text, or one without words: empty set, own component; fewer than five words: the whole sequence
is the one shingle; repeated rows and ties fall into one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import as_long, batch, buckets, by_group, connected, documents, exchange, segments, stored, u64
from .shared import Extract, shared_features

WIDTH = 5
NUM, DEN = 75, 100  # the least similarity


def shingle_features(width: int = WIDTH) -> Extract:
    """Distinct shingles, set sizes, and a key of each whole set."""

    def extract(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = T.lower_ascii(data)
        w = T.find_words(low, off)
        doc, h = T.shingle_sets(*T.shingles(T.range_hashes(low, w.start, w.end), w.first, width))
        n = np.bincount(doc, minlength=len(off) - 1)
        end = np.cumsum(n)
        key = np.where((n > 0)[:, None], T.digests(h, end - n, end), np.uint64(0))
        return doc, h, n, key

    return extract


# ---- stars ----------------------------------------------------------------------------------------------------------

BLOCK = 2048  # classes of a block

_ENTRIES = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("most", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted-list entries of the rarest shingles of each class (cls, n, m, v), with the size of the largest set that it can link with."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            cls, n, m, v = b.slice(lo, 4096).columns
            n, m = n.to_numpy(), m.to_numpy()
            # shingles that no other class has come first in the order and lead nowhere
            k = np.clip((n + (-NUM * n // DEN) + 1) - (n - m), 0, m)
            h = [u64(x)[:y] for x, y in zip(v.to_pylist(), k.tolist(), strict=True)]
            yield batch(_ENTRIES, h=as_long(np.concatenate(h)), cls=np.repeat(cls.to_numpy(), k), n=np.repeat(n, k), most=np.repeat((NUM + DEN) * m // NUM - n, k))


def stars(sets: DataFrame) -> DataFrame:
    """(hub, hub_n, cls, n): every class of an inverted list with the list's class of the smallest set."""
    entries = sets.select("cls", "n", "m", "v").mapInArrow(_entries, "h long, cls long, n long, most long")
    hubs = entries.groupBy("h").agg(F.min(F.struct("n", "cls")).alias("hub"), F.min("cls").alias("low"), F.max("cls").alias("top")).filter("low <> top")
    pairs = entries.join(hubs.select("h", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n")), "h")
    return pairs.filter("cls <> hub and hub_n <= most").select("hub", "hub_n", "cls", "n").distinct()


# ---- search in blocks ----------------------------------------------------------------------------------------------


def divide_skip(query: np.ndarray, need: int, lists: dict[int, np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Members that occur on at least ``need`` of the query's lists, and how often: the short lists are merged by counting,
    candidates of the merge are probed in the long lists by binary search, and leave as soon as they cannot reach the
    number any more. ``wanted`` (true or false for each member) drops candidates after the merge."""
    none = np.zeros(0, dtype=np.int64)
    own = sorted((lists[h] for h in query.tolist() if h in lists), key=len)
    if len(own) < need:
        return none, none
    n_long = min(need - 1, int(need / (0.01 * math.log2(len(own[-1]) + 1) + 1)))
    short, long_ = own[: len(own) - n_long], own[len(own) - n_long :]
    count = np.bincount(np.concatenate(short))
    good = count >= max(1, need - n_long)
    cand = np.flatnonzero(good if wanted is None else good & wanted[: len(good)])
    count = count[cand]
    for left, one in enumerate(long_):
        if len(cand) <= 4:
            break
        good = count + (n_long - left) >= need
        cand, count = cand[good], count[good]
        i = np.searchsorted(one, cand)
        count = count + ((i < len(one)) & (one[np.minimum(i, len(one) - 1)] == cand))
    else:
        left = n_long
    if len(cand) and left < n_long:
        for k, x in enumerate(cand.tolist()):
            c = int(count[k])
            for at in range(left, n_long):
                if c + n_long - at < need:
                    break
                one = long_[at]
                i = int(one.searchsorted(x))
                c += i < len(one) and one[i] == x
            count[k] = c
    good = count >= need
    return cand[good], count[good]


class Block:
    """The inverted lists of a block's indexed classes, and which component each class is known to be in.

    ``roots`` are the roots of all classes of the block, queries and indexed ones."""

    def __init__(self, cls: np.ndarray, n: np.ndarray, root: np.ndarray, v: list[bytes], roots: np.ndarray):
        self.cls, self.n = cls, n
        known = np.unique(roots)
        self.number = {r: i for i, r in enumerate(known.tolist())}
        self.comp = np.arange(len(known))  # of each root, as far as this block knows
        self.root = np.searchsorted(known, root)
        h = [u64(x) for x in v]
        self.m = np.array([len(x) for x in h], dtype=np.int64)
        item = np.repeat(np.arange(len(h)), self.m)
        h = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        lo, hi = segments(h[order])
        item = item[order]
        self.lists = {k: item[x:y] for k, x, y in zip(h[order][lo].tolist(), lo.tolist(), hi.tolist(), strict=True)}

    def links(self, n: int, root: int, v: np.ndarray) -> list[int]:
        """Indexed classes of other components that are linked with a query, one for each component."""
        own = self.number[root]
        most = np.minimum(self.m, len(v))  # of what is shared
        near = (DEN * self.n >= NUM * n) & (DEN * n >= NUM * self.n) & (DEN * most >= NUM * (n + self.n - most)) & (self.comp[self.root] != self.comp[own])
        if not near.any():
            return []
        both = n + int(self.n[near].min())
        cand, common = divide_skip(v, -(-NUM * both // (NUM + DEN)), self.lists, near)
        out = []
        for j in cand[DEN * common >= NUM * (n + self.n[cand] - common)].tolist():
            if (other := self.comp[self.root[j]]) != self.comp[own]:
                self.comp[self.comp == other] = self.comp[own]
                out.append(int(self.cls[j]))
        return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a block of classes (block, cls, n, root, v, query, indexed): links that join components."""
    for _, rows in by_group(batches, "block"):
        cls, n, root, query, indexed = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 5, 6))
        v = rows.column(4)
        i = np.flatnonzero(indexed)
        block = Block(cls[i], n[i], root[i], v.take(pa.array(i)).to_pylist(), root)
        out = [(int(cls[k]), other) for k in np.flatnonzero(query).tolist() for other in block.links(int(n[k]), int(root[k]), u64(v[k].as_py()))]
        yield batch(_PAIRS, a=[x for x, _ in out], b=[y for _, y in out])


def _blocks(rows: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links found in blocks of (job, cls, root, query, indexed); rows of one class and block count once."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("job"), F.lit(n)).cast("int"))
    rows = rows.groupBy("block", "cls").agg(F.first("root").alias("root"), F.max("query").alias("query"), F.max("indexed").alias("indexed"))
    rows = rows.join(sets.select("cls", "n", "v"), "cls").select("block", "cls", "n", "root", "v", "query", "indexed")
    return exchange(rows, n, "block").mapInArrow(_search, "a long, b long")


def _roles(query: bool, indexed: bool) -> list:
    return [F.lit(query).alias("query"), F.lit(indexed).alias("indexed")]


def _hub_links(star: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links of classes with the hubs of their stars: a block indexes hubs, the other classes are its queries."""
    near = star.filter(DEN * F.col("hub_n") >= NUM * F.col("n"))
    parts = near.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    query = near.join(parts, "hub").select(F.struct("hub", F.expr("cast(pmod(xxhash64(cls), parts) as int)").alias("i"), F.lit(0).alias("j")).alias("job"), "cls", F.col("cls").alias("root"), *_roles(True, False))
    hub = parts.select(F.col("hub").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    hub = hub.select(F.struct(F.col("cls").alias("hub"), "i", F.lit(0).alias("j")).alias("job"), "cls", F.col("cls").alias("root"), *_roles(False, True))
    return _blocks(query.unionByName(hub), sets, n)


def _cross_links(star: DataFrame, labels: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links inside stars whose classes (but for the hub, which all were compared with) are of several components.

    A star's classes outside its largest component are searched for among themselves and among those inside."""
    rooted = star.select("hub", "cls").join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by_root = rooted.groupBy("hub", "root").agg(F.count("*").alias("c"))
    main = by_root.groupBy("hub").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all")).filter("main.c < all")
    main = main.select("hub", F.col("main.root").alias("main"), F.expr(f"cast(ceil(main.c / {BLOCK}) as int)").alias("inner"), F.expr(f"cast(ceil((all - main.c) / {BLOCK}) as int)").alias("outer"))
    rows = stored(rooted.join(main, "hub"))
    inside, outside = rows.filter("root = main"), rows.filter("root <> main")
    own, job = F.expr("cast(pmod(xxhash64(cls), outer) as int)"), F.struct("hub", "i", "j").alias("job")
    to_inner = outside.withColumn("i", own).withColumn("j", F.explode(F.expr("sequence(1, inner)"))).select(job, "cls", "root", *_roles(True, False))
    inner = inside.withColumn("j", F.expr("cast(1 + pmod(xxhash64(cls), inner) as int)")).withColumn("i", F.explode(F.expr("sequence(0, outer - 1)"))).select(job, "cls", "root", *_roles(False, True))
    # blocks of the outside classes against each other: job (i, -1 - k) for i <= k
    among = outside.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, outer - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", -1 - F.greatest("own", "other")).select(job, "cls", "root", *_roles(True, True))
    return _blocks(to_inner.unionByName(inner).unionByName(among), sets, n)


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document."""
    spark = docs.sparkSession
    n = buckets(spark)
    by_doc, sets = shared_features(docs, shingle_features(width), lambda m, n: DEN * m >= NUM * n)
    sets = stored(sets.withColumn("cls", F.monotonically_increasing_id()))
    star = stored(stars(sets))
    first = stored(_hub_links(star, sets, n))
    labels = stored(connected(first, spark))
    second = _cross_links(star, labels, sets, n)
    roots = connected(first.unionByName(second), spark)
    classes = by_doc.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"))
    node = sets.select("k1", "k2", "cls").join(roots, F.col("cls") == F.col("node")).select("k1", "k2", "root")
    comp = stored(classes.join(node, ["k1", "k2"]))
    least = comp.groupBy("root").agg(F.min("class_id").alias("component_id"))
    joined = comp.join(least, "root").select("k1", "k2", "component_id")
    found = classes.join(joined, ["k1", "k2"], "left").select("k1", "k2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = by_doc.join(found, ["k1", "k2"])
    alone = (F.col("k1") == 0) & (F.col("k2") == 0)  # the empty set links with nothing
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op5_divide_skip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
