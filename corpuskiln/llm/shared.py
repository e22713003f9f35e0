"""Features that several texts share.

Documents of one key (equal texts, equal sets; a 128-bit digest) form a class, so that copies count once whatever their
number. Features (64-bit hashes) of classes are dealt out by hash, and only features of two or more classes come back to
their classes, each with the number of places that hold it. Every task first combines its own classes into parts, so a
feature that a third of all documents hold reaches its bucket once from each part.

Features go out packed, since all of them do: a part sends every bucket one row of at most ``FLUSH`` features in all. What
comes back are rows of plain columns, one for each feature kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import as_long, bucket_of, buckets, by_group, exchange, records, segments, stored

FLUSH = 1 << 20  # features a task holds before it sends them on
MAX_CLASSES = 1 << 16  # classes a task holds

#: For a slice of documents: distinct (document, feature) ordered by both, a number of each document, and its class key (two
#: 64-bit numbers; zeros: no class).
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

#: kind 0: features for their bucket (``at``: class numbers within the part, ``h``: sorted hashes, both by planes of bytes);
#: 1: a feature ``x`` of class ``num`` of a part, held in ``y`` places (null: as another row of the part and ``x`` says);
#: 2: a document ``id`` with its class (``x``, ``y``) and number ``n``; 3: class ``num`` of a part, as in 2.
_ROWS = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("part", pa.int64()), ("num", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("at", pa.binary()), ("h", pa.binary())])
_DDL = "kind byte, bucket int, part long, num int, x long, y long, n long, id long, at binary, h binary"
_BACK = pa.schema([f for f in _ROWS if f.name not in ("bucket", "at", "h")])
_BACK_DDL = "kind byte, part long, num int, x long, y long, n long, id long"


def pack(x: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed: sorted hashes and small numbers take little."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _rows(schema: pa.Schema, kind: int, count: int, **cols) -> pa.RecordBatch:
    """``count`` rows of one kind; columns that are not given are null."""
    cols["kind"] = np.full(count, kind, dtype=np.int8)
    return pa.RecordBatch.from_arrays([pa.nulls(count, f.type) if f.name not in cols else c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


def runs(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a sorted array and how often each occurs."""
    lo, hi = segments(cls)
    return cls[lo], hi - lo


def _class_features(docs: DataFrame, extract: Extract, n_buckets: int) -> DataFrame:
    """Rows of every kind for all documents. Within a part of a task a class counts once, and of the part's classes that
    hold a feature only one sends it to the feature's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, at, cs, ns, held, seen = [], [], [], [], 0, {}
        task, parts = TaskContext.get().partitionId(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            part = (task << 24) + parts
            h, c = np.concatenate(hs), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            same = np.zeros(len(h), dtype=bool)
            same[1:] = h[1:] == h[:-1]
            keys = np.array(cs, dtype=np.uint64).reshape(-1, 2)
            home = {"bucket": np.full(len(cs), part % n_buckets), "part": np.full(len(cs), part)}
            yield _rows(_ROWS, 3, len(cs), num=np.arange(len(cs)), x=as_long(keys[:, 0]), y=as_long(keys[:, 1]), n=np.array(ns, dtype=np.int64), **home)
            k = int(same.sum())
            yield _rows(_ROWS, 1, k, num=c[same], x=as_long(h[same]), bucket=np.full(k, part % n_buckets), part=np.full(k, part))
            several = np.append(same[1:], False)[~same].astype(np.uint32) << np.uint32(16)
            h, c = h[~same], c[~same] | several
            cut = list(zip(*segments(bucket_of(h, n_buckets)), strict=True))
            yield _rows(_ROWS, 0, len(cut), bucket=bucket_of(h[[x for x, _ in cut]], n_buckets) if cut else [], part=np.full(len(cut), part), at=[pack(c[x:y]) for x, y in cut], h=[pack(h[x:y]) for x, y in cut])

        for b in batches:
            data, off = T.flat(b.column(1))
            for lo, hi in T.slices(off):
                doc, h, n, key = extract(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ids = b.column(0).slice(lo, hi - lo)
                home = bucket_of(T.mix64(key[:, 0] + np.arange(hi - lo, dtype=np.uint64)), n_buckets)
                yield _rows(_ROWS, 2, hi - lo, bucket=home, part=home, x=as_long(key[:, 0]), y=as_long(key[:, 1]), n=n, id=ids)
                number = np.zeros(hi - lo, dtype=np.uint32)
                new = np.zeros(hi - lo, dtype=bool)
                for i, (x, y, size) in enumerate(zip(key[:, 0].tolist(), key[:, 1].tolist(), n.tolist(), strict=True)):
                    if (x or y) and (x, y) not in seen:
                        seen[x, y] = number[i] = len(cs)
                        new[i] = True
                        cs.append((x, y))
                        ns.append(size)
                take = new[doc]
                if take.any():
                    hs.append(h[take])
                    at.append(number[doc[take]])
                    held += int(take.sum())
                if held >= FLUSH or len(cs) >= MAX_CLASSES - T.SLICE_DOCS:
                    if held:
                        yield from flush()
                    hs, at, cs, ns, held, seen = [], [], [], [], 0, {}
                    parts += 1
        if held:
            yield from flush()

    return records(docs).mapInArrow(run, _DDL)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the bucket of a feature: send features of several parts, or of several classes of one, back to their parts.

    A class that several parts hold makes its features look shared; callers see them as features of one class."""
    for _, rows in by_group(batches, "bucket"):
        kind = rows.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(f.name)) for f in _BACK], schema=_BACK).filter(pa.array(kind != 0))
        packed = rows.filter(pa.array(kind == 0))
        if not packed.num_rows:
            continue
        at = [unpack(x, np.uint32) for x in packed.column(packed.schema.get_field_index("at")).to_pylist()]
        part = np.repeat(packed.column(packed.schema.get_field_index("part")).to_numpy(), [len(x) for x in at])
        at = np.concatenate(at)
        h = np.concatenate([unpack(x, np.uint64) for x in packed.column(packed.schema.get_field_index("h")).to_pylist()])
        order = np.argsort(h, kind="stable")
        lo, hi = segments(h[order])
        held = hi - lo
        shared = (held > 1) | np.logical_or.reduceat(at[order] >> np.uint32(16) > 0, lo)
        places = np.zeros(len(h), dtype=np.int64)
        places[order] = np.repeat(np.where(shared, held, 0), held)
        m = np.flatnonzero(places)
        for k in range(0, len(m), 1 << 18):
            i = m[k : k + (1 << 18)]
            yield _rows(_BACK, 1, len(i), part=part[i], num=at[i] & np.uint32(0xFFFF), x=as_long(h[i]), y=places[i])


_OUT = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("v", pa.binary())])
_OUT_DDL = "kind byte, id long, k1 long, k2 long, n long, m long, v binary"


def _class_sets(batches: Iterator[pa.RecordBatch], keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """In the home of a part: the shared features of its classes, rarest first, one row of kind 1 for each class to keep."""
    for _, rows in by_group(batches, "part"):
        kind, num, x, y, n = (rows.column(rows.schema.get_field_index(c)).fill_null(0).to_numpy() for c in ("kind", "num", "x", "y", "n"))
        docs = rows.filter(pa.array(kind == 2))
        yield _rows(_OUT, 2, docs.num_rows, id=docs.column(docs.schema.get_field_index("id")), k1=x[kind == 2], k2=y[kind == 2], n=n[kind == 2])
        f = np.flatnonzero(kind == 1)
        if not len(f):
            continue
        h, at, places = x[f].view(np.uint64), num[f], y[f]
        order = np.argsort(h, kind="stable")
        h, at, places = h[order], at[order], places[order]
        lo, hi = segments(h)
        places = np.repeat(np.maximum.reduceat(places, lo), hi - lo)
        order = np.lexsort((h, places, at))
        h, at = h[order], at[order]
        c = np.flatnonzero(kind == 3)
        c = c[np.argsort(num[c])]  # class i of the part is the row c[i]
        lo, hi = segments(at)
        good = np.flatnonzero(keep(hi - lo, n[c[at[lo]]]))
        for k in range(0, len(good), 2000):
            i = good[k : k + 2000]
            own = c[at[lo[i]]]
            yield _rows(_OUT, 1, len(i), k1=x[own], k2=y[own], n=n[own], m=hi[i] - lo[i], v=[h[p:q].tobytes() for p, q in zip(lo[i], hi[i], strict=True)])


def shared_features(docs: DataFrame, extract: Extract, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n) of every document, and (k1, k2, n, m, v) with the ``m`` shared features, rarest first, of the
    classes that ``keep`` chooses by their numbers of shared and of all features. ``n`` is the extractor's number."""
    n = buckets(docs.sparkSession)
    dealt = exchange(_class_features(docs, extract, n), n)
    back = exchange(dealt.mapInArrow(_shared, _BACK_DDL), n, "part")
    rows = stored(back.mapInArrow(lambda b: _class_sets(b, keep), _OUT_DDL))
    sets = rows.filter("kind = 1").select("k1", "k2", "n", "m", "v").dropDuplicates(["k1", "k2"])
    return rows.filter("kind = 2").select(F.col("id").alias("doc_id"), "k1", "k2", "n"), sets
