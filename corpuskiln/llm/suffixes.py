"""Exact substring deduplication by bucket-pointer refinement.

Removes each byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id.

1. Equal texts (128-bit digest) form classes: of a class only the document with the least id is searched; later copies go whole.
2. Suffixes worth sorting are found by a q-gram: every ``LENGTH``-byte string has one least-hashed q-gram of its own bytes,
   equal strings have equal ones, and only q-grams that two or more classes hold are kept.
3. The strings that begin in reach of a kept q-gram are one context: a row of the q-gram's hash and the bytes they cover.
   Rows are dealt out and sorted by hash and bytes, so that equal contexts lie side by side and are told by their bytes.
4. Where contexts of a q-gram differ, their suffixes are refined: initial buckets of 8 bytes give every offset a pointer (the
   place of its bucket in the order); a bucket is sorted on the pointers at a later offset, its suffixes get the pointers of
   their parts, and the next round sorts on these, so that 8 bytes become 16, 32, and ``LENGTH``. Suffixes alone in a bucket
   keep their pointer and leave.
5. Equal strings now have equal pointers; all but those of the least document are marked, and marks go back as runs.

Cases: a null or empty text has no bytes and none removed; texts under ``LENGTH`` bytes lose nothing; rows that repeat a
doc_id never remove from each other (only a smaller id counts), and a row without doc_id neither loses nor removes;
an empty table gives no rows; long texts are searched whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, buckets, documents, records, segments, stored, u64
from .shared import Extract, shared_features

LENGTH = 50
Q = 20
SPAN = LENGTH - Q + 1  # q-grams of one string
ROWS = 256  # texts that a task unpacks at once
PART_ROWS = 1 << 14  # contexts that are refined together


def _qgrams(data: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams of Q = 20 bytes, by doubling."""

    def join(a: np.ndarray, b: np.ndarray, at: int, shift: int) -> np.ndarray:
        m = min(len(a), len(b) - at)
        return a[:m] * np.uint64(pow(int(T._STEP), shift, 1 << 64)) + b[at : at + m]

    one = data.astype(np.uint64) + np.uint64(1)
    two = join(one, one, 1, 1)
    four = join(two, two, 2, 2)
    eight = join(four, four, 4, 4)
    sixteen = join(eight, eight, 8, 8)
    return T.mix64(join(sixteen, four, 16, 4))


def _least(g: np.ndarray) -> np.ndarray:
    """Least of each SPAN = 31 consecutive q-gram hashes."""
    for k in (1, 2, 4, 8):
        g = np.minimum(g[:-k], g[k:])
    return np.minimum(g[:-15], g[15:])


def string_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one least q-gram: document, q-gram hash, first string start, number of starts (<= SPAN)."""
    none = np.zeros(0, dtype=np.int64)
    size = np.diff(off)
    full = size >= LENGTH
    if not full.any():
        return none, none.astype(np.uint64), none, none
    least = _least(_qgrams(data))
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(inside, off[:-1][full], 1)
    np.add.at(inside, off[1:][full] - LENGTH + 1, -1)
    s = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    v = least[s]
    doc = np.searchsorted(off, s, side="right") - 1
    new = np.append(True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(s)))
    if length.max() > SPAN:  # one q-gram again and again: cut the run
        parts = -(-length // SPAN)
        at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + at * SPAN
        length = np.minimum(np.repeat(length, parts) - at * SPAN, SPAN)
    return doc[first], T.mix64(v[first]), s[first], length  # least hashes are small ones: mixed again, they spread over all buckets


def text_features() -> Extract:
    """Least q-grams of each text, its number of bytes, and a key of the whole text."""

    def extract(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc, h, _, _ = string_runs(data, off)
        doc, h = T.shingle_sets(doc, h)
        return doc, h, np.diff(off), text_keys(data, off)

    return extract


def text_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Digests of whole texts; zeros where a text is too short to matter."""
    return np.where((np.diff(off) >= LENGTH)[:, None], T.digests(data, off[:-1], off[1:]), np.uint64(0))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts as compressed bytes, for exchanges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, z binary")


_CONTEXTS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("text", pa.binary())])
_CONTEXTS_DDL = "h long, doc long, start long, text binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("start", pa.binary()), ("n", pa.binary())])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed text, k1, k2, shared q-grams) -> the contexts of the shared q-grams."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            rows = b.slice(at, ROWS)
            texts = [unpack(z) for z in rows.column(1).to_pylist()]
            data, off = np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
            ids, own = rows.column(0).to_numpy(), np.stack([rows.column(i).to_numpy().view(np.uint64) for i in (2, 3)], axis=1)
            for lo, hi in T.slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                doc, h, start, n = string_runs(part, o)
                salt = T.mix64(np.arange(hi - lo, dtype=np.uint64) + np.uint64(1))
                same = (text_keys(part, o) == own[lo:hi]).all(axis=1)  # another row of the id may hold another text
                kept = [u64(x) if ok else u64(b"") for x, ok in zip(rows.column(4).slice(lo, hi - lo).to_pylist(), same, strict=True)]
                wanted = T.mix64(np.concatenate(kept) + np.repeat(salt, [len(x) for x in kept]))
                m = np.isin(T.mix64(h + salt[doc]), wanted)
                doc, h, start, size = doc[m], h[m], start[m], n[m] + LENGTH - 1
                total = np.append(0, np.cumsum(size))
                text = part[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
                blobs = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(text.tobytes())])
                yield batch(_CONTEXTS, h=h.view(np.int64), doc=ids[lo + doc], start=start - o[doc], text=blobs)


def refine(text: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal ``LENGTH``-byte strings of ``text`` starting at ``at``; ``end``: where the context of
    each byte ends (no bytes beyond are read)."""
    room = end - np.arange(len(text))
    lead = np.zeros(len(text), dtype=np.uint64)
    padded = np.append(text, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | padded[k : k + len(text)]
    live = np.flatnonzero(room >= 8)
    live = live[np.argsort(lead[live], kind="stable")]
    lo, hi = segments(lead[live])
    pointer = np.full(len(text), -1, dtype=np.int64)
    pointer[live] = np.repeat(lo, hi - lo)  # a bucket's pointer is its place in the order
    live, depth = live[np.repeat(hi - lo > 1, hi - lo)], 8
    while depth < LENGTH and len(live):
        step = min(depth, LENGTH - depth)
        live = live[room[live] >= depth + step]
        first, second = pointer[live], pointer[live + step]
        order = np.lexsort((second, first))
        live, first, second = live[order], first[order], second[order]
        lo, hi = segments(first)
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        at_part = np.flatnonzero(new)
        size = np.diff(np.append(at_part, len(live)))
        # the parts of a bucket take places within the bucket, so a pointer stays unlike those of all other buckets
        pointer[live] = first + np.repeat(at_part, size) - np.repeat(lo, hi - lo)
        live, depth = live[np.repeat(size > 1, size)], depth + step
    return pointer[at]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by q-gram in parts of PART_ROWS or somewhat more; all rows of a q-gram are in one."""
    held, rows = [], 0

    def close() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        if rows >= PART_ROWS:
            other = np.flatnonzero(h != held[-1].column(0)[-1].as_py())
            if len(other):  # sorted, so the first other q-gram ends the last one
                if other[0]:
                    held.append(b.slice(0, int(other[0])))
                yield close()
                held, rows, b = [], 0, b.slice(int(other[0]))
        held.append(b)
        rows += b.num_rows
    if held:
        yield close()


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the part of a q-gram: runs of string starts that also start in a smaller document."""
    for part in _parts(batches):
        yield _mark_part(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), *_flat(part.column(3)))


def _mark_part(h: np.ndarray, doc: np.ndarray, start: np.ndarray, text: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    size = np.diff(off)
    n = size - LENGTH + 1
    # equal contexts lie side by side
    i = np.flatnonzero((h[1:] == h[:-1]) & (size[1:] == size[:-1])) + 1
    other = np.ones(len(h), dtype=bool)
    if len(i):
        total = np.append(0, np.cumsum(size[i]))
        byte = np.repeat(off[i] - total[:-1], size[i]) + np.arange(total[-1])
        other[i] = np.logical_or.reduceat(text[byte] != text[byte - np.repeat(size[i], size[i])], total[:-1])
    first = np.flatnonzero(other)
    ctx = np.cumsum(other) - 1
    low = np.minimum.reduceat(doc, first)
    lo, hi = segments(h[first])
    several = np.repeat(hi - lo > 1, hi - lo)
    out_doc, out_start, out_n = [], [], []
    plain = np.flatnonzero(~several[ctx] & (doc > low[ctx]))
    out_doc.append(doc[plain])
    out_start.append(start[plain])
    out_n.append(n[plain])
    many = np.flatnonzero(several)
    if len(many):
        f = first[many]
        total = np.append(0, np.cumsum(size[f]))
        own_text = text[np.repeat(off[f] - total[:-1], size[f]) + np.arange(total[-1])]
        strings = np.append(0, np.cumsum(n[f]))
        at = np.repeat(total[:-1] - strings[:-1], n[f]) + np.arange(strings[-1])
        ids = refine(own_text, np.repeat(total[1:], size[f]), at)
        least = np.full(len(own_text) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, ids, np.repeat(low[many], n[f]))
        best = least[ids]
        # every occurrence of these contexts, string by string
        place = np.full(len(first), -1)
        place[many] = np.arange(len(many))
        occ = np.flatnonzero(several[ctx])
        k = n[occ]
        step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        string = np.repeat(strings[place[ctx[occ]]], k) + step
        odoc, ostart = np.repeat(doc[occ], k), np.repeat(start[occ], k) + step
        m = best[string] < odoc
        odoc, ostart, o = odoc[m], ostart[m], np.repeat(np.arange(len(occ)), k)[m]
        if len(odoc):
            new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (ostart[1:] != ostart[:-1] + 1)))
            out_doc.append(odoc[new])
            out_start.append(ostart[new])
            out_n.append(np.diff(np.append(new, len(odoc))))
    d, s, k = np.concatenate(out_doc), np.concatenate(out_start), np.concatenate(out_n)
    order = np.lexsort((s, d))
    d, s, k = d[order], s[order], k[order].astype(np.uint8)
    cut, ends = segments(d)
    return batch(_MARKS, doc_id=d[cut], start=[s[x:y].tobytes() for x, y in zip(cut, ends, strict=True)], n=[k[x:y].tobytes() for x, y in zip(cut, ends, strict=True)])


def removed_spans(size: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs from runs of string starts."""
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], start[order] + n[order].astype(np.int64) - 1 + LENGTH
    reach = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > reach[:-1])
    return lo[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            rows, out = b.slice(lo, ROWS).to_pylist(), []
            for r in rows:
                raw = unpack(r["z"])
                data = np.frombuffer(raw, dtype=np.uint8)
                spans, kept = 0, raw
                if r["k1"] is not None and len(raw) >= LENGTH and text_keys(data, np.array([0, len(raw)])).view(np.int64).tolist() == [[r["k1"], r["k2"]]]:
                    if r["doc_id"] > r["least"]:  # an equal text has a smaller id
                        spans, kept = 1, b""
                    elif r["marks"]:
                        a, e = removed_spans(len(raw), np.concatenate([np.frombuffer(m["start"], dtype=np.int64) for m in r["marks"]]), np.concatenate([np.frombuffer(m["n"], dtype=np.uint8) for m in r["marks"]]))
                        spans = len(a)
                        kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append({"doc_id": r["doc_id"], "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "ignore") if texts else None})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the kept text where asked for; where a cut
    goes through a character, the text lacks the character."""
    n = buckets(docs.sparkSession) // 4
    docs = records(docs)
    by_doc, grams = shared_features(docs.filter("doc_id is not null"), text_features(), lambda m, n: m > 0)
    by_doc = by_doc.filter("k1 <> 0 or k2 <> 0")
    key = ["k1", "k2"]
    least = by_doc.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    wanted = stored(grams.join(least, key).select(F.col("least").alias("doc_id"), *key, "v"))
    texts_ = packed_texts(docs)
    context = texts_.join(wanted, "doc_id").select("doc_id", "z", *key, "v").mapInArrow(_contexts, _CONTEXTS_DDL)
    marks = stored(context.repartition(n, "h").sortWithinPartitions("h", "text").mapInArrow(_mark, "doc_id long, start binary, n binary"))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))  # the marks of one text
    copies = by_doc.join(least.filter("most > least"), key).filter("doc_id > least").select("doc_id", *key, "least").distinct()
    own = wanted.select("doc_id", *key, F.col("doc_id").alias("least")).join(marks, "doc_id")
    plan = own.unionByName(copies, allowMissingColumns=True)
    rows = texts_.join(plan, "doc_id", "left").select("doc_id", "z", *key, "least", "marks")
    out = rows.mapInArrow(lambda b: _cut(b, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")


def op6_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
