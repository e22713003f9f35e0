"""Fuzzy repeated passages by collinear chaining.

Seeds are the ``K``-word shingles that are least-hashed in some run of ``REACH`` shingles, so that every run of
``K + REACH - 1`` equal words has a seed in common. A seed that several documents hold joins each of them to the document
with the least id (no pairs within the group). Where the seeds of a passage have different least documents, documents are
joined again, by longer keys: every run of ``MIN_WORDS`` words that no single segment of the first join holds, and pairs of
neighbouring seeds whose least documents differ; each key again joins its holders to the least of them. So every word of an
unchanged run of ``MIN_WORDS`` words that a smaller document holds is in a passage; a changed one can still be missed where
other documents hold each of its pairs of seeds, but none of them the whole.
Seeds of a document and its source that follow each other exactly are one
segment; segments are chained in order in both texts, with a cost for the words between them, through a tree
of greatest values over those that end at most ``MAX_GAP`` words before.
Chains are aligned word by word between their segments and beyond their ends, and a passage is kept when it has at least
``MIN_WORDS`` words and ``IDENTITY`` of them match.

Cases: null or empty texts and texts of fewer than ``K`` words have no passages; a null doc_id is left out; rows that
repeat a doc_id are one document to each other; passages inside one document are not looked for; ties take the least
source; long texts are searched whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, bucket_of, buckets, by_group, by_key, documents, exchange, records, segments, stored, u64

K = 8
REACH = 8
GAP_COST = 0.25  # for each word that a chain leaves out on either side
MAX_GAP = 64  # words; a longer gap ends a chain
MIN_WORDS = 50
IDENTITY = 0.75
PAD = 2 * REACH  # words beyond a chain's ends that an alignment may take in
REST_PAD = MAX_GAP  # the same where a chain has anchors of the second join, which may lie in the middle of a passage
NEXT = 3  # following seeds that a seed makes pairs with

_SEEDS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
# anchors are rows of plain columns: packed by bucket of the seed and bucket of the document, their number would grow with the square of the buckets
_ANCHORS = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("src", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])
_ANCHORS_DDL = "bucket int, doc long, src long, p int, q int"
_KEYS = pa.schema([*_SEEDS, ("pos2", pa.binary())])
_SIZED = pa.schema([*_ANCHORS, ("size", pa.int32())])
_FIRST = pa.schema([*_SIZED, ("doc_id", pa.int64()), ("starts", pa.binary()), ("known", pa.binary()), ("pairs", pa.binary())])
_FIRST_DDL = f"{_ANCHORS_DDL}, size int, doc_id long, starts binary, known binary, pairs binary"


def seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in it, and hash of every seed of a slice."""
    h = T.window_hashes(words, K)
    count = np.diff(first)
    full = np.flatnonzero(count >= K)
    if not len(full):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    doc = np.repeat(full, count[full] - K + 1)
    start = np.repeat(np.cumsum(count[full] - K + 1) - (count[full] - K + 1), count[full] - K + 1)
    pos = np.arange(len(doc)) - start
    h = h[first[doc] + pos]
    least = h.copy()
    same = doc
    for k in (1, 2, 4):  # runs of REACH shingles; cut at the document's end
        least[:-k] = np.where(same[:-k] == same[k:], np.minimum(least[:-k], least[k:]), least[:-k])
    whole = np.append(same[REACH - 1 :] == same[: 1 - REACH], np.zeros(min(len(same), REACH - 1), dtype=bool))[: len(same)] if len(same) >= REACH else np.zeros(len(same), dtype=bool)
    whole |= pos == 0  # a short text has one run
    most = np.where(whole, least, np.uint64(0))
    for k in (1, 2, 4):
        most[k:] = np.where(same[k:] == same[:-k], np.maximum(most[k:], most[:-k].copy()), most[k:])
    pick = most == h
    return doc[pick], pos[pick], T.mix64(h[pick])  # least hashes are small ones: mixed again, they spread over all buckets


def _spread(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.flat(b.column(1))
            ids = b.column(0).to_numpy()
            got = []
            for lo, hi in T.slices(off):
                low = T.lower_ascii(data[off[lo] : off[hi]])
                w = T.find_words(low, off[lo : hi + 1] - off[lo])
                doc, pos, h = seeds(T.range_hashes(low, w.start, w.end), w.first)
                got.append((ids[doc + lo], pos, h))
            if got:
                doc, pos, h = (np.concatenate(x) for x in zip(*got, strict=True))
                where = bucket_of(h, n_buckets)
                order = np.argsort(where, kind="stable")
                where, doc, pos, h = where[order], doc[order], pos[order].astype(np.uint32), h[order]
                cut = list(zip(*segments(where), strict=True))
                yield batch(_SEEDS, bucket=[int(where[x]) for x, _ in cut], h=[h[x:y].tobytes() for x, y in cut], doc=[doc[x:y].tobytes() for x, y in cut], pos=[pos[x:y].tobytes() for x, y in cut])

    return run


def _join_seeds(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """In the bucket of a seed: join every document that holds it to the least one, which is joined to itself."""
    for _, rows in by_key(batches, "bucket"):
        h = np.concatenate([u64(r["h"]) for r in rows])
        doc = np.concatenate([np.frombuffer(r["doc"], dtype=np.int64) for r in rows])
        pos = np.concatenate([np.frombuffer(r["pos"], dtype=np.uint32) for r in rows])
        order = np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        lo, hi = segments(h)
        src, q = np.repeat(doc[lo], hi - lo), np.repeat(pos[lo], hi - lo)
        m = np.repeat(doc[lo] != doc[hi - 1], hi - lo)
        yield _anchors(doc[m], src[m], pos[m], q[m], n_buckets)


def _anchors(doc: np.ndarray, src: np.ndarray, p: np.ndarray, q: np.ndarray, n_buckets: int, size: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each anchor, with the bucket of its document."""
    where = bucket_of(T.mix64(doc.astype(np.uint64)), n_buckets)
    sizes = {} if size is None else {"size": size.astype(np.int32)}
    return batch(_ANCHORS if size is None else _SIZED, bucket=where.astype(np.int32), doc=doc, src=src, p=p.astype(np.int32), q=q.astype(np.int32), **sizes)


def _rest(doc: np.ndarray, src: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[dict]:
    """What a bucket's documents look up again: ranges of starts of ``MIN_WORDS``-word runs, ranges among them that one
    source is known to hold, and pairs of seeds.

    Which runs and pairs a document leaves out depends on their words alone, or a smaller document holds them too."""
    order = np.lexsort((p, doc))
    doc, src, p, q = doc[order], src[order], p[order], q[order]
    one = np.append(True, (doc[1:] != doc[:-1]) | (p[1:] != p[:-1]))
    doc, src, p, q = doc[one], src[one], p[one], q[one]
    diag, own = p - q, doc[1:] == doc[:-1]
    near = own & (p[1:] - p[:-1] <= REACH)
    at = np.flatnonzero(np.append(True, ~near))
    end = np.append(at[1:], len(doc)) - 1
    starts = np.stack([doc[at], np.maximum(p[at] - REACH + 1, 0), p[end] + K + REACH - MIN_WORDS])
    starts = starts[:, starts[2] > starts[1]]
    at = np.flatnonzero(np.append(True, ~(near & (src[1:] == src[:-1]) & (diag[1:] == diag[:-1]))))
    end = np.append(at[1:], len(doc)) - 1
    lo, hi = p[at], p[end] + K
    far = np.int64(1) << 40
    before = np.where(np.append(False, own)[at], p[np.maximum(at - 1, 0)], -far)
    after = np.where(np.append(own, False)[end], p[np.minimum(end + 1, len(p) - 1)], far)
    least = (src[at] == doc[at]) & (diag[at] == 0)
    lo = np.where(least, np.maximum(np.maximum(lo - REACH + 1, 0), before + 1), lo)
    hi = np.where(least, np.minimum(hi + REACH - 1, after + K - 1), hi)
    known = np.stack([doc[at], lo, hi - MIN_WORDS + 1])
    known = known[:, known[2] > known[1]]
    pairs = []
    for k in range(1, NEXT + 1):
        m = (doc[k:] == doc[:-k]) & (p[k:] - p[:-k] <= MAX_GAP + K) & ((src[k:] != src[:-k]) | (np.abs(diag[k:] - diag[:-k]) > MAX_GAP))
        pairs.append(np.stack([doc[:-k][m], p[:-k][m], p[k:][m]]))
    pairs = np.concatenate(pairs, axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    out = []
    for d in np.unique(doc):
        x, y, z = (t[1:, np.searchsorted(t[0], d) : np.searchsorted(t[0], d, side="right")] for t in (starts, known, pairs))
        if z.size or (x[1] - x[0]).sum() > (y[1] - y[0]).sum():
            out.append({"doc_id": int(d), "starts": x.astype(np.uint32).tobytes(), "known": y.astype(np.uint32).tobytes(), "pairs": z.astype(np.uint32).tobytes()})
    return out


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the bucket of a document: its segments with the sources of the first join, and what it looks up again."""
    for bucket, rows in by_group(batches, "bucket"):
        doc, src, p, q = _read(rows)
        rest = _rest(doc, src, p, q)
        m = doc != src
        doc, src, p, q, size = merged(doc[m], src[m], p[m], q[m], np.full(int(m.sum()), K))
        none = {f.name: pa.nulls(len(doc), f.type) for f in _FIRST if f.name not in _SIZED.names}
        yield batch(_FIRST, bucket=np.full(len(doc), bucket, dtype=np.int32), doc=doc, src=src, p=p.astype(np.int32), q=q.astype(np.int32), size=size.astype(np.int32), **none)
        for k in range(0, len(rest), 1000):
            yield pa.RecordBatch.from_pylist(rest[k : k + 1000], schema=_FIRST)


def _read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, src, p, q = (rows.column(rows.schema.get_field_index(k)).to_numpy() for k in ("doc", "src", "p", "q"))
    return doc, src, p.astype(np.int64), q.astype(np.int64)


def merged(doc: np.ndarray, src: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a pair that touch or overlap at the same distance made one, ordered by document and source."""
    if not len(doc):
        return doc, src, p, q, size
    order = np.lexsort((p, p - q, src, doc))
    doc, src, p, q, size = doc[order], src[order], p[order], q[order], size[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]))
    shift = np.cumsum(other) << 33  # ends of one group stay over those of the groups before
    end = np.maximum.accumulate(p + size + shift)
    at = np.flatnonzero(other | np.append(True, p[1:] + shift[1:] > end[:-1]))
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], src[at], p[at], q[at], (end - shift)[last] - p[at]


def _rest_keys(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.flat(b.column(1))
            ids = b.column(0).to_numpy()
            for lo, hi in T.slices(off):
                low = T.lower_ascii(data[off[lo] : off[hi]])
                w = T.find_words(low, off[lo : hi + 1] - off[lo])
                words = T.range_hashes(low, w.start, w.end)
                got = []
                for i in range(lo, hi):
                    own = words[w.first[i - lo] : w.first[i - lo + 1]]
                    starts, known, pairs = (np.frombuffer(b.column(k)[i].as_py(), dtype=np.uint32).astype(np.int64).reshape(2, -1) for k in (2, 3, 4))
                    runs = T.window_hashes(own, MIN_WORDS)
                    mark = np.zeros(len(runs) + 1, dtype=np.int64)
                    for (x, y), step in ((starts, 1), (known, -2)):
                        np.add.at(mark, np.minimum(x, len(runs)), step)
                        np.add.at(mark, np.minimum(y, len(runs)), -step)
                    p = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                    short = T.window_hashes(own, K)
                    x, y = pairs[:, pairs[1] < len(short)]  # another row of the same id may be shorter
                    h = np.concatenate([runs[p], T.mix64(short[x] * np.uint64(3) + short[y])])
                    got.append((np.full(len(h), ids[i]), np.concatenate([p, x]), np.concatenate([p, y]), h))
                doc, pos, pos2, h = (np.concatenate(x) for x in zip(*got, strict=True))
                where = bucket_of(h, n_buckets)
                order = np.argsort(where, kind="stable")
                where, doc, pos, pos2, h = where[order], doc[order], pos[order].astype(np.uint32), pos2[order].astype(np.uint32), h[order]
                cut = list(zip(*segments(where), strict=True))
                yield batch(_KEYS, bucket=[int(where[x]) for x, _ in cut], h=[h[x:y].tobytes() for x, y in cut], doc=[doc[x:y].tobytes() for x, y in cut], pos=[pos[x:y].tobytes() for x, y in cut], pos2=[pos2[x:y].tobytes() for x, y in cut])

    return run


def _join_keys(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """In the bucket of a key: join every document that holds it to the least one, as a run of words or as two seeds."""
    for _, rows in by_key(batches, "bucket"):
        h = np.concatenate([u64(r["h"]) for r in rows])
        doc = np.concatenate([np.frombuffer(r["doc"], dtype=np.int64) for r in rows])
        pos, pos2 = (np.concatenate([np.frombuffer(r[k], dtype=np.uint32) for r in rows]) for k in ("pos", "pos2"))
        order = np.lexsort((pos, doc, h))
        h, doc, pos, pos2 = h[order], doc[order], pos[order], pos2[order]
        lo, hi = segments(h)
        src, q, q2 = (np.repeat(x[lo], hi - lo) for x in (doc, pos, pos2))
        m = doc != src
        doc, src, pos, pos2, q, q2 = (x[m] for x in (doc, src, pos, pos2, q, q2))
        two = pos2 != pos  # a run has one place, a pair of seeds two
        doc, src = (np.concatenate([x, x[two]]) for x in (doc, src))
        yield _anchors(doc, src, np.concatenate([pos, pos2[two]]), np.concatenate([q, q2[two]]), n_buckets, np.concatenate([np.where(two, K, MIN_WORDS), np.full(int(two.sum()), K)]))


class Reach:
    """Greatest value over a range of ranks, with the item that has it; the items of a rank leave in the order they came."""

    def __init__(self, n: int):
        self.n = n
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (2 * n)
        self.here: list[deque[tuple[float, int]]] = [deque() for _ in range(n)]  # falling values: no later one is greater

    def _lift(self, rank: int) -> None:
        i = rank + self.n
        self.best[i] = self.here[rank][0] if self.here[rank] else (-1e18, -1)
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def put(self, rank: int, value: float, item: int) -> None:
        own = self.here[rank]
        while own and own[-1][0] <= value:
            own.pop()
        own.append((value, item))
        if len(own) == 1:
            self._lift(rank)

    def drop(self, rank: int, item: int) -> None:
        own = self.here[rank]
        if own and own[0][1] == item:
            own.popleft()
            self._lift(rank)

    def get(self, lo: int, hi: int) -> tuple[float, int]:
        """Over the ranks from ``lo`` to before ``hi``."""
        out, lo, hi = (-1e18, -1), lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                out = max(out, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = max(out, self.best[hi])
            lo, hi = lo // 2, hi // 2
        return out


def chain(p0: list[int], q0: list[int], size: list[int]) -> list[list[int]]:
    """Best chains of segments (start in the text, start in the source, words), each segment in one chain at most.

    A segment follows the best of those that end within ``MAX_GAP`` words before it in both texts."""
    n = len(p0)
    q1 = [q + s for q, s in zip(q0, size, strict=True)]
    p1 = [p + s for p, s in zip(p0, size, strict=True)]
    ranks = sorted(set(q1))
    place = {q: i for i, q in enumerate(ranks)}
    tree = Reach(len(ranks))
    score, before = [0.0] * n, [-1] * n
    ends: deque[int] = deque()  # segments that can be followed, by their ends
    events = sorted([(p1[i], 0, i) for i in range(n)] + [(p0[i], 1, i) for i in range(n)])  # ends first: they may be followed
    for _, begins, i in events:
        if begins:
            while ends and p1[ends[0]] < p0[i] - MAX_GAP:
                j = ends.popleft()
                tree.drop(place[q1[j]], j)
            value, j = tree.get(bisect_left(ranks, q0[i] - MAX_GAP), bisect_right(ranks, q0[i]))
            gain = value - GAP_COST * (p0[i] + q0[i])
            score[i] = size[i]
            if j >= 0 and gain > 0:
                score[i], before[i] = size[i] + gain, j
        else:
            tree.put(place[q1[i]], score[i] + GAP_COST * (p1[i] + q1[i]), i)
            ends.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


_CHAINS = pa.schema([("doc_id", pa.int64()), ("src_doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("src_lo", pa.int64()), ("src_hi", pa.int64()), ("p", pa.list_(pa.int64())), ("q", pa.list_(pa.int64())), ("size", pa.list_(pa.int64()))])
_CHAINS_DDL = "doc_id long, src_doc_id long, lo long, hi long, src_lo long, src_hi long, p array<long>, q array<long>, size array<long>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the bucket of a document: its chains with each source."""
    for _, rows in by_group(batches, "bucket"):
        doc, src, p, q = _read(rows)
        rest = rows.column(rows.schema.get_field_index("again")).to_numpy(zero_copy_only=False)
        size = rows.column(rows.schema.get_field_index("size")).to_numpy().astype(np.int64)
        again = set(zip(doc[rest].tolist(), src[rest].tolist(), strict=True))
        doc, src, p0, q0, size = merged(doc, src, p, q, size)
        pair = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])))
        out = []
        for x, y in zip(pair.tolist(), [*pair[1:].tolist(), len(doc)], strict=True):
            pad = REST_PAD if (int(doc[x]), int(src[x])) in again else PAD
            if size[x:y].sum() + 2 * pad < MIN_WORDS * IDENTITY:
                continue
            a, b, s = p0[x:y].tolist(), q0[x:y].tolist(), size[x:y].tolist()
            for own in chain(a, b, s) if y - x > 1 else [[0]]:
                f, g = own[0], own[-1]
                lo, hi = max(0, a[f] - pad), a[g] + s[g] + pad
                if hi - lo >= MIN_WORDS:  # no alignment goes beyond
                    out.append({"doc_id": int(doc[x]), "src_doc_id": int(src[x]), "lo": lo, "hi": hi, "src_lo": max(0, b[f] - pad), "src_hi": b[g] + s[g] + pad, "p": [a[i] for i in own], "q": [b[i] for i in own], "size": [s[i] for i in own]})
        yield pa.RecordBatch.from_pylist(out, schema=_CHAINS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the asked ranges of a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary())])
    for b in batches:
        data, off = T.flat(b.column(1))
        ranges = b.column(2)
        for lo, hi in T.slices(off):
            low = T.lower_ascii(data[off[lo] : off[hi]])
            w = T.find_words(low, off[lo : hi + 1] - off[lo])
            h = (T.range_hashes(low, w.start, w.end) >> np.uint64(32)).astype(np.uint32)
            out = []
            for i in range(lo, hi):
                own = h[w.first[i - lo] : w.first[i - lo + 1]]
                out += [{"doc_id": b.column(0)[i].as_py(), "lo": r["lo"], "hi": r["hi"], "words": own[r["lo"] : r["hi"]].tobytes()} for r in ranges[i].as_py()]
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _common(a: list[int], b: list[int]) -> int:
    """Longest common subsequence of two gaps (at most MAX_GAP words each)."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def align(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], size: list[int]) -> tuple[int, int, int, int, int]:
    """Span in ``a`` and in ``b`` and matching words of a chain, with its ends moved out while words agree."""
    match = sum(size)
    for i in range(len(p) - 1):
        x, y = a[p[i] + size[i] : p[i + 1]].tolist(), b[q[i] + size[i] : q[i + 1]].tolist()
        match += _common(x, y) if x and y else 0
    lo, blo, hi, bhi = p[0], q[0], p[-1] + size[-1], q[-1] + size[-1]
    while lo > 0 and blo > 0 and a[lo - 1] == b[blo - 1]:
        lo, blo, match = lo - 1, blo - 1, match + 1
    while hi < len(a) and bhi < len(b) and a[hi] == b[bhi]:
        hi, bhi, match = hi + 1, bhi + 1, match + 1
    return lo, hi, blo, bhi, match


def aligned(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], size: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Alignments that make a passage: of the whole chain, or else of its parts on either side of its worst gap."""
    out, parts = [], [(0, len(p))]
    while parts:
        x, y = parts.pop()
        lo, hi, blo, bhi, match = align(a, b, p[x:y], q[x:y], size[x:y])
        if hi - lo >= MIN_WORDS and match >= IDENTITY * max(hi - lo, bhi - blo):
            out.append((lo, hi, blo, bhi, match))
        elif y - x > 1 and hi - lo >= MIN_WORDS:
            worst = max(range(x, y - 1), key=lambda i: max(p[i + 1] - p[i], q[i + 1] - q[i]) - size[i])
            parts += [(x, worst + 1), (worst + 1, y)]
    return out


_PASSAGES = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("src_doc_id", pa.int64()), ("src_start_word", pa.int64()), ("src_n_words", pa.int64()), ("n_match", pa.int64()), ("identity", pa.float64())])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch_ in batches:
        for k in range(0, batch_.num_rows, 1000):
            out = []
            for r in batch_.slice(k, 1000).to_pylist():
                a, b = np.frombuffer(r["words"], dtype=np.uint32), np.frombuffer(r["src_words"], dtype=np.uint32)
                for lo, hi, blo, bhi, match in aligned(a, b, [x - r["lo"] for x in r["p"]], [x - r["src_lo"] for x in r["q"]], r["size"]):
                    share = match / max(hi - lo, bhi - blo)
                    out.append({"doc_id": r["doc_id"], "start_word": lo + r["lo"], "n_words": hi - lo, "src_doc_id": r["src_doc_id"], "src_start_word": blo + r["src_lo"], "src_n_words": bhi - blo, "n_match": match, "identity": share})
            yield pa.RecordBatch.from_pylist(out, schema=_PASSAGES)


def passages(docs: DataFrame) -> DataFrame:
    """Passages of documents that occur, perhaps with changes, in a document with a smaller id."""
    spark = docs.sparkSession
    n = buckets(spark)
    docs = records(docs).filter("doc_id is not null")
    found = exchange(docs.mapInArrow(_spread(n), "bucket int, h binary, doc binary, pos binary"), n)
    joined = exchange(found.mapInArrow(lambda b: _join_seeds(b, n), _ANCHORS_DDL), n)
    first = stored(joined.mapInArrow(_first, _FIRST_DDL))
    rest = docs.join(first.filter("doc_id is not null").select("doc_id", "starts", "known", "pairs"), "doc_id")
    keys = exchange(rest.mapInArrow(_rest_keys(n), "bucket int, h binary, doc binary, pos binary, pos2 binary"), n)
    again = keys.mapInArrow(lambda b: _join_keys(b, n), f"{_ANCHORS_DDL}, size int").withColumn("again", F.lit(True))
    both = exchange(first.filter("doc_id is null").select("bucket", "doc", "src", "p", "q", "size", F.lit(False).alias("again")).unionByName(again), n)
    chains = stored(both.mapInArrow(_chain, _CHAINS_DDL))
    sides = chains.select("doc_id", "lo", "hi").unionByName(chains.select(F.col("src_doc_id").alias("doc_id"), F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"))).distinct()
    wanted = sides.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # distinct ranges of one text
    words = stored(docs.join(wanted, "doc_id").select("doc_id", "text", "ranges").mapInArrow(_words, "doc_id long, lo long, hi long, words binary").dropDuplicates(["doc_id", "lo", "hi"]))
    source = words.select(F.col("doc_id").alias("src_doc_id"), F.col("lo").alias("src_lo"), F.col("hi").alias("src_hi"), F.col("words").alias("src_words"))
    both = chains.join(words, ["doc_id", "lo", "hi"]).join(source, ["src_doc_id", "src_lo", "src_hi"])
    cols = ["doc_id", "src_doc_id", "lo", "src_lo", "p", "q", "size", "words", "src_words"]
    return both.select(*cols).mapInArrow(_align, "doc_id long, start_word long, n_words long, src_doc_id long, src_start_word long, src_n_words long, n_match long, identity double")


def op3_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir))
