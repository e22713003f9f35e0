"""Language-model scoring by a hashed maximum-entropy model.

A word's probability is factored by its class (a hash of its last letters): P(class | context) is a softmax over hashed
n-gram and skip features of the two words before, P(word | class) comes from smoothed counts of the whole training part.

* Training: every task runs minibatch gradient steps (row-wise Adagrad) over its own training documents, all of them; the
  tasks' weights are averaged row by row, weighted by how often each task saw the feature. The weights are ``FEATURES`` x
  ``CLASSES`` numbers, whatever the corpus.
* Counts: words are dealt out by hash with their counts in the training part and in each document; a word's bucket knows its
  total and returns each document's share of the sums. Vocabulary and counts are never gathered in one place.
* Scoring: one pass over all documents in numpy slices, with sparse gathers of weight rows.

Cases: a null or empty text is the end token alone; a null doc_id is scored, not held out and not learned from; without
any training document all counts are 0; long texts are scored whole; repeated rows score alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, bucket_of, buckets, by_key, crc_mod, documents, exchange, records, segments, stored

FEATURES = 1 << 14
CLASSES = 32
END = CLASSES - 1  # the class of the end token, which is its only member
RATE = 0.3
MINIBATCH = 1 << 15
CHUNK = 256  # weight rows in one row of the exchange
FLUSH = 1_000_000  # tokens a task holds before it sends its counts on
MAX_DOCS = 60_000

_BEGIN, _STOP = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token hashes with one end token for each document, their classes, feature rows (3 x tokens), and token offsets."""
    low = T.lower_ascii(data)
    w = T.find_words(low, off)
    docs = len(off) - 1
    h = T.range_hashes(low, w.start, w.end)
    padded = np.append(np.zeros(3, dtype=np.uint8), low).astype(np.uint64)
    size = w.end - w.start
    last = padded[w.end + 2] | np.where(size > 1, padded[w.end + 1], np.uint64(0)) << np.uint64(8) | np.where(size > 2, padded[w.end], np.uint64(0)) << np.uint64(16)
    cls = (T.mix64(last) >> np.uint64(32)) % np.uint64(CLASSES - 1)
    at = np.arange(len(h)) + w.doc
    n = len(h) + docs
    first = w.first + np.arange(docs + 1)
    tok, kind = np.full(n, _STOP), np.full(n, END, dtype=np.int64)
    tok[at], kind[at] = h, cls.astype(np.int64)
    prev = np.append(_BEGIN, tok[:-1])
    prev[first[:-1]] = _BEGIN
    skip = np.append(_BEGIN, prev[:-1])
    skip[first[:-1]] = _BEGIN
    rows = np.stack([T.mix64(prev), T.mix64(skip + np.uint64(1)), T.mix64(prev * T._STEP + skip)]) >> np.uint64(50)
    return tok, kind, rows.astype(np.int64) % FEATURES, first


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[FEATURES] + weights[rows[0]]
    z += weights[rows[1]]
    z += weights[rows[2]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def learn(weights: np.ndarray, power: np.ndarray, seen: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> None:
    """One gradient step on a minibatch, in place."""
    g = np.exp(log_softmax(weights, rows))
    g[np.arange(len(kind)), kind] -= 1
    step = g.sum(axis=0)
    power[FEATURES] += (step * step).mean()
    weights[FEATURES] -= RATE * step / np.sqrt(power[FEATURES])
    seen[FEATURES] += len(kind)
    for f in rows:
        order = np.argsort(f, kind="stable")
        lo, hi = segments(f[order])
        which = f[order][lo]
        step = np.add.reduceat(g[order], lo, axis=0)
        power[which] += (step * step).mean(axis=1)
        weights[which] -= RATE * step / np.sqrt(power[which])[:, None]
        seen[which] += hi - lo


_WEIGHTS = pa.schema([("bucket", pa.int32()), ("w", pa.binary()), ("n", pa.binary())])


def train(docs: DataFrame) -> np.ndarray:
    """Averaged weights (FEATURES + 1 rows, the last is the bias) after one pass of every task over its documents."""
    n = buckets(docs.sparkSession)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((FEATURES + 1, CLASSES), dtype=np.float32)
        power, seen = np.full(FEATURES + 1, 1e-6, dtype=np.float32), np.zeros(FEATURES + 1, dtype=np.float32)
        for b in batches:
            data, off = T.flat(b.column(0))
            for lo, hi in T.slices(off):
                _, kind, rows, _ = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for i in range(0, len(kind), MINIBATCH):
                    learn(weights, power, seen, kind[i : i + MINIBATCH], rows[:, i : i + MINIBATCH])
        if seen[FEATURES]:
            for k in range(0, FEATURES + 1, CHUNK):
                w, m = weights[k : k + CHUNK] * seen[k : k + CHUNK, None], seen[k : k + CHUNK]
                yield batch(_WEIGHTS, bucket=[k // CHUNK], w=[w.tobytes()], n=[m.tobytes()])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _sums(batches):
            w, m = rows
            yield batch(_WEIGHTS, bucket=[key], w=[(w / np.maximum(np.repeat(m, CLASSES), 1)).astype(np.float32).tobytes()], n=[m.astype(np.float32).tobytes()])

    def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        at, w, m = None, None, None
        for b in batches:
            for r in b.to_pylist():
                x, y = np.frombuffer(r["w"], dtype=np.float32).astype(np.float64), np.frombuffer(r["n"], dtype=np.float32).astype(np.float64)
                if r["bucket"] != at:
                    if at is not None:
                        yield at, [w, m]
                    at, w, m = r["bucket"], x, y
                else:
                    w, m = w + x, m + y
        if at is not None:
            yield at, [w, m]

    ddl = "bucket int, w binary, n binary"
    parts = exchange(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(steps, ddl), n).mapInArrow(average, ddl)
    out = np.zeros((FEATURES + 1, CLASSES), dtype=np.float32)
    for r in parts.select("bucket", "w").collect():  # FEATURES / CHUNK + 1 rows of fixed size
        x = np.frombuffer(r["w"], dtype=np.float32).reshape(-1, CLASSES)
        out[r["bucket"] * CHUNK : r["bucket"] * CHUNK + len(x)] = x
    return out


#: kind 0: words of a task's batch (hashes ``a``, training counts ``b``, classes ``c``, documents of each ``d``, document
#: numbers ``e``, times ``f``); 1: the batch's documents (``ids``, tokens ``a``, class log-probabilities ``b``, class counts
#: ``c``, training flags are in ``d``); 2: totals of each class (``a``: tokens, ``b``: words); 3: sums for the batch's documents.
_ROWS = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("uid", pa.int64()), ("ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in "abcdef")])
_DDL = "kind byte, bucket int, uid long, ids array<long>, " + ", ".join(f"{x} binary" for x in "abcdef")


def _pack(x: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed: sorted hashes and small numbers take little."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _row(kind: int, bucket: int, uid: int | None, ids: list | None = None, **blobs: np.ndarray) -> dict:
    return {"kind": kind, "bucket": bucket, "uid": uid, "ids": ids, **{x: _pack(blobs[x]) if x in blobs else None for x in "abcdef"}}


def _count_and_score(weights, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, flushes = weights.value, TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n_docs = n_tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            uid = (part << 24) + flushes
            ids = [i for x in held for i in x[0]]
            taught = np.concatenate([x[1] for x in held])
            size, score, counts = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            tok, kind, doc = (np.concatenate([x[k] for x in held]) for k in (5, 6, 7))
            rows = [_row(1, uid % n_buckets, uid, ids, a=size, b=score, c=counts.astype(np.uint32), d=taught)]
            word = kind != END
            order = np.lexsort((doc[word], tok[word]))
            tok, kind, doc = tok[word][order], kind[word][order], doc[word][order]
            lo, hi = segments(tok)
            learnt = np.append(0, np.cumsum(taught[doc]))
            new = np.append(True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])) if len(tok) else np.zeros(0, dtype=bool)
            pair = np.flatnonzero(new)
            times = np.diff(np.append(pair, len(tok))).astype(np.uint32)
            each = np.searchsorted(pair, hi) - np.searchsorted(pair, lo)
            first = np.append(0, np.cumsum(each))
            h, train_count, cls, pdoc = tok[lo], (learnt[hi] - learnt[lo]).astype(np.uint32), kind[lo], doc[pair]
            for x, y in zip(*segments(bucket_of(h, n_buckets)), strict=True):
                p, q = first[x], first[y]
                rows.append(_row(0, int(bucket_of(h[x : x + 1], n_buckets)[0]), uid, [len(ids)], a=h[x:y], b=train_count[x:y], c=cls[x:y], d=each[x:y].astype(np.uint32), e=pdoc[p:q], f=times[p:q]))
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

        for b in batches:
            data, off = T.flat(b.column(1))
            teach = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in T.slices(off):
                tok, kind, rows, first = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                score = np.zeros(len(tok) + 1)
                for i in range(0, len(tok), MINIBATCH):
                    z = log_softmax(w, rows[:, i : i + MINIBATCH])
                    score[i + 1 : i + 1 + len(z)] = z[np.arange(len(z)), kind[i : i + MINIBATCH]] / np.log(10)
                score = np.cumsum(score)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                counts = np.bincount(doc * CLASSES + kind, minlength=(hi - lo) * CLASSES)
                held.append((b.column(0).slice(lo, hi - lo).to_pylist(), teach[lo:hi], np.diff(first), score[first[1:]] - score[first[:-1]], counts, tok, kind.astype(np.uint8), (doc + n_docs).astype(np.uint16)))
                n_docs, n_tokens = n_docs + hi - lo, n_tokens + len(tok)
                if n_tokens >= FLUSH or n_docs >= MAX_DOCS - 4096:
                    yield from flush()
                    held, n_docs, n_tokens, flushes = [], 0, 0, flushes + 1
        if held:
            yield from flush()

    return run


def _totals(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """In the bucket of a word: its count in the training part; class totals; each document's share of the sums."""
    for key, rows in by_key(batches, "bucket"):
        passed = [r for r in rows if r["kind"] == 1]
        if passed:
            yield pa.RecordBatch.from_pylist(passed, schema=_ROWS)
        rows = [r for r in rows if r["kind"] == 0]
        if not rows:
            continue
        h = np.concatenate([_unpack(r["a"], np.uint64) for r in rows])
        taught = np.concatenate([_unpack(r["b"], np.uint32) for r in rows])
        cls = np.concatenate([_unpack(r["c"], np.uint8) for r in rows])
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(inv, weights=taught, minlength=len(uniq))
        kinds = cls[first]
        yield pa.RecordBatch.from_pylist([_row(2, key, None, a=np.bincount(kinds, weights=count, minlength=CLASSES), b=np.bincount(kinds, weights=count > 0, minlength=CLASSES).astype(np.float64))], schema=_ROWS)
        at = 0
        for r in rows:
            each = _unpack(r["d"], np.uint32)
            k = len(each)
            c = count[inv[at : at + k]]
            at += k
            doc, times = _unpack(r["e"], np.uint16).astype(np.int64), _unpack(r["f"], np.uint32).astype(np.float64)
            docs = r["ids"][0]
            logs, known = np.repeat(np.log10(c + 0.5), each), np.repeat(c > 0, each)
            yield pa.RecordBatch.from_pylist([_row(3, r["uid"] % n_buckets, r["uid"], a=np.bincount(doc, weights=times * logs, minlength=docs), b=np.bincount(doc, weights=times * known, minlength=docs).astype(np.uint32))], schema=_ROWS)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(batches: Iterator[pa.RecordBatch], tokens_: float, words: float, ends: int, by_class: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In the bucket of a batch: add up the shares of its documents."""

    def close(docs: dict | None, logs, known) -> pa.RecordBatch:
        size = _unpack(docs["a"], np.int64)
        k = len(size)
        counts = _unpack(docs["c"], np.uint32).reshape(k, CLASSES).astype(np.float64)
        total, seen = (np.zeros(k) if x is None else x for x in (logs, known))
        base = total + np.log10(ends + 0.5) - size * np.log10(tokens_ + 0.5 * (words + 1))
        score = total + _unpack(docs["b"], np.float64) - counts @ by_class
        return batch(_OUT, doc_id=docs["ids"], n_tokens=size, n_known=seen.astype(np.int64) + (ends > 0), base_score=base, score=score)

    at, docs, logs, known = None, None, None, None
    for b in batches:
        for r in b.to_pylist():
            if r["uid"] != at:
                if docs is not None:
                    yield close(docs, logs, known)
                at, docs, logs, known = r["uid"], None, None, None
            if r["kind"] == 1:
                docs = r
            else:
                x, y = _unpack(r["a"], np.float64), _unpack(r["b"], np.uint32).astype(np.float64)
                logs, known = (x, y) if logs is None else (logs + x, known + y)
    if docs is not None:
        yield close(docs, logs, known)


def score_texts(docs: DataFrame, teach) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document; ``teach``: a column, true for the
    documents to learn from."""
    spark = docs.sparkSession
    n = buckets(spark) // 4  # every bucket returns a number for each document
    docs = records(docs, F.coalesce(teach, F.lit(False)).alias("teach"))
    weights = spark.sparkContext.broadcast(train(docs.filter("teach")))  # (FEATURES + 1) x CLASSES numbers
    counted = exchange(docs.mapInArrow(_count_and_score(weights, n), _DDL), 4 * n)
    rows = stored(counted.mapInArrow(lambda b: _totals(b, n), _DDL))
    total = np.zeros((2, CLASSES))
    for r in rows.filter("kind = 2").select("a", "b").collect():  # two small arrays from each bucket
        total += np.stack([_unpack(r["a"], np.float64), _unpack(r["b"], np.float64)])
    ends = docs.filter("teach").count()
    by_class = np.log10(total[0] + 0.5 * (total[1] + 1))
    by_class[END] = 0
    n_train, n_words = float(total[0].sum()) + ends, float(total[1].sum()) + (ends > 0)
    out = exchange(rows.filter("kind = 1 or kind = 3"), 4 * n, "bucket", "uid", "kind").mapInArrow(lambda b: _finish(b, n_train, n_words, ends, by_class), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(n_train)).cast("long"))


def op7_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(documents(spark, sf_dir), crc_mod("doc_id", 5) != 1)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
