"""Token ids in grammar-compressed files: Re-Pair per shard, with expansion lengths for random access.

``write`` encodes every text, appends ``END`` and deals documents by ranges of ``doc_id``, so that the tasks hold them in
ascending order. A task cuts its documents into shards of about ``SHARD_TOKENS`` ids. In a shard frequent pairs of
neighbouring symbols are replaced by nonterminals, again and again, the most frequent ones first: each round takes pairs down
to an eighth of the count that the round before went down to, at last to ``MIN_PAIR``, until a round replaces less than one
symbol in ``LEAST_GAIN`` or ``MAX_RULES`` rules are there; a pair never reaches over a document's end. A shard is one row of the table ``shards``
(Parquet, so a task that dies leaves nothing behind) with the ids of its documents, their lengths, and a binary body:

    magic, width of a symbol, first nonterminal, numbers of rules, symbols and documents (little-endian 32-bit numbers)
    rules: left and right symbols, expansion lengths (32 bits each)
    first symbol of each document and the end (32 bits each)
    symbols (16 bits where they fit, else 32)

``read`` expands all of it; ``read_ranges`` expands only those symbols that a wanted range of a document touches, found in the
sums of the expansion lengths. ``starts`` gives the number of ids before each shard from the table's small columns.

Ids are made with the merge ranks of the tokenizer's vocabulary, as in ``packing``; texts that hold a special token's string go
through the tokenizer itself.

Cases: a null or empty text is ``END`` alone; a null ``doc_id`` comes first and stays null; equal ids stand next to each other, by
text; a longer document than a shard is a shard of its own; an empty table gives empty files and no rows; other columns are
not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, records, shared_folder
from .packing import SPECIAL, Encoder, vocabulary_paths

END = 0
SHARD_TOKENS = 1 << 20
MIN_PAIR = 12  # a rule takes 12 bytes, a replaced pair saves a symbol
MAX_RULES = 15_000  # with 50 257 ids all symbols fit into 16 bits
STEP = 8
LEAST_GAIN = 200
SLICE_BYTES = 4 << 20  # of text encoded at once
CACHE = 500_000  # chunks that a worker remembers, about 100 MB
_HEAD = struct.Struct("<4s6I")
_MAGIC = b"RPG1"
_TABLED = 64  # rules that expand to so many ids at most are expanded by one lookup
_SLOTS = 16
_SPREAD, _SPREAD32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B9)
_NONE = np.int32(1 << 30)
_SHARDS = "part int, nth int, n_docs long, n_tokens long, doc_ids array<long>, lengths array<int>, body binary"


@lru_cache(maxsize=2)
def encoder(paths: tuple[str, str]) -> Encoder:
    """One encoder for all tasks of a worker, so that its cache of chunks lives on."""
    enc = Encoder(*paths)
    enc.CACHE = CACHE
    return enc


def _frequent(key: np.ndarray, least: int | None, room: int) -> tuple[np.ndarray, int]:
    """Pairs of a round, most frequent first (ties: the smaller pair), and the count they go down to."""
    s = np.sort(key)
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(begin, len(s)))
    least = max(MIN_PAIR, (int(count.max(initial=0)) if least is None else least) // STEP)
    some = np.flatnonzero(count >= least)
    some = some[np.argsort(-count[some], kind="stable")][:room]
    return s[begin[some]], least


def _slots(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint32:
        return key * _SPREAD32 >> np.uint32(32 - _SLOTS)
    return (key * _SPREAD >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _ranks(key: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Rank of each pair among the chosen ones, or _NONE. Of chosen pairs on one slot only the first is used in this round."""
    table = np.full(1 << _SLOTS, len(chosen), dtype=np.int32)
    table[_slots(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    got = table[_slots(key)]
    some = np.flatnonzero(got < len(chosen))
    rank, got = np.full(len(key), _NONE, dtype=np.int32), got[some]
    rank[some] = np.where(chosen[got] == key[some], got, _NONE)
    return rank


def compress(ids: np.ndarray, first: np.ndarray, base: int | None = None, max_rules: int = MAX_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of concatenated documents: rules (left, right), expansion lengths, symbols, first symbol of each document.

    ``first`` holds the documents' offsets and the end; nonterminals count from ``base`` (default: above the largest id)."""
    base = int(ids.max(initial=0)) + 1 if base is None else base
    half = 16 if max(base, int(ids.max(initial=0)) + 1) + max_rules <= 1 << 16 else 32  # a pair is one number of twice these bits
    seq, last = ids.astype(np.uint32 if half == 16 else np.uint64), np.zeros(len(ids), dtype=bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    rules, lengths = [np.zeros((0, 2), dtype=np.int64)], np.ones(0, dtype=np.int64)
    made, least = 0, None
    while len(seq) > 1 and made < max_rules:
        inner = ~last[:-1]
        key = seq[:-1] << seq.dtype.type(half) | seq[1:]
        chosen, least = _frequent(key[inner], least, min(max_rules - made, 1 << _SLOTS - 2))
        rank = np.full(len(seq) + 1, _NONE, dtype=np.int32)  # rank[i + 1] is that of the pair (i, i + 1); rank[0] of none
        if len(chosen):
            rank[1:-1] = np.where(inner, _ranks(key, chosen), _NONE)
        own, before, after = rank[1:-1], rank[:-2], rank[2:]
        hit = np.flatnonzero((own < _NONE) & (own <= before) & (own <= after))
        if LEAST_GAIN * len(hit) < len(seq):
            if least <= MIN_PAIR:
                break
            continue
        # of overlapping equal pairs (runs of one symbol) every other one is taken
        run = np.append(True, (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]]))
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        used = np.bincount(own[hit], minlength=len(chosen)) > 0
        number = (np.cumsum(used) - 1 + base + made).astype(seq.dtype)
        pair = chosen[used].astype(np.uint64)
        pair = np.stack([pair >> np.uint64(half), pair & np.uint64((1 << half) - 1)], axis=1).astype(np.int64)
        each = [np.where(side >= base, lengths[np.maximum(side - base, 0)] if made else 1, 1) for side in pair.T]
        rules.append(pair)
        lengths = np.append(lengths, each[0] + each[1])
        seq[hit] = number[own[hit]]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        made += len(pair)
    ends = np.flatnonzero(last) + 1
    return np.concatenate(rules), lengths, seq.astype(np.int64), np.append(0, ends)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    size = np.append(np.ones(base, dtype=np.int64), lengths)
    while len(long := np.flatnonzero(size[symbols] > _TABLED)):  # long ones become their two parts
        where = np.zeros(len(symbols) + 1, dtype=np.int64)
        where[long + 1] = 1
        where = np.arange(len(symbols)) + np.cumsum(where)[:-1]
        pair = rules[symbols[long] - base]
        out = np.empty(len(symbols) + len(long), dtype=np.int64)
        out[where] = symbols
        out[where[long]], out[where[long] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    used = np.unique(symbols)
    table, begin, n = [], np.zeros(len(size), dtype=np.int64), 0
    short: dict[int, list[int]] = {}

    def ids(symbol: int) -> list[int]:
        if symbol < base:
            return [symbol]
        if symbol not in short:
            left, right = rules[symbol - base].tolist()
            short[symbol] = ids(left) + ids(right)
        return short[symbol]

    for symbol in used.tolist():
        begin[symbol] = n
        table.append(got := ids(symbol))
        n += len(got)
    flat = np.fromiter((i for x in table for i in x), dtype=np.uint32, count=n)
    each = size[symbols]
    total = np.cumsum(each)
    return flat[np.repeat(begin[symbols] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)]


def pack_shard(ids: np.ndarray, first: np.ndarray) -> bytes:
    """The body of a shard."""
    base = int(ids.max(initial=0)) + 1
    rules, lengths, symbols, at = compress(ids, first, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    parts = [rules[:, 0], rules[:, 1], lengths, at]
    return _HEAD.pack(_MAGIC, width, base, len(rules), len(symbols), len(first) - 1, zlib.crc32(ids.astype("<u4").tobytes())) + b"".join(p.astype("<u4").tobytes() for p in parts) + symbols.astype(f"<u{width}").tobytes()


class Shard:
    """A body opened for reading."""

    def __init__(self, body: bytes):
        magic, width, self.base, n_rules, n_symbols, n_docs, self.crc = _HEAD.unpack_from(body)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at, arrays = _HEAD.size, []
        for n in (n_rules, n_rules, n_rules, n_docs + 1):
            arrays.append(np.frombuffer(body, dtype="<u4", count=n, offset=at).astype(np.int64))
            at += 4 * n
        self.rules, self.lengths, self.first = np.stack(arrays[:2], axis=1), arrays[2], arrays[3]
        self.symbols = np.frombuffer(body, dtype=f"<u{width}", count=n_symbols, offset=at)

    def ids(self) -> np.ndarray:
        out = expand(self.symbols, self.rules, self.lengths, self.base)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a shard of token ids is damaged")
        return out

    def range(self, doc: int, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of a document, without expanding what lies outside."""
        symbols = self.symbols[self.first[doc] : self.first[doc + 1]].astype(np.int64)
        ends = np.cumsum(np.append(np.ones(self.base, dtype=np.int64), self.lengths)[symbols])
        lo, hi = max(lo, 0), min(hi, int(ends[-1]) if len(ends) else 0)
        if lo >= hi:
            return np.zeros(0, dtype=np.uint32)
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left") + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return expand(symbols[a:b], self.rules, self.lengths, self.base)[skip : skip + hi - lo]


def _encoded(b: pa.RecordBatch, enc: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch, their ids with END after each document, and the documents' offsets."""
    data, off = T.flat(b.column(1))
    for lo, hi in T.slices(off, SLICE_BYTES):
        part = data[off[lo] : off[hi]]
        ids, at = enc.slice(part, off[lo : hi + 1] - off[lo])
        if SPECIAL.encode() in part.tobytes():
            texts = [b.column(1)[i].as_py() or "" for i in range(lo, hi)]
            docs = [np.array(enc.whole(t), dtype=np.int32) if SPECIAL in t else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]
            ids, at = np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs]))
        first = at + np.arange(len(at))
        out = np.full(len(ids) + hi - lo, END, dtype=np.int32)
        inner = np.ones(len(out), dtype=bool)
        inner[first[1:] - 1] = False
        out[inner] = ids
        yield lo, hi, out, first


def write(docs: DataFrame, place: str, shard_tokens: int = SHARD_TOKENS, paths: tuple[str, str] | None = None) -> None:
    """Writes the ids of all texts, in ascending order of doc_id, to ``place``/shards."""
    paths = paths or vocabulary_paths()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, nth = encoder(paths), TaskContext.get().partitionId(), 0
        held, size, keys, lengths = [], 0, [], []

        def close() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            doc_ids = pa.concat_arrays(keys)
            body = pack_shard(np.concatenate(held), np.append(0, np.cumsum(n)))
            cols = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([size], pa.int64())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), doc_ids), pa.array([n.astype(np.int32)]), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "nth", "n_docs", "n_tokens", "doc_ids", "lengths", "body"])

        for b in batches:
            for lo, hi, ids, first in _encoded(b, enc):
                while lo < hi:  # documents that still fit, at least one
                    room = first[0] + max(1, shard_tokens - size)
                    fit = max(1 if not held else 0, int(np.searchsorted(first, room, side="right")) - 1)
                    if fit:
                        held.append(ids[first[0] : first[fit]])
                        keys.append(b.column(0).slice(lo, fit))
                        lengths.append(np.diff(first[: fit + 1]))
                        size += int(first[fit] - first[0])
                        lo, first = lo + fit, first[fit:]
                    if size >= shard_tokens or lo < hi:
                        yield close()
                        held, size, keys, lengths, nth = [], 0, [], [], nth + 1
        if held:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = records(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, _SHARDS).write.parquet(f"{place}/shards")


def starts(spark: SparkSession, place: str) -> DataFrame:
    """(part, nth, before): the ids before each shard. Sums of parts first, so one window gets a row for each part only."""
    rows = spark.read.parquet(f"{place}/shards").select("part", "nth", "n_tokens")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(parts, "part").select("part", "nth", (F.col("within") + F.col("parts_before")).alias("before"))


def read(spark: SparkSession, place: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; the ids as well if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, n = Shard(b.column(4)[i].as_py()).ids(), b.column(3)[i].values.to_numpy()
                ids, end = ids.astype("<u4"), np.cumsum(n, dtype=np.int64)
                raw, at = memoryview(ids.tobytes()), [0, *(4 * end).tolist()]
                crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
                cols = [b.column(2)[i].values, *(pa.array([b.column(k)[i].as_py()] * len(n), pa.int32()) for k in (0, 1)), pa.array(end - n), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())]
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(len(n), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "nth", "within", "n_tokens", "ids_crc32", "ids"])

    shards = spark.read.parquet(f"{place}/shards").select("part", "nth", "doc_ids", "lengths", "body")
    rows = shards.mapInArrow(run, "doc_id long, part int, nth int, within long, n_tokens long, ids_crc32 long, ids array<int>").join(starts(spark, place), ["part", "nth"])
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_ranges(spark: SparkSession, place: str, wanted: DataFrame) -> DataFrame:
    """Ids of ranges of documents, for rows (doc_id, lo, hi): doc_id, lo, hi, ids.

    Only shards that hold a wanted document leave the disk; each meets its ranges in one exchange and comes before them, so a
    task holds one body at a time however many ranges a shard has. Ranges of unknown or null ids give no rows."""
    shards = spark.read.parquet(f"{place}/shards")
    index = shards.select("part", "nth", F.posexplode("doc_ids").alias("pos", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    asked = asked.join(index, "doc_id").select("part", "nth", "pos", "doc_id", "lo", "hi", F.lit(None).cast("binary").alias("body"))
    bodies = shards.join(asked.select("part", "nth").distinct(), ["part", "nth"], "left_semi")
    none = F.lit(None).cast("long")
    bodies = bodies.select("part", "nth", F.lit(-1).alias("pos"), none.alias("doc_id"), none.alias("lo"), none.alias("hi"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            pos, found = b.column(2).to_pylist(), []
            for i, (p, lo, hi) in enumerate(zip(pos, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if p < 0:
                    shard = Shard(b.column(6)[i].as_py())
                else:
                    found.append((i, shard.range(p, lo, hi)))
            at = pa.array([i for i, _ in found], pa.int64())
            ids = pa.array([x.view(np.int32) for _, x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (3, 4, 5)), ids], names=["doc_id", "lo", "hi", "ids"])

    rows = bodies.unionByName(asked).repartition("part", "nth").sortWithinPartitions("part", "nth", "pos")
    return rows.mapInArrow(run, "doc_id long, lo long, hi long, ids array<int>")


def shard_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def op13_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shard_folder(spark)
    write(documents(spark, sf_dir), place)
    return read(spark, place)
