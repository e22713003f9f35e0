"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token ids once (ending in id 0), are cut into pieces of at most ``max_len`` tokens, and the histogram
of piece lengths (at most ``max_len`` numbers, whatever the corpus) is packed on the driver: lengths are placed longest
first into the open pack pattern with most room, and only pattern counts are updated. Patterns go back to the pieces by
each piece's rank among those of its length. Padding is what a sequence lacks to ``max_len`` tokens.

Cases: a null or empty text is the single end id; a null ``doc_id`` is kept as null; equal rows get pieces of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, buckets, documents, records, stored

MAX_LEN = 1024
SPECIAL = "<|endoftext|>"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def vocabulary_paths() -> tuple[str, str]:
    """Default vocabulary files: the tokenizer's own file, and the same vocabulary as merge ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of whole texts, equal to ``tokenizers`` on the vocabulary file with add_special_tokens=False.

    A text is cut before every single ASCII blank between two visible characters (there the split rule of the vocabulary
    always cuts), the distinct chunks of a slice are encoded once with the same ranks, and ids are gathered by numpy.
    Texts that hold the special token's string go through the ``tokenizers`` library itself."""

    CACHE = 50_000

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._whole = json_path, None
        self.cache: dict[bytes, bytes] = {}  # 32-bit ids of a chunk
        visible = np.zeros(256, dtype=bool)
        visible[0x21:0x7F] = True
        visible[0xC3] = True  # leads U+00C0..U+00FF, none of which is white space
        self.next_ok = visible
        self.prev_ok = visible.copy()
        self.prev_ok[0xC3] = False
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[0x20, 0x0A, 0x09, 0x0D, 0x0B, 0x0C]] = True

    def whole(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, and their offsets."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(len(off), dtype=np.int64)
        cut = np.zeros(n, dtype=bool)
        if n > 2:
            before = self.prev_ok[data[:-2]]
            before[1:] |= data[:-3] == 0xC3
            cut[1:-1] = self.blank[data[1:-1]] & before & self.next_ok[data[2:]]
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = T.range_hashes(data, start, end)
        _, at, inv = np.unique(h, return_index=True, return_inverse=True)
        raw, cache, encode = data.tobytes(), self.cache, self.bpe.encode_ordinary
        ids = []
        for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True):
            key = raw[s:e]
            got = cache.get(key)
            if got is None:
                got = array("i", encode(key.decode("utf-8", "replace"))).tobytes()
                if len(cache) >= self.CACHE:
                    cache.clear()
                if e - s < 64:
                    cache[key] = got
            ids.append(got)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        table = np.frombuffer(b"".join(ids), dtype=np.int32)
        base = np.cumsum(size) - size
        each = size[inv]
        total = np.cumsum(each)
        first = total - each
        out = table[np.repeat(base[inv] - first, each) + np.arange(int(total[-1]))]
        return out, np.append(first, total[-1])[np.searchsorted(start, off)]


def spfhp(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Pack patterns as ((length, times), ...) with counts: worst fit on the histogram, longest lengths first."""
    room: dict[int, list] = {}

    def put(space: int, pattern: tuple, count: int) -> None:
        room.setdefault(space, []).append((pattern, count))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if room[s] and s >= length), default=None)
            if space is None:
                times = max_len // length  # equal lengths fill new packs together
                full, rest = divmod(left, times)
                if full:
                    put(max_len - times * length, ((length, times),), full)
                if rest:
                    put(max_len - rest * length, ((length, rest),), 1)
                break
            pattern, count = room[space].pop()
            if not room[space]:
                del room[space]
            times = 1 if count >= left else min(space // length, left // count)  # whole counts of one pattern move together
            take = min(count, left)
            if count > take:
                put(space, pattern, count - take)
            put(space - times * length, (*pattern, (length, times)), take)
            left -= take * times
    return [(p, c) for entries in room.values() for p, c in entries]


def _slots(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, sequences of the run, first sequence id and offset of every slot run."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, count in sorted(patterns):
        offset = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, times, sequence, offset))
            used[length] = rank + times * count
            offset += times * length
        sequence += count
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def pieces(docs: DataFrame, max_len: int = MAX_LEN, with_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokenised documents cut into pieces: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    json_path, ranks_path = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(json_path, ranks_path)
        for b in batches:
            data, off = T.flat(b.column(1))
            for lo, hi in T.slices(off):
                part = data[off[lo] : off[hi]]
                ids, at = enc.slice(part, off[lo : hi + 1] - off[lo])
                special = SPECIAL.encode() in part.tobytes()
                doc, start, length, crc, total, kept = [], [], [], [], [], []
                for i in range(lo, hi):
                    own = ids[at[i - lo] : at[i - lo + 1]]
                    if special and SPECIAL in (text := b.column(1)[i].as_py() or ""):
                        own = np.array(enc.whole(text), dtype=np.int32)
                    own = np.append(own, np.int32(0)).astype("<u4")
                    for s in range(0, len(own), max_len):
                        p = own[s : s + max_len]
                        doc.append(i)
                        start.append(s)
                        length.append(len(p))
                        crc.append(zlib.crc32(p.tobytes()))
                        total.append(len(own))
                        kept.append(p.astype(np.int32) if with_ids else None)
                yield batch(_PIECES, doc_id=b.column(0).take(pa.array(doc, pa.int64())), start=start, length=length, ids_crc32=crc, doc_tokens=total, ids=kept)

    out = records(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")
    return out if with_ids else out.drop("ids")


def pack(docs: DataFrame, max_len: int = MAX_LEN, with_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: the columns of ``pieces`` with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, max_len, with_ids, paths))  # texts are tokenised once
    groups = buckets(spark)
    cut = cut.withColumn("g", F.expr(f"pmod(xxhash64(doc_id, start), {groups})").cast("int"))
    counts = stored(cut.groupBy("length", "g").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    slots = spark.sparkContext.broadcast(_slots(spfhp(histogram, max_len)))
    before = counts.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in np.unique(length):
                m = length == size
                first, times, base, start = table[int(size)]
                k = np.searchsorted(first, rank[m], side="right") - 1
                within = rank[m] - first[k]
                seq[m] = base[k] + within // times[k]
                offset[m] = start[k] + within % times[k] * size
            names = [*keep, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=names)

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in keep)
    return ranked.select(*keep, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
