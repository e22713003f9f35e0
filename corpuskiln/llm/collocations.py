"""Phrase collocations: n-grams as DataFrame rows, counted per language, scored in Decimal.

A text is lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. All n-grams
of 1 to ``max_n`` words inside a piece become rows (lang, phrase, f), summed by Spark. An n-gram can only be found
``min_count`` times if both (n-1)-grams within it are, so the lengths are counted one after the other, and rows are written
only for those n-grams whose parts passed: nothing that could be a candidate is left out. What passed goes to the
tasks as a bit table of fixed size (``FILTER_BITS``); two n-grams on one bit only let rows through that the exact count
drops again, so results do not depend on the size of the table.

A candidate (2 to ``max_n`` words, f = a >= ``min_count``) is cut after each of its words; with l and r the counts of both
parts, the lowest floor(2000000 a / (l + r)) counts. Candidates whose words lie inside a longer one with
100 f >= 80 a are anti-joined away; every longer phrase holds a one-word extension that is at least as
frequent, so those suffice.

Cases: a null or empty text has no words; a null language is ``und``; long texts are counted whole; repeated rows count
as often as they are there; ties go by a descending, then by the phrase's bytes; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, records, stored

MAX_N = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
EXTENSION_PERCENT = 80
FILTER_BITS = 1 << 26  # of one length's table, 8 MB
SLICE_BYTES = 2 << 20  # of text that a task counts at once; a longer text comes alone
SALTS = 64  # parts of a language in the first ranking
UND = "und"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[*(ord(c) for c in ".,;:!?"), *range(0x0A, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("f", pa.int64())])


class Slice:
    """Words of the texts of one language: codes, their dictionary, and which neighbours share a piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = T.lower_ascii(data)
        cut = _CUT[data]
        inside = ~(cut | _BLANK[data])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = off[:-1][off[:-1] < len(data)]
        begins[edge] = inside[edge]
        start = np.flatnonzero(begins)
        ends = np.append(np.cumsum(inside)[start[1:] - 1], inside.sum()) if len(start) else np.zeros(0, dtype=np.int64)
        piece = np.cumsum(cut)[start] + np.searchsorted(off, start, side="right") if len(start) else start
        self.joined = piece[1:] == piece[:-1]  # documents and cuts both raise the number
        kept = data[inside]
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(kept))
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.cast(pa.large_string())

    def hashes(self, salt: np.uint64) -> np.ndarray:
        data, off = T.flat(self.words)
        return T.mix64(T.range_hashes(data, off[:-1], off[1:]) + salt)


def _salt(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode("utf-8", "replace"), dtype=np.uint8)
    return T.range_hashes(raw, np.array([0]), np.array([len(raw)]))[0] if len(raw) else np.uint64(1)


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and its last word."""
    return T.mix64(h * _STEP + last)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h % np.uint64(8 * len(bits))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def count_slice(s: Slice, n: int, salt: np.uint64, tables: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The n-grams of a slice whose parts pass ``tables`` (of lengths 1 to n - 1), and how often each is there."""
    size = len(s.words)
    if n == 1:
        return s.words, np.bincount(s.codes, minlength=size)
    word = s.hashes(salt)
    good = _passes(word, tables[0])[s.codes] if len(s.codes) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(s.joined & good[:-1] & good[1:])  # first word of each n-gram
    code, parts, h = s.codes, [np.arange(size)], word
    for k in range(2, n + 1):
        key, inverse, counts = np.unique(code[at] * size + s.codes[at + k - 1], return_inverse=True, return_counts=True)
        parts = [p[key // size] for p in parts] + [key % size]
        if k == n:
            break
        h = _longer(h[key // size], word[key % size])
        code = np.full(len(s.codes) + 1, -1, dtype=np.int64)
        code[at] = np.where(_passes(h, tables[k - 1]), np.arange(len(key)), -1)[inverse]
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))  # both parts of k words pass
    return pc.binary_join_element_wise(*(s.words.take(pa.array(p)) for p in parts), pa.scalar(" ", pa.large_string())), counts


def _counted(docs: DataFrame, n: int, tables: list) -> DataFrame:
    """(lang, phrase, f) rows of one length, summed; for single words also a row with a null phrase: all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [t.value for t in tables]
        for b in batches:
            for lang in b.column(0).unique().to_pylist():
                data, off = T.flat(b.column(1).filter(pc.equal(b.column(0), lang)))
                for lo, hi in T.slices(off, SLICE_BYTES):
                    s = Slice(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    if not len(s.codes):
                        continue
                    phrases, counts = count_slice(s, n, _salt(lang), held)
                    if n == 1:
                        phrases, counts = pa.concat_arrays([phrases, pa.array([None], pa.large_string())]), np.append(counts, len(s.codes))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases, pa.array(counts.astype(np.int64))], schema=_COUNTS)

    rows = records(docs, F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang")).select("lang", "text")
    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _table(frequent: DataFrame, size: int):
    """Bits of all phrases of one length that passed, as a broadcast of ``size`` bits whatever the input."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in b.column(0).unique().to_pylist():
                phrases = b.column(1).filter(pc.equal(b.column(0), lang)).cast(pa.large_string())
                salt, split = _salt(lang), pc.split_pattern(phrases, " ")
                data, off = T.flat(pc.list_flatten(split))
                word, first = T.mix64(T.range_hashes(data, off[:-1], off[1:]) + salt), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
                h = word[first[:-1]]
                for k in range(1, int((first[1:] - first[:-1]).max(initial=1))):  # all phrases have the same length
                    h = _longer(h, word[first[:-1] + k])
                yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(size)).astype(np.int64))], names=["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(places, "bit long")
    bits = bits.groupBy(F.expr("bit div 32768").alias("at")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))  # 4 KB each, 2048 at most
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in bits.collect():
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``max_n`` words found ``min_count`` times, and (lang, n)."""
    found, tables, total = None, [], None
    for n in range(1, max_n + 1):
        rows = stored(_counted(docs, n, tables).filter(f"f >= {int(min_count)} or phrase is null"))
        if n == 1:
            total = rows.filter("phrase is null").select("lang", F.col("f").alias("n"))
            rows = rows.filter("phrase is not null")
        if n < max_n:
            tables.append(_table(rows, filter_bits))
        rows = rows.select("lang", "phrase", F.lit(n).alias("words"), "f")
        found = rows if found is None else found.unionByName(rows)
    return found, total


def _dec(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every candidate, by its lowest-scoring cut."""
    several = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, words), ' ')").alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("num", F.lit(SCALE).cast("decimal(7,0)") * _dec("a")).withColumn("den", _dec("l") + _dec("r")).withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates that no one-word extension holds nearly as often."""
    w = F.split("phrase", " ")
    shorter = candidates.filter("words > 2").select("lang", F.col("a").alias("f"), "words", w.alias("w"))
    shorter = shorter.select("lang", "f", F.explode(F.expr("array(array_join(slice(w, 1, words - 1), ' '), array_join(slice(w, 2, words - 1), ' '))")).alias("inner"))
    longest = shorter.groupBy("lang", "inner").agg(F.max("f").alias("f")).withColumnRenamed("lang", "of")
    covers = _dec("f") * F.lit(100).cast("decimal(3,0)") >= _dec("a") * F.lit(EXTENSION_PERCENT).cast("decimal(3,0)")
    return candidates.join(longest, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")) & covers, "left_anti")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, total = frequent_phrases(docs, max_n, min_count, filter_bits)
    kept = maximal(scored(found))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language is ranked in parts first, so that the last ranking gets SALTS * top rows of it at most
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", F.row_number().over(parts)).filter(F.col("at") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
