"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is escaped as the model says (a blank becomes the mark U+2581, one mark is put in front), cut before every mark
and around control characters that no longer piece holds (no piece reaches over those), and each distinct word is segmented so that the sum of the
piece scores is greatest. Words of equal length advance together: hashes of their substrings probe the sorted keys of the
pieces, vectorised maxima keep scores and back pointers, ties take the longer last piece. Characters that no piece covers
become byte pieces. For unigram models this is the library's own segmentation. A merge-rank model has no probabilities; its ranks
are taken as Zipf's ranks, and the most probable segmentation need not be the one that its merges would build.

Cases: a null or empty text has no pieces and decodes to the empty text; long texts and words are encoded whole; a mark
in the text itself decodes to a blank, as in the library; repeated rows are encoded alike; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, records

MARK = "▁"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
UNKNOWN = -1e7  # score of a character in byte pieces; below any usable piece
UNUSED = -1e8  # pieces scored below this are never taken
CACHE = 300_000
SLICE = 1024


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _spread(code: int) -> int:
    """A code point as a number with filled high bits."""
    return (code + 1) * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF


class Pieces:
    """Sorted hashed piece keys with ids and scores, byte pieces, and the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, dtype=np.int32)
        table, raw = {}, []
        for i, t in enumerate(text):
            if model.is_byte(i):
                self.byte[int(t[1:-1], 16)] = i
                raw.append(bytes([int(t[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(t.replace(MARK, " ").encode())
                if model.get_score(i) > UNUSED or len(t) == 1:
                    if MARK in t[1:]:
                        raise ValueError(f"a piece reaches over a word border: {t!r}")
                    table[t] = (i, model.get_score(i))
        self.longest = max(map(len, table))
        inner = {c for t in table if len(t) > 1 for c in t}
        hard = "".join(re.escape(chr(c)) for c in range(0x20) if chr(c) not in inner)  # each of these is a word of its own
        self.word = re.compile(f"{MARK}[^{MARK}{hard}]*|[^{MARK}{hard}]+|[{hard}]")
        keys = np.array([self.key(t) for t in table], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[keys >> np.uint64(44)] = True
        self.power = [np.uint64(pow(int(_MULT), k, 1 << 64)) for k in range(self.longest + 1)]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("piece keys collide")
        self.ids = np.array([v[0] for v in table.values()], dtype=np.int32)[order]
        self.scores = np.array([v[1] for v in table.values()])[order]
        if (self.scores == np.round(self.scores)).all():  # merge ranks: take them as Zipf's, log(1 / (rank * sum of 1 / rank))
            rank = np.argsort(np.argsort(-self.scores, kind="stable"), kind="stable") + 2
            self.scores = -np.log(rank * (1 / rank).sum())
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.append(0, np.cumsum([len(r) for r in raw]))
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_MULT) + _spread(ord(c))) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are pieces, their scores and ids; a small bit table first rules most others out."""
        maybe = np.flatnonzero(self.sieve[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.scores[at[hit]], self.ids[at[hit]]

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one length, all advancing together."""
        n, b = len(words[0]), len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(b, n).astype(np.uint64)
        code = (code + np.uint64(1)) * _SPREAD
        prefix = np.zeros((b, n + 1), dtype=np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _MULT + code[:, j]
        best = np.full((b, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((b, n + 1), dtype=np.int32)
        took = np.full((b, n + 1), -1, dtype=np.int32)
        for j in range(1, n + 1):
            best[:, j], back[:, j] = best[:, j - 1] + UNKNOWN, 1
            for size in range(1, min(j, self.longest) + 1):
                row, score, piece = self._probe(prefix[:, j] - prefix[:, j - size] * self.power[size])
                score = score + best[row, j - size]
                better = score >= best[row, j]
                row = row[better]
                best[row, j], back[row, j], took[row, j] = score[better], size, piece[better]
        path = np.full((b, n), -2, dtype=np.int32)  # pieces from the last to the first; -1: byte pieces
        at, live, k = np.full(b, n), np.arange(b), 0
        while len(live):
            j = at[live]
            path[live, k] = took[live, j]
            at[live] = j - back[live, j]
            live, k = live[at[live] > 0], k + 1
        path = path[:, ::-1]
        used = path != -2
        flat = path[used]
        end = np.cumsum(used.sum(axis=1)).tolist()
        out = [flat[x:y] for x, y in zip([0, *end[:-1]], end, strict=True)]
        for i in np.flatnonzero((path == -1).any(axis=1)):
            ids, place = [], 0
            for p, size in zip(out[i].tolist(), self._sizes(back[i], n), strict=True):
                ids.append(np.array([p]) if p >= 0 else self.byte[np.frombuffer(words[i][place].encode("utf-8", "surrogatepass"), dtype=np.uint8)])
                place += size
            out[i] = np.concatenate(ids).astype(np.int32)
        return out

    @staticmethod
    def _sizes(back: np.ndarray, n: int) -> list[int]:
        out = []
        while n:
            out.append(int(back[n]))
            n -= out[-1]
        return out[::-1]

    def lookup(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words, new ones by groups of equal length."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new: dict[int, list[str]] = {}
        for w in words:
            if w not in self.cache:
                new.setdefault(len(w), []).append(w)
        for group in new.values():
            step = max(1, 400_000 // len(group[0]))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                self.cache.update(zip(part, self.segment(part), strict=True))
        return [self.cache[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        number: dict[str, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in self.word.findall(MARK + t.replace(" ", MARK))], dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
        ids = self.lookup(list(number))
        size = np.array([len(x) for x in ids], dtype=np.int64)
        table = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        base = np.cumsum(size) - size
        return [_gather(table, base, size, d) for d in docs]

    def decode(self, ids: np.ndarray) -> str:
        size = np.diff(self.raw_at)
        raw = _gather(self.raw, self.raw_at[:-1], size, ids).tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _gather(table: np.ndarray, base: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    each = size[which]
    total = np.cumsum(each)
    return table[np.repeat(base[which] - (total - each), each) + np.arange(int(total[-1]))] if len(which) else table[:0]


@lru_cache(maxsize=2)
def _load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the piece ids of every text."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(path)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                texts = [t or "" for t in b.column(1).slice(lo, SLICE).to_pylist()]
                yield batch(schema, doc_id=b.column(0).slice(lo, SLICE), ids=model.encode(texts))

    return records(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of piece ids."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(path)
        for b in batches:
            ids = b.column(1)
            yield batch(schema, doc_id=b.column(0), text=[model.decode(ids[i].values.to_numpy()) if ids[i].is_valid else "" for i in range(b.num_rows)])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), n_bytes, and whether decoding gives the text back."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(path)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                texts = [t or "" for t in b.column(1).slice(lo, SLICE).to_pylist()]
                ids = model.encode(texts)
                yield batch(schema, doc_id=b.column(0).slice(lo, SLICE), n_pieces=[len(x) for x in ids], ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in ids], n_bytes=[len(t.encode()) for t in texts], exact=[model.decode(x) == t for x, t in zip(ids, texts, strict=True)])

    return records(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, exact boolean")


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
