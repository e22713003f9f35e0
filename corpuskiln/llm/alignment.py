"""Alignment of two tokenizers by the byte offsets at which their tokens end.

Texts are tokenised in Python: blank + text by a byte-level vocabulary (A), text by a SentencePiece model that puts the blank in
front itself (B). Both give ids and the byte offset after each token. All that follows is Spark's higher-order functions:

* ``array_intersect`` of both arrays of ends gives the offsets at which tokens of both end; they cut the text into groups;
* the ends of one side only (``array_except``), tagged and sorted with the common ones, tell by their places how many ends of either
  side lie before them, so ``sequence``, ``filter`` and ``transform`` find for every end the token of each side without
  a search: two tokens overlap exactly where one of them ends inside (or at the end of) the other;
* links of one document are sorted, ``filter`` keeps the first of each run, and run lengths are how often it is linked.

Documents with their distinct links are written once to the shared folder. The number of documents of each id pair comes from one
hash aggregation; it goes back to the documents' links by a broadcast while the pairs are at most ``BROADCAST_PAIRS``, else
by a join that Spark can split where a pair is hot; sums over a document's links are one aggregation. (The ``aggregate`` function
is not used: a fold over an array that builds an array copies it at every step.)

Tokens: a text is cut before single blanks between visible characters, where both vocabularies always cut (checked when the
model is loaded), and the distinct chunks are encoded; strings of special tokens are plain text.

Cases: texts that are null, empty, or whose joined tokens are not blank + text (a U+2581 in it, say) have no tokens: zeros
and an empty ``groups_sha256``; equal rows are counted as documents of their own; a null ``doc_id`` stays null; long texts
are aligned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, records, shared_folder

BROADCAST_PAIRS = 1_000_000  # rows of (a, b, count, best): about 100 MB as a hash table
CACHE = 400_000  # chunks that a worker remembers
MARK = "▁"
_BAD = array("i", [-1]).tobytes()


def vocabulary_paths() -> tuple[str, str]:
    """Default files: merge ranks of the byte-level vocabulary, and the SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """One vocabulary: encodes chunks, each a blank and what follows, and remembers them."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.cache: dict[bytes, bytes] = {}
        self.size = np.array([len(t) for t in token_bytes], dtype=np.int64)

    def chunks(self, found: list[bytes]) -> list[bytes]:
        """32-bit ids of each chunk; _BAD where the joined tokens are not the chunk."""
        cache, missing = self.cache, [c for c in found if c not in self.cache]
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = found
        texts = [c.decode("utf-8", "replace") for c in missing]
        for c, ids in zip(missing, self.encode(texts), strict=True):
            cache[c] = array("i", ids).tobytes() if b"".join([self.token_bytes[i] for i in ids]) == c else _BAD
        return [cache[c] for c in found]


@lru_cache(maxsize=2)
def sides(ranks_path: str, model_path: str) -> tuple[Side, Side]:
    """Both vocabularies, once for each worker."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece of the model reaches over a blank")
    of_piece = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    # the model puts the chunk's blank in front itself
    return Side(lambda texts: [bpe.encode_ordinary(t) for t in texts], tokens), Side(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), of_piece)


_PREV = np.zeros(256, dtype=bool)
_PREV[0x21:0x7F] = True
_NEXT = _PREV.copy()
_NEXT[0xC3] = True  # leads U+00C0..U+00FF, none of which is white space


def tokens(data: np.ndarray, off: np.ndarray, both: tuple[Side, Side]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vocabulary ids, ends (counted from the document's blank) and documents' offsets into both.

    ``data`` are the documents of a slice, each with its blank in front; a document that fails in one vocabulary has none."""
    n, docs = len(data), len(off) - 1
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        before = _PREV[data[:-2]]
        before[1:] |= data[:-3] == 0xC3
        cut[1:-1] = (data[1:-1] == 0x20) & before & _NEXT[data[2:]]
    cut[off[:-1]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(raw[s:e], len(number)) for s, e in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.int64, count=len(start))
    doc = np.searchsorted(off, start, side="right") - 1
    found, good = list(number), np.ones(docs, dtype=bool)
    ids = [side.chunks(found) for side in both]
    for got in ids:
        if _BAD in got:
            good[doc[np.array([x == _BAD for x in got])[which]]] = False
    out = []
    for side, got in zip(both, ids, strict=True):
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        table = np.frombuffer(b"".join(got), dtype=np.int32)
        width = np.where(table >= 0, side.size[table], 0)
        each = np.where(good[doc], size[which], 0)
        total = np.cumsum(each)
        at = np.repeat((np.cumsum(size) - size)[which] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)
        first = np.append(0, total)[np.searchsorted(start, off)]
        stop = np.cumsum(width[at])
        begin = np.append(0, stop)[first[:-1]]  # bytes of the documents before
        out.append((table[at], (stop - np.repeat(begin, np.diff(first))).astype(np.int32), first))
    return out


def tokenised(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids (a, b) and ends (ea, eb) of both vocabularies."""
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*paths)
        for b in batches:
            data, off = T.flat(b.column(1))
            for lo, hi in T.slices(off):
                long = np.flatnonzero(off[lo + 1 : hi + 1] > off[lo:hi]) + lo  # with a text
                bounds = np.append(0, np.cumsum(off[long + 1] - off[long] + 1))
                spaced = np.full(int(bounds[-1]), 0x20, dtype=np.uint8)
                inner = np.ones(len(spaced), dtype=bool)
                inner[bounds[:-1]] = False
                spaced[inner] = data[off[lo] : off[hi]]
                cols = []
                for ids, ends, first in tokens(spaced, bounds, both) if len(long) else [(np.zeros(0, np.int32),) * 2 + (np.zeros(1, np.int64),)] * 2:
                    count = np.zeros(hi - lo + 1, dtype=np.int64)
                    count[long - lo + 1] = np.diff(first)
                    offsets = pa.array(np.cumsum(count).astype(np.int32))
                    cols += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), cols[0], cols[2], cols[1], cols[3]], names=["doc_id", "a", "b", "ea", "eb"])

    return records(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, ea array<int>, eb array<int>")


def _then(df: DataFrame, keep: list[str], **made: str) -> DataFrame:
    """``df`` with columns made of its own by SQL expressions, each worked out once.

    The row is handed on as the only element of an array, so that no later expression is put together with these. The
    struct is made in a projection of its own: there array functions run as compiled code, in a generator they would not."""
    fields = ", ".join([*(f"'{c}', {c}" for c in keep), *(f"'{c}', {e}" for c, e in made.items())])
    return df.selectExpr(f"named_struct({fields}) as r").selectExpr("inline(array(r))")


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (the text of them), links (array of a, b, n: how often they are linked)."""
    rows = tokenised(docs, paths)
    none = "cast(array() as array<int>)"
    # every end once, in order: 4e where tokens of both end, 4e + 1 where only one of A does, 4e + 2 where only one of B does
    ends = ", ".join(f"transform({e}, e -> coalesce(4L * e + {tag}, 0L))" for e, tag in (("cuts", 0), ("array_except(ea, cuts)", 1), ("array_except(eb, cuts)", 2)))
    rows = _then(rows, ["doc_id", "a", "b", "ea", "eb"], cuts="array_intersect(ea, eb)")
    rows = _then(rows, ["doc_id", "a", "b"], n_groups="size(cuts)", s=f"sort_array(concat({ends}))")
    # the places of ends of one side only, with how many of such are before
    rows = _then(rows, ["doc_id", "a", "b", "n_groups", "s"], odd=f"transform(if(size(s) = 0, {none}, filter(sequence(0, size(s) - 1), k -> (s[k] & 3L) > 0)), (k, r) -> shiftleft(cast(k as bigint), 32) + r)")
    side = "filter(odd, x -> (s[cast(shiftright(x, 32) as int)] & 3L) = {tag})"
    rows = _then(rows, ["doc_id", "a", "b", "n_groups", "s"], oa=side.format(tag=1), ob=side.format(tag=2))
    # of the j-th such end: j of its own side are before it, and r - j of the other, so its token is number k - (r - j) of its side, within number k - j of the other
    place, within = "transform({o}, (x, j) -> cast(shiftright(x, 32) - (x & 4294967295L) + j as int))", "transform({o}, (x, j) -> coalesce(cast(shiftright(x, 32) as int) - j, 0))"
    count = "if(size({t}) = 0, {none}, sequence(0, size({t}) - 1))"
    found = {}
    for t, own, other in (("a", "oa", "ob"), ("b", "ob", "oa")):
        every = count.format(t=t, none=none)
        # the token of each end (tokens in which the other side ends come again), and the last token of each group
        found |= {f"i{t}": f"sort_array(concat({every}, {within.format(o=other)}))", f"g{t}": f"array_except({every}, {place.format(o=own)})", f"t{t}": f"cast({t} as array<string>)", f"l{t}": f"cast({t} as array<bigint>)"}
    rows = _then(rows, ["doc_id", "a", "b", "n_groups"], **found)
    # (coalesce: arrays that cannot hold nulls are sorted as plain numbers)
    link = "sort_array(transform(ia, (x, k) -> coalesce(shiftleft(la[x], 32) + lb[ib[k]], 0L)))"
    rows = _then(rows, ["doc_id", "a", "b", "n_groups", "ta", "tb", "ga", "gb"], l=link, fa="concat(array(-1), ga)", fb="concat(array(-1), gb)")
    part = "array_join(slice(t{t}, f{t}[g] + 2, g{t}[g] - f{t}[g]), ',')"
    one = "if(e = fa[g] + 1 and gb[g] = fb[g] + 1, concat(ta[e], '|', tb[gb[g]]), {many})".format(many=f"concat({part.format(t='a')}, '|', {part.format(t='b')})")
    rows = _then(rows, ["doc_id", "a", "b", "n_groups", "l"], groups=f"array_join(transform(ga, (e, g) -> {one}), ';')", runs=f"if(size(l) = 0, {none}, filter(sequence(0, size(l) - 1), i -> i = 0 or l[i] <> l[i - 1]))")
    links = "transform(runs, (p, i) -> named_struct('a', cast(shiftright(l[p], 32) as int), 'b', cast(l[p] & 4294967295L as int), 'n', coalesce(get(runs, i + 1), size(l)) - p))"
    return rows.selectExpr("doc_id", "cast(size(a) as bigint) as n_a", "cast(size(b) as bigint) as n_b", "cast(n_groups as bigint) as n_groups", "cast(size(l) as bigint) as n_links", "groups", f"{links} as links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold an id pair linked, and the highest such number of its A id."""
    pairs = links.selectExpr("inline(links)").groupBy("a", "b").agg(F.count("*").alias("count"))
    best = pairs.groupBy("a").agg(F.max("count").alias("best"))
    return pairs.join(best, "a")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    sha = "if(n_a = 0, '', sha2(groups, 256)) as groups_sha256"
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    aligned(docs, paths).selectExpr("monotonically_increasing_id() as row", *own[1:-1], sha, "links").write.parquet(place)
    rows = spark.read.parquet(place)
    pair_counts(rows.select("links")).write.parquet(f"{place}-pairs")
    pairs = spark.read.parquet(f"{place}-pairs")
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    found = rows.selectExpr(*own, "inline(links)").join(pairs, ["a", "b"])
    sums = found.groupBy(*own).agg(F.sum(F.expr("if(count = best, n, 0)")).alias("n_best"), F.sum(F.expr("n * count")).alias("count_sum"))
    none = rows.filter("n_links = 0").select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return sums.unionByName(none).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
