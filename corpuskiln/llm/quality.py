"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the measurements and one long of failure bits. A policy
is a named, versioned mask of enforced bits, so verdicts, comparisons of policies and ablations (what only rule r
rejects) are bitwise work on the ledger and never read a text again.

Words are ``[^\\x20\\x09-\\x0D]+``. Cases: a null or empty text has no words and fails ``few_words``; long texts are
measured whole; repeated rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, documents, records

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = True
_ALPHA[97:123] = True
_ALPHA[0xC0:] = True  # a lead byte of a non-ASCII character counts as one letter
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord("!"), ord("?")]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

#: Bit of each rule in the ledger, its name, and the condition of failure over the measurements.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 3 * word_chars"),
    ("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("few_letters", "100 * n_alpha < 60 * word_chars"),
    ("shouting", "n_upper * 2 > n_alpha"),
    ("exclaiming", "n_marks * 2 > n_words"),
    ("long_words", "word_chars > 14 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the bits a policy enforces.
POLICIES = {
    "base-1": BASE,
    "clean-1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["few_letters"],
    "clean-2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["few_letters"] | BIT["shouting"] | BIT["exclaiming"] | BIT["long_words"],
}
DEFAULT_POLICY = "clean-2"

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_upper", "n_marks"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in _MEASURES)])


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does an equal one exist at all, and does one come before it."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), dtype=bool)
    same[1:] = s[1:] == s[:-1]
    later = np.empty(len(s), dtype=bool)
    later[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    some = np.empty(len(s), dtype=bool)
    some[order] = any_
    return some, later


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the documents of a slice."""
    docs = len(off) - 1
    w = T.find_words(data, off)
    count = np.diff(w.first)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    out = {"n_words": count, "word_chars": per_doc(_HEAD[data] & ~T._IS_SPACE[data]), "n_symbols": per_doc(_SYMBOL[data])}
    out |= {"n_alpha": per_doc(_ALPHA[data]), "n_upper": per_doc(_UPPER[data]), "n_marks": per_doc(_MARK[data])}
    # lines: cut at \n and at document borders; only lines with a word count
    cut = np.union1d(np.flatnonzero(data == 0x0A) + 1, off[:-1])
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    stop = stop - ((stop > cut) & (data[stop - 1] == 0x0A)) if len(cut) else stop
    has_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, cut)
    cut, stop = cut[has_word], stop[has_word]
    line_doc = np.searchsorted(off, cut, side="right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    salt = T.mix64(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    _, later = _repeats(T.mix64(T.range_hashes(data, cut, stop) + salt[line_doc]))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=docs)
    # windows of eight words found twice or more in their document; their words count once each
    out["n_repeat_words"] = np.zeros(docs, dtype=np.int64)
    h = T.window_hashes(T.range_hashes(data, w.start, w.end), WINDOW)
    if len(h):
        doc = w.doc
        inside = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
        some, _ = _repeats(T.mix64(h[inside] + salt[doc[inside]]))
        mark = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(mark, inside[some], 1)
        np.add.at(mark, inside[some] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(mark)[:-1] > 0], minlength=docs)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.flat(b.column(1))
            got = [measure(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in T.slices(off)]
            yield batch(_SCHEMA, doc_id=b.column(0), **{m: np.concatenate([g[m] for g in got]).astype(np.int64) if got else [] for m in _MEASURES})

    rows = records(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))
    bits = [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return rows.withColumn("fail_bits", mask.cast("long"))


def verdicts(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; base rules bind under every policy."""
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0)


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per enforced rule of a policy: documents that fail it, and documents that fail nothing else.

    One aggregation over the ledger; its result has as many rows as there are rules."""
    enforced = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    sums = [x for name, bit in BIT.items() if bit & POLICIES[policy] for x in (F.count_if(enforced.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}"), F.count_if(enforced == bit).alias(f"o_{name}"))]
    names = [name for name, bit in BIT.items() if bit & POLICIES[policy]]
    stack = ", ".join(f"'{n}', f_{n}, o_{n}" for n in names)
    return rows.agg(*sums).selectExpr(f"stack({len(names)}, {stack}) as (rule, n_failed, n_only)")


def compare(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Documents by the sets of enforced bits in which two policies differ, with the verdict under each."""
    a, b = POLICIES[old], POLICIES[new]
    return rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(a ^ b)).alias("differing_bits"), (F.col("fail_bits").bitwiseAND(F.lit(a)) == 0).alias("kept_old"), (F.col("fail_bits").bitwiseAND(F.lit(b)) == 0).alias("kept_new")).agg(F.count("*").alias("n_docs"))


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(ledger(documents(spark, sf_dir))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_alpha", "n_upper", "n_marks")
