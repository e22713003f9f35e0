"""Language identification by string kernels.

A text is the set of the byte n-grams (n = 1..4, ASCII letters lowered, other ASCII as blanks) it holds, hashed to
``DIM`` presence features; the blended-spectrum presence kernel is the normalised size of the intersection of two sets.
Landmark texts (Nystroem) span the feature space, one-versus-rest kernel ridge regression gives one weight vector for
each language, and whole texts are scored by two matrix products for each slice of a batch.

Every labelled language is learned. Fitting reads a bounded sample: at most ``per_lang`` labelled texts of each language and
``rows`` of all, shared out evenly where there are many languages (at least one text and one landmark of each), chosen by
the smallest hash of the id. Everything else runs on all rows.

Cases: null text, or text without any letter: ``und`` with score 0; no labelled row at all: ``und`` for all; long texts
are read whole; repeated rows are scored alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, crc_mod, documents, records, stored

DIM = 1 << 13
ORDERS = (1, 2, 3, 4)
PER_LANG = 400
ROWS = 25_600  # of all languages
LANDMARKS = 32  # of each language
ALL_LANDMARKS = 2048  # of all languages
STRIP = 512
RIDGE = 1e-3
UND = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Presence of every hashed n-gram in every document of a slice (documents x DIM, boolean)."""
    docs = len(off) - 1
    out = np.zeros(docs * DIM, dtype=bool)
    if len(data):
        doc = np.repeat(np.arange(docs, dtype=np.uint32), np.diff(off))
        row = doc * np.uint32(DIM)
        b = _FOLD[data].astype(np.uint32)
        gram = b
        for n in ORDERS:
            if n > 1:
                gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            if not len(gram):
                break
            h = (gram + np.uint32(n) * np.uint32(0x3C6EF372)) * np.uint32(0x9E3779B1)
            at = row[: len(gram)] + (h >> np.uint32(19))
            out[at[doc[: len(gram)] == doc[n - 1 :]] if n > 1 else at] = True
    return out.reshape(docs, DIM)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised intersection sizes of presence rows."""
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    return (fa @ fb.T) / np.sqrt(np.outer(np.maximum(fa.sum(1), 1), np.maximum(fb.sum(1), 1)))


def has_letter(data: np.ndarray, off: np.ndarray, texts) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[data], out=total[1:])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):  # perhaps letters beyond ASCII
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


class Model:
    """Languages, presence rows of the landmarks, and the ridge weights (landmarks x languages)."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([kernel(rows[k : k + STRIP], self.landmarks) @ self.weights for k in range(0, len(rows), STRIP)])


def fit(docs: DataFrame, per_lang: int = PER_LANG, rows: int = ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on the bounded sample of ``docs`` (doc_id, text, lang); None where nothing is labelled."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = counts.count()
    if not n_langs:
        return None
    few = n_langs <= rows
    per_lang, landmarks = max(1, min(per_lang, rows // n_langs)), max(1, min(landmarks, ALL_LANDMARKS // n_langs))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a language's smallest hashes lie below this bound, so that only a few rows of each language go on
    near = known.select("doc_id", "lang", place.alias("place")).join(F.broadcast(counts) if few else counts, "lang")
    near = near.filter(F.col("place") < F.lit(float((8 * per_lang + 64) << 30)) / F.col("n")).select("lang", "place", "doc_id").distinct()
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("r") <= per_lang).select("doc_id", "lang")
    sample = known.join(F.broadcast(picked) if few else picked, ["doc_id", "lang"], "left_semi")  # at most per_lang * n_langs pairs
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one text of an id that repeats
    folded = sorted(_presence_rows(sample).collect(), key=lambda r: (r["lang"], r["doc_id"]))
    if not folded:
        return None
    x = np.unpackbits(np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in folded]), axis=1)[:, :DIM].astype(bool)
    langs, lang = np.unique(np.array([r["lang"] for r in folded]), return_inverse=True)
    mark = np.concatenate([np.flatnonzero(lang == g)[:landmarks] for g in range(len(langs))])
    marks, share = x[mark], 1.0 / np.bincount(lang)[lang]  # languages count alike
    left, right = np.zeros((len(mark), len(mark))), np.zeros((len(mark), len(langs)))
    for k in range(0, len(x), STRIP):
        near_marks = kernel(x[k : k + STRIP], marks).astype(np.float64)
        shared = (near_marks * share[k : k + STRIP, None]).T
        left += shared @ near_marks
        right += shared @ np.where(lang[k : k + STRIP, None] == np.arange(len(langs)), 1.0, -1.0)
    left += ridge * len(langs) * kernel(marks, marks) + 1e-8 * np.eye(len(mark))
    return Model(langs.tolist(), marks, np.linalg.solve(left, right).astype(np.float32))


def _presence_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.flat(b.column(1))
            for lo, hi in T.slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                good = np.flatnonzero(has_letter(part, o, b.column(1).slice(lo, hi - lo)))
                bits = np.packbits(presence(part, o), axis=1)
                yield batch(schema, doc_id=b.column(0).take(pa.array(good + lo)), lang=b.column(2).take(pa.array(good + lo)), bits=[bits[i].tobytes() for i in good])

    return records(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, bits binary")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; the score is the winning ridge output mapped to 0..1."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_LANDMARKS rows of DIM flags, or one of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = T.flat(b.column(1))
            for lo, hi in T.slices(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                pred, score = np.full(hi - lo, UND, dtype=object), np.zeros(hi - lo)
                good = has_letter(part, o, b.column(1).slice(lo, hi - lo)) if m else np.zeros(hi - lo, dtype=bool)
                if good.any():
                    s = m.scores(presence(part, o))
                    best = s.argmax(1)
                    pred[good] = np.array(m.langs, dtype=object)[best[good]]
                    score[good] = np.clip((s[np.arange(len(s)), best][good] + 1) / 2, 0, 1)
                yield batch(schema, doc_id=b.column(0).slice(lo, hi - lo), lang_pred=pa.array(pred.tolist(), pa.string()), score=score)

    return records(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(crc_mod("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
