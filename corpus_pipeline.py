"""The corpus pipeline: five stages over ``documents``, each on all rows that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes a stage's rows as Parquet to the shared folder
and reads them again as the next stage's documents. All but the last return the columns of ``documents`` (others that a
table may carry stay too). Columns are joined on ``doc_id``; a null ``doc_id`` leaves with the first stage, as do texts
that are null or have no letters, and texts whose language is not told with a score of ``MIN_SCORE``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import jaccard, langid, packing, pii, suffixes
from corpuskiln.llm.common import crc_mod, documents, stored

MIN_SCORE = 0.3


def _beside(docs: DataFrame, found: DataFrame, **names: str) -> tuple[DataFrame, dict[str, str]]:
    """``found`` with its columns renamed so that none clashes with a column of ``docs``, and the new names."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for key, column in names.items():
        name = f"stage_{key}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out[key] = name
    return found.select(*(F.col(names[k]).alias(v) for k, v in out.items())), out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised."""
    model = langid.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    told = langid.predict(docs, model).filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE)).select("doc_id").distinct()
    told, name = _beside(docs, told, id="doc_id")
    return docs.join(told, F.col("doc_id") == F.col(name["id"]), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component of near duplicates; of equal ids one row."""
    found = jaccard.jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    found, name = _beside(docs, found, id="doc_id")
    return docs.join(found, F.col("doc_id") == F.col(name["id"]), "left_semi").dropDuplicates(["doc_id"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every byte of a 50-byte string that also starts in a document with a smaller id.

    Where a cut goes through a character, its remaining bytes go as well. A text of which no word is left is dropped."""
    cut, name = _beside(docs, suffixes.remove_repeats(docs, texts=True), id="doc_id", gone="n_removed", kept="kept")
    rows = docs.join(cut, F.col("doc_id") == F.col(name["id"]))
    whole = F.col(name["gone"]) == 0
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.col(name["kept"]))).filter(whole | F.col("text").rlike(r"[^ \x09-\x0D]"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by the names of their kinds."""
    clean, name = _beside(docs, pii.find_personal_data(docs, redacted=True), id="doc_id", spans="spans", text="redacted")
    rows = docs.join(clean, F.col("doc_id") == F.col(name["id"])).withColumn("text", F.when(F.col(name["spans"]) == "", F.col("text")).otherwise(F.col(name["text"])))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("pack", pack),
]

ORACLE_SQL = None  # no SQL for kernels, random fields and packing; tests/llm holds the brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stored(spark.range(1).select("id"))  # makes sure that the shared folder is set
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    place = f"{base}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
