"""Context prefixes of chunks: an enrichment that resumes by key, marks failures and can run on a batch or on a stream's batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators.state import unseen

SENTENCES = 2


def context_prefixes(chunks: DataFrame, done: DataFrame | None, generate: Callable[[str, str], str], sentences: int = SENTENCES) -> DataFrame:
    """(key columns kept) prefix and failed of all chunks (point_id, title, text) that ``done`` (point_id, failed) does not hold.

    ``generate`` takes title and text to a prefix, of which the first ``sentences`` sentences stay. Where it fails, or gives nothing, the
    prefix is empty and ``failed`` true; failed chunks are taken again by the next run."""

    @F.pandas_udf("string")
    def run(title: pd.Series, text: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str | None:
            try:
                return generate(a or "", b or "")
            except Exception:  # a model's failure must not stop the others
                return None

        return pd.Series([one(a, b) for a, b in zip(title, text, strict=True)], dtype=object)

    todo = chunks if done is None else unseen(chunks, done.filter("not failed"), ["point_id"])
    made = todo.select("point_id", F.trim(run("title", "text")).alias("_p"))
    cut = F.regexp_extract("_p", rf"^(?s)((?:.*?[.!?](?=\s|$)\s*){{1,{sentences}}}|.*)", 1)
    prefix = F.coalesce(F.trim(cut), F.lit(""))
    return made.select("point_id", prefix.alias("prefix"), (prefix == "").alias("failed"))


def with_prefix(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Texts as they are embedded: the prefix, a blank line and the text; without a prefix the text alone."""
    rows = chunks.join(prefixes.filter("not failed").select("point_id", "prefix"), "point_id", "left")
    return rows.withColumn("embed_text", F.concat_ws("\n\n", "prefix", "text")).drop("prefix")
