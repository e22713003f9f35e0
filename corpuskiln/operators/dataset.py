"""Chat training data and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_turns(turns: DataFrame, n: int, longest: int = 2000, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last ``n`` turns of each conversation, then only the wanted roles, contents cut."""
    last = turns.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_r") <= n)
    return last.filter(F.col("role").isin(*roles)).select("conv_id", "turn", "role", F.substring("text", 1, longest).alias("content"))


def _messages() -> Column:
    return F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))


def chat_prompts(turns: DataFrame) -> DataFrame:
    """Plain rendering of conversations, one text each (turns of one conversation are few)."""
    text = F.array_join(F.transform(_messages(), lambda m: F.concat(F.lit("### "), m["role"], F.lit("\n"), m["content"])), "\n\n")
    return turns.groupBy("conv_id").agg(text.alias("prompt"), F.count("*").alias("n_turns"))


def chat_records(turns: DataFrame) -> DataFrame:
    """JSON lines with messages and metadata."""
    m = turns.groupBy("conv_id").agg(F.transform(_messages(), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return m.select("conv_id", F.to_json(F.struct("messages", F.struct("conv_id", F.size("messages").alias("n")).alias("metadata"))).alias("line"))


def exact_split(df: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Splits of exactly int(n * share) rows in a seeded hash order; the last split takes the rest.

    Ranks come from counts of hash prefixes, so that no task sorts the whole table."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 3))  # 4096 ranges of the hash order
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))).join(F.broadcast(before), "_p").withColumn("_r", F.col("_r") + F.col("_before"))
    out, edge = None, F.lit(0)
    names = list(shares)
    for name in names[:-1]:
        edge = edge + F.floor(F.col("_n") * shares[name])
        out = F.when(F.col("_r") <= edge, name) if out is None else out.when(F.col("_r") <= edge, name)
    return ranked.select(*df.columns, out.otherwise(names[-1]).alias("split"))


def resolve_citations(answers: DataFrame, sources: DataFrame, key: str, text: str, column: str) -> DataFrame:
    """One row for each ``[n]`` of an answer with the n-th source; null where there is none."""
    n = F.explode(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))).alias("n")
    return answers.select(*answers.columns, n).join(sources, key).withColumn("source", F.get(column, F.col("n") - 1))


def win_loss(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return df.agg(F.count_if(x > y).alias("wins"), F.count_if(x < y).alias("losses"), F.count_if(x == y).alias("ties"), F.round(F.avg(a), 4).alias("avg_a"), F.round(F.avg(b), 4).alias("avg_b"))


def hit_rate(text: Column, wanted: Column) -> Column:
    """Share of the wanted strings that the text holds, ignoring case."""
    return F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))) / F.greatest(F.size(wanted), F.lit(1))


def local_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """A deterministic question and answer of each text, where no generator is plugged in."""
    return df.select(key, F.concat(F.lit("Co wynika z: "), F.substring(text, 1, 60), F.lit("?")).alias("question"), F.substring(text, 1, 200).alias("answer"))
