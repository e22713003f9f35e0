from pyspark.sql import functions as F

from corpuskiln.functions import display as D


def test_small_functions(spark):
    df = spark.createDataFrame([(1, "{output} x", None, ["a", "b"], "COMMON", 50.0), (2, "i", "in", [], None, 0.0)], "id int, instruction string, input string, authors array<string>, publisher string, s double")
    rate, left = D.progress(F.lit(100), F.lit(150), F.col("s"))
    rows = df.select(
        D.filled_template("### {instruction}\n{input}|{output}", instruction=F.col("instruction"), input=F.col("input"), output=F.lit("o")).alias("prompt"),
        D.joined_or(F.col("authors"), "KIS").alias("publisher"), D.is_judgment(F.col("publisher")).alias("judgment"), rate.alias("rate"), left.alias("left"), F.round(D.model_cost(F.lit(100_000)), 2).alias("cost"),
    ).orderBy(df.id).collect()
    assert [tuple(r) for r in rows] == [("### {output} x\n|o", "a, b", True, 2.0, 25.0, 1.2), ("### i\nin|o", "KIS", False, 0.0, 0.0, 1.2)]
