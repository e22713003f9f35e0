"""Sources: JSON lines and crawled records as one table of raw documents. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "id string, title string, year string, publisher string, pos string, url string, raw_text string, status string"
JUDGMENTS = (
    "id string, saos_id string, court_type string, case_number string, judgment_date string, judgment_type string, judges array<string>, text_html string, "
    "referenced_regulations array<struct<title:string,year:string,journal_no:string,entry:string,citation:string>>, keywords array<string>, source_url string"
)
COURT_ITEM = (
    "id long, courtType string, courtCases array<struct<caseNumber:string>>, judgmentDate string, judgmentType string, judges array<struct<name:string>>, textContent string, "
    "referencedRegulations array<struct<journalTitle:string,journalYear:string,journalNo:string,journalEntry:string,text:string>>, keywords array<string>"
)


def json_lines(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines; blank lines go, malformed ones go too or are kept as ``_corrupt`` with nulls."""
    if keep_bad:
        return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def judgments(items: DataFrame) -> DataFrame:
    """Court API items as judgment records: first case number, names of judges, cited regulations."""
    first = F.coalesce(F.get(F.transform("courtCases", lambda c: c["caseNumber"]), F.lit(0)), F.lit(""))
    rules = F.transform("referencedRegulations", lambda r: F.struct(F.coalesce(r["journalTitle"], F.lit("")).alias("title"), r["journalYear"].alias("year"), r["journalNo"].alias("journal_no"), r["journalEntry"].alias("entry"), F.coalesce(r["text"], F.lit("")).alias("citation")))
    return items.select(
        F.concat(F.lit("saos_"), F.col("id").cast("string")).alias("id"), F.col("id").cast("string").alias("saos_id"), F.col("courtType").alias("court_type"), first.alias("case_number"), F.col("judgmentDate").alias("judgment_date"),
        F.col("judgmentType").alias("judgment_type"), F.transform("judges", lambda j: j["name"]).alias("judges"), F.col("textContent").alias("text_html"), rules.alias("referenced_regulations"), F.coalesce("keywords", F.array()).alias("keywords"),
        F.lit(None).cast("string").alias("source_url"),
    ).filter(F.length(F.trim(F.coalesce("text_html", F.lit("")))) > 0)


def bindings(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """SPARQL JSON bindings to columns: missing values are empty, dates keep ten characters, rows without id go."""
    schema = "struct<" + ",".join(f"{n}:struct<value:string>" for n in names) + ">"
    b = rows.select(F.from_json(column, schema).alias("b"))
    cut = lambda n, c: F.substring(c, 1, 10) if n == "date" else c
    return b.select(*(cut(n, F.coalesce(F.col(f"b.{n}.value"), F.lit(""))).alias(n) for n in names)).filter(F.col(names[0]) != "")


def acts_in_range(works: DataFrame, titles: DataFrame, kind: str, first: str, last: str, lang: str = "pl") -> DataFrame:
    """Works of a date range with the title of a language where there is one, newest first."""
    named = works.join(titles.filter(F.col("lang") == lang).select("work", "title"), "work", "left").filter(F.col("date").between(first, last))
    return named.withColumn("type", F.lit(kind)).distinct().orderBy(F.desc("date"), "work")


def with_language_fallback(acts: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Polish text, else English, else empty."""
    per = texts.groupBy(key).agg(F.max(F.when(F.col("lang") == "pl", F.col("text"))).alias("_pl"), F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("_en"))
    return acts.join(per, key, "left").withColumn("raw_text", F.coalesce("_pl", "_en", F.lit(""))).drop("_pl", "_en")


def title_with_fallback(df: DataFrame, title: str, html: str) -> DataFrame:
    """The title, else the page's first heading, else its <title> up to the site's name."""
    heading = F.regexp_extract(html, r'(?is)<(?:p[^>]*class="[^"]*doc-ti[^"]*"|h1)[^>]*>(.*?)</(?:p|h1)>', 1)
    page = F.split_part(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit(" - EUR-Lex"), F.lit(1))
    some = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"<[^>]+>", "")), F.lit(""))
    return df.withColumn(title, F.coalesce(some(F.col(title)), some(heading), some(page), F.lit("")))


TAXES = {"VAT": ["vat", "towarów i usług"], "PIT": ["pit", "osób fizycznych"], "CIT": ["cit", "osób prawnych"], "Akcyza": ["akcyz"], "Cło": ["cło", "celn"]}  # Fixed values: topics and the words that tell them.


def tax_types(topics):
    """Sorted distinct tax kinds of a list of topics; a topic counts for the first kind that its words tell."""

    def kind(topic):
        out = F.lit(None).cast("string")
        for name, words in reversed(TAXES.items()):
            told = F.lit(False)
            for w in words:
                told = told | F.contains(F.lower(topic), F.lit(w))
            out = F.when(told, name).otherwise(out)
        return out

    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(topics, kind), lambda k: k.isNotNull()))), ", ")


def tax_rulings(items: DataFrame) -> DataFrame:
    """Tax rulings (id, signature, date, topics, text): year from the date, title fallback, texts under 50 characters go."""
    year = F.coalesce(F.year(F.to_date(F.substring("date", 1, 10))).cast("string"), F.substring("date", 1, 4), F.lit(""))
    return items.select(F.concat(F.lit("kis_"), "id").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Interpretacja "), "signature")).alias("title"), year.alias("year"), F.lit("KIS").alias("publisher"), F.col("signature").alias("pos"), tax_types(F.col("topics")).alias("tax_type"), F.trim("text").alias("raw_text")).filter(F.length("raw_text") >= 50)


COURTS = {  # Fixed values: labels of the types of courts.
    "SUPREME": "Sąd Najwyższy",
    "ADMINISTRATIVE": "Sąd Administracyjny (NSA/WSA)",
    "CONSTITUTIONAL_TRIBUNAL": "Trybunał Konstytucyjny",
    "COMMON": "Sąd Powszechny",
    "NATIONAL_APPEAL_CHAMBER": "Krajowa Izba Odwoławcza",
}


def judgment_columns() -> dict[str, Column]:
    """What a judgment has in the columns of RAW: the court's label, case and date as its title; missing values are empty."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    labels = F.create_map(*(F.lit(x) for pair in COURTS.items() for x in pair))
    label = F.coalesce(F.element_at(labels, F.col("court_type")), some("court_type"))
    return {
        "id": F.coalesce("id", F.concat(F.lit("saos_"), some("saos_id"))),
        "title": F.concat_ws(" | ", label, some("case_number"), some("judgment_date")),
        "year": F.substring(some("judgment_date"), 1, 4),
        "publisher": some("court_type"),
        "pos": some("case_number"),
        "url": some("source_url"),
    }


def act_columns() -> dict[str, Column]:
    """What an act has in the columns of RAW: missing values are empty, but for the publisher."""
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "title", "year", "pos", "url", "status")}
    return {**out, "publisher": F.coalesce("publisher", F.lit("WDU"))}


def canonical(*sources: DataFrame) -> DataFrame:
    """Records of all sources in the columns of RAW; missing columns are null."""
    names = [c.split()[0] for c in RAW.split(", ")]
    out = None
    for s in sources:
        if "text_html" in s.columns:
            s = s.select(*(c.alias(n) for n, c in judgment_columns().items()), F.col("text_html").alias("raw_text"))
        s = s.select(*[F.col(c).cast("string").alias(c) for c in names if c in s.columns])
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in names))


def is_judgment(saos_id: Column, court_type: Column) -> Column:
    """Is a record a judgment, by a court id or type? Any other is an act."""
    return saos_id.isNotNull() | court_type.isNotNull()


def counts_by_file(df: DataFrame, name: str) -> DataFrame:
    """Records of each file; ``name`` is the pattern of a file's name in its path, so parts of one table count together."""
    return df.groupBy(F.regexp_extract(F.input_file_name(), name, 1).alias("file")).agg(F.count("*").alias("n"))


def judgment_parts(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """A judgment's sections (thesis, ruling, preamble, justification) in order, each behind the prefix; short ones other than
    the justification go, and where none is left the ``full`` text stands for all."""
    least = 50
    joined = lambda c: F.trim(F.concat(prefix, F.trim(F.coalesce(F.col(c), F.lit("")))))
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    part = lambda c: F.struct(F.lit(c).alias("section"), joined(c).alias("text"))
    short = [F.when(filled(c) & (F.length(joined(c)) >= least), part(c)) for c in ("thesis", "ruling", "preamble")]
    some = F.array_compact(F.array(*short, F.when(filled("justification"), part("justification"))))
    kept = F.when(F.size(some) > 0, some).otherwise(F.array(part("full")))
    return df.select(key, F.posexplode(kept).alias("place", "p")).select(key, "place", "p.section", "p.text")
