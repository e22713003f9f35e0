"""Column functions for prompts, badges, dates and small structures that a client shows or sends."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuskiln.functions import text as X

# The wording of prompts and labels.
PROMPT_HEAD = (
    "Na podstawie poniższych przepisów prawnych odpowiedz na pytanie. Cytuj źródła używając numerów w nawiasach kwadratowych, "
    "np. [1], [2], zgodnie z numeracją w sekcji PRZEPISY poniżej.\n\nPRZEPISY:\n"
)
PROMPT_TAIL = "\n\nODPOWIEDŹ (powołuj się na [numer] przy każdym twierdzeniu):"
REGULATIONS = "Podstawy prawne: "
QUERY_PREFIX = "[query]: "
MISSING_FIELD = "(nie podano)"


def prompt(question: Column, context: Column) -> Column:
    """The question with its numbered context; without context the question alone."""
    asked = F.concat(F.lit("PYTANIE: "), question)
    with_context = F.concat(F.lit(PROMPT_HEAD), context, F.lit("\n\n"), asked, F.lit(PROMPT_TAIL))
    return F.when(F.coalesce(context, F.lit("")) != "", with_context).otherwise(F.concat(asked, F.lit("\n\nODPOWIEDŹ:")))


def query_text(question: Column) -> Column:
    """What the encoder sees of a question (texts of the corpus get no prefix)."""
    return F.concat(F.lit(QUERY_PREFIX), question)


def embed_text(text: Column, context: Column) -> Column:
    """What the encoder sees of a chunk: its context, where there is one, before the text."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def context_message(title: Column, text: Column, most: int = 800) -> Column:
    """Request for a chunk's context: title, where there is one, and the first characters."""
    start = F.concat(F.lit("Fragment tekstu:\n"), F.substring(F.coalesce(text, F.lit("")), 1, most))
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Tytuł dokumentu: "), title, F.lit("\n\n"), start)).otherwise(start)


def source_header(title: Column, act: Column, year: Column, pos: Column) -> Column:
    """Header of the one source of a training record."""
    head = F.concat(F.lit("[1] "), F.coalesce(title, act), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("")), F.lit(")"))
    return F.when(F.coalesce(pos, F.lit("")) != "", F.concat(head, F.lit(" poz. "), pos)).otherwise(head)


def regulations_prefix(citations: Column, most: int = 10) -> Column:
    """The first citations that are not empty, as a line before a judgment's text; none: empty."""
    kept = F.slice(F.filter(citations, lambda c: c.isNotNull() & (c != "")), 1, most)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit(REGULATIONS), F.array_join(kept, "; "), F.lit("\n\n"))).otherwise("")


def score_percent(score: Column) -> Column:
    """A score as a percentage; what lies outside 0 to 1 is a logit."""
    return F.floor(F.when((score > 1) | (score < 0), X.sigmoid(score)).otherwise(score) * 100 + 0.5).cast("int")


def band(percent: Column, bounds: dict[str, int], rest: str) -> Column:
    """The first name whose bound the percentage reaches (bounds from high to low)."""
    out = F.lit(rest)
    for name, least in reversed(list(bounds.items())):
        out = F.when(percent >= least, F.lit(name)).otherwise(out)
    return out


def relative_time(ts: Column, now: Column) -> Column:
    """Age in words up to a day, then day and month."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, F.lit("przed chwilą"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min temu")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" godz. temu")))
        .otherwise(F.date_format(ts, "dd.MM"))
    )


def json_list_size(value: Column) -> Column:
    """Entries of a JSON list; what is none counts 0."""
    return F.coalesce(F.json_array_length(value), F.lit(0))


def salvage_pairs(answer: Column) -> Column:
    """Question and answer pairs of the JSON list in a model's answer, from its first to its last bracket; only entries that
    have both, and none where it cannot be parsed."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string>>")
    return F.filter(F.coalesce(found, F.array().cast("array<struct<question:string,answer:string>>")), lambda p: p["question"].isNotNull() & p["answer"].isNotNull())


def stream_frame(payload: Column) -> Column:
    """A server-sent event that carries JSON."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def stream_payloads(received: Column) -> Column:
    """Payloads of all event lines of a received text."""
    return F.transform(F.filter(F.split(received, "\n"), lambda line: line.startswith("data: ")), lambda line: F.substring(line, 7, 1 << 30))


def required_filled(fields: Column, values: Column) -> Column:
    """Is every required field (key, label, required) of a template filled with more than blanks?"""
    return F.forall(F.filter(fields, lambda f: f["required"]), lambda f: F.trim(F.coalesce(F.element_at(values, f["key"]), F.lit(""))) != "")


def filled_fields(fields: Column, values: Column) -> Column:
    """The template's fields with their values, one to a line."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["label"], F.lit(": "), F.coalesce(F.element_at(values, f["key"]), F.lit(MISSING_FIELD)))), "\n")


def first_success(*attempts: Column) -> Column:
    """The first of several providers that gave something; an error where none did."""
    return F.coalesce(*attempts, F.raise_error(F.lit("no provider gave an answer")).cast("string"))


def summary_stand_in(text: Column, most: int = 200) -> Column:
    """What stands for a summary where no model is at hand."""
    return F.trim(F.substring(F.coalesce(text, F.lit("")), 1, most))


def valid_request(question: Column, top_k: Column, shortest: int = 5, longest: int = 2000, most: int = 20) -> Column:
    return F.coalesce(F.length(question).between(shortest, longest) & top_k.between(1, most), F.lit(False))


@F.pandas_udf(StringType())
def rate_key(ip: pd.Series) -> pd.Series:
    """An address as the limiter counts it: an IPv6 address by its /64 network, anything else as it is."""

    def one(a: str | None) -> str | None:
        try:
            return str(ipaddress.ip_network(f"{a}/64", strict=False).network_address) if isinstance(ipaddress.ip_address(a), ipaddress.IPv6Address) else a
        except ValueError:
            return a

    return ip.map(one)


def token_hash(token: Column) -> Column:
    """What is stored of an access token."""
    return F.sha2(token, 256)


def filled_template(template: str, **fields: Column) -> Column:
    """``template`` with its ``{name}`` places filled; a null field is empty, braces inside a field's text stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)  # text, name, text, name, ..., text
    return F.concat(*(F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def joined_or(values: Column, default: str) -> Column:
    """The elements of an array in one text, or the default where there are none."""
    return F.coalesce(F.nullif(F.array_join(values, ", "), F.lit("")), F.lit(default))


# Publishers of judgments.
JUDGMENT_PUBLISHERS = ["ADMINISTRATIVE", "SUPREME", "CONSTITUTIONAL_TRIBUNAL", "COMMON", "NATIONAL_APPEAL_CHAMBER"]


def is_judgment(publisher: Column) -> Column:
    return F.coalesce(publisher, F.lit("WDU")).isin(*JUDGMENT_PUBLISHERS)


# Months as Polish dates write them.
MONTHS_PL = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]


def long_date_pl(ts: Column) -> Column:
    return F.concat_ws(" ", F.date_format(ts, "dd"), F.element_at(F.array(*(F.lit(m) for m in MONTHS_PL)), F.month(ts)), F.date_format(ts, "yyyy"))


def date_time_pl(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy, HH:mm")


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Items a second and the seconds that are left, 0 where either cannot be told."""
    rate = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return rate, F.when(rate > 0, (total - done) / rate).otherwise(0.0)


def model_cost(items: Column, tokens: int = 80, dollars_per_million: float = 0.15) -> Column:
    return items * (tokens * dollars_per_million / 1_000_000)
