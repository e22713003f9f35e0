"""Text columns: cleaning, identifiers, citations, routing. All are Column -> Column; only NFC and entities need Python."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Boilerplate of the legal gazettes, removed in this order.
BOILERPLATE = [
    r"(?iU)Dziennik Ustaw\s+–\s+\d+\s+–\s+Poz\.\s+\d+",
    r"(?iU)Monitor Polski\s+–\s+\d+\s+–\s+Poz\.\s+\d+",
    r"(?iU)DZIENNIK USTAW RZECZYPOSPOLITEJ POLSKIEJ",
    r"(?iU)Warszawa,\s+dnia\s+\d+\s+\w+\s+\d{4}\s+r\.",
    r"(?iU)©\s*Kancelaria\s+Sejmu",
    r"(?iU)Opracowano\s+na\s+podstawie.*?(?=\n|$)",
    r"-\s*\d+\s*-",
    r"_{5,}",
    r"\f",
]

# Publisher codes and the source types they stand for.
SOURCE_TYPES = {
    "WDU": "legislation",
    "WMP": "legislation",
    "DU": "legislation",
    "MP": "legislation",
    "ADMINISTRATIVE": "judgment_nsa",
    "SUPREME": "judgment_sn",
    "CONSTITUTIONAL_TRIBUNAL": "judgment_tk",
    "COMMON": "judgment_common",
    "NATIONAL_APPEAL_CHAMBER": "judgment_kio",
    "KIS": "tax_interpretation",
    "EURLEX": "eu_regulation",
}

# Statuses of acts that are no longer in force.
REPEALED = ("uchylony", "nieobowiązujący")

# The keyword stems that tell a question's topic; \w+ and \w* stand for inflected endings.
TOPIC_WORDS = {
    "legislation": [
        r"ustaw\w+", r"rozporządzen\w+", r"przepis\w*", r"artykuł\w*", r"art\.", r"paragraf\w*", "§", r"kodeks\w*", r"dyrektywa\w*", "dyrektywie",
        "obowiązek", r"obowiązk\w+", r"uprawni\w+", r"definicj\w+", "wymóg", "wymogu", "wymogi", "wymogów", "warunek", "warunki", "warunków", "warunkiem",
        r"termin\w*", r"kara\w*", "kary", "karze", "karą", r"sankcj\w+", "ile dni", "ile lat", "jaki jest", "co oznacza", "co to jest",
    ],
    "judgment": [
        r"wyrok\w*", r"orzeczen\w+", r"orzecznictw\w+", r"sąd\w*", r"spraw\w+", "pozew", "pozwu", "pozwie", "pozwy", r"apelacj\w+", r"kasacj\w+", r"skarg\w+",
        r"precedens\w*", "linia orzecznicza", "linii orzeczniczej", "NSA", "SN", "TK", "WSA", "KIO", "jak orzekają", "praktyka", "czy sąd", "czy można zaskarżyć",
    ],
    "tax": [
        r"interpretacj\w+", "KIS", "podatek", "podatku", "podatki", "podatków", "podatkiem", r"podatk\w+", "VAT", "PIT", "CIT", r"akcyz\w+", "urząd skarbowy",
        "urzędu skarbowego", "MF", "ministerstwo finansów", r"ministr\w+ finansów", r"organ\w* podatkow\w+", r"deklaracj\w+ podatkow\w+",
        r"rozliczen\w+ podatkow\w+", r"ulg\w+ podatkow\w+", r"zwolni\w+ z VAT", "zwolnienie z VAT", "stawka VAT", "stawki VAT", r"faktur\w+", "korekta faktury", r"korekt\w+ faktur\w+",
    ],
}

# Phrases of trivial and of complex questions.
TRIVIAL_ANYWHERE = ["co to jest", "co oznacza", "definicja", "czym jest"]
TRIVIAL_START = ["co to jest", "co oznacza", "definicja", "definicję", "czym jest", "kim jest", "co to"]
COMPLEX = [
    "jak .{3,25} wpływa", "wpływ .{3,20} na", "porównaj", "porównanie", "różnica między", "różnice między", "zależność między", "w związku z", "w kontekście",
    "zarówno .{3,20} jak", "na tle", "jaka jest relacja", "jak .{3,20} odnosi się", "łącznie", "kumulatywnie", "jednocześnie",
]
ACT_WORDS = ["ustaw[aą]", r"kodeks\w*", r"rozporządzen\w+"]

# Fixed value: the DNS name space of version 5 UUIDs (RFC 4122).
UUID_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def any_word(words: list[str]) -> str:
    """Pattern of whole words, ignoring case in any script."""
    return r"(?iU)\b(?:" + "|".join(words) + r")\b"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def strip_markup(text: Column) -> Column:
    """Text nodes on lines of their own, only where the trimmed text begins with ``<``."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", "\n"), r"\s*\n\s*", "\n")
    return F.when(F.trim(text).startswith("<"), F.trim(plain, F.lit(" \n\r\t"))).otherwise(text)


def remove_boilerplate(text: Column) -> Column:
    for p in BOILERPLATE:
        text = F.regexp_replace(text, p, "")
    return text


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(nfc(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏⁠﻿]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n\r\t"))


def clean_text(text: Column) -> Column:
    return normalize_whitespace(remove_boilerplate(strip_markup(text)))


def html_to_lines(raw: Column) -> Column:
    """Readable text of a page: scripts dropped, breaks, paragraphs and list items on lines."""
    x = F.regexp_replace(unescape(raw), r"(?is)<(style|script)[^>]*>.*?</\1>", "")
    for pattern, by in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)<li[^>]*>", "\n- "), (r"<[^>]+>", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x, F.lit(" \n\r\t"))


def html_to_words(raw: Column) -> Column:
    """Tags to blanks, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", " "), r"\s+", " "))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lower(F.trim(parts[0])), *parts[1:]))


def uuid5(name: Column) -> Column:
    """Version 5 UUID in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(act: Column, chunk: Column) -> Column:
    return uuid5(F.concat(act, F.lit("__chunk"), chunk.cast("string")))


def source_type(publisher: Column, act: Column, default: str = "legislation") -> Column:
    """Source type of a publisher; tax rulings are known by their id, as authors stand in for their publisher."""
    table = F.create_map(*(F.lit(x) for pair in SOURCE_TYPES.items() for x in pair))
    return F.when(act.startswith("kis_"), F.lit("tax_interpretation")).otherwise(F.coalesce(F.element_at(table, publisher), F.lit(default)))


def is_repealed(status: Column) -> Column:
    return F.trim(F.lower(F.coalesce(status, F.lit("")))).isin(*REPEALED)


def year_of(value: Column) -> Column:
    """Year as a number; 0 where there is none."""
    return F.coalesce(F.substring(value.cast("string"), 1, 4).try_cast("int"), F.lit(0))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def citation(title: Column, year: Column, pos: Column, url: Column, act: Column) -> Column:
    """Title (year) poz. n <url>, leaving out what is empty; the act's id where everything is."""
    some = lambda c, out: F.when(F.coalesce(c, F.lit("")) != "", out)
    line = F.concat_ws(" ", some(title, title), some(year, F.concat(F.lit("("), year, F.lit(")"))), some(pos, F.concat(F.lit("poz. "), pos)), some(url, F.concat(F.lit("<"), url, F.lit(">"))))
    return F.when(line == "", F.concat(F.lit("act_id="), act)).otherwise(line)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring(title, 1, 40), r"[^0-9A-Za-zĄąĆćĘęŁłŃńÓóŚśŹźŻż ]", ""), " +", "_")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9._-]", "_")


def normalise_eli(code: Column) -> Column:
    """WDU20040540535 -> WDU/2004/54/535; anything else stays."""
    p = r"^([A-Z]+)(\d{4})(\d{3})(\d{4})$"
    part = lambda i: F.regexp_extract(code, p, i)
    return F.when(code.rlike(p), F.concat_ws("/", part(1), part(2), part(3).cast("int").cast("string"), part(4).cast("int").cast("string"))).otherwise(code)


def external_link(eli: Column, fallback: Column) -> Column:
    """Search link of an act, with its position padded to seven digits."""
    p = r"^([A-Z]+)/(\d{4})/(?:\d+/)?(\d+)$"
    return F.when(eli.rlike(p), F.concat(F.lit("https://isap.sejm.gov.pl/isap.nsf/DocDetails.xsp?id="), F.regexp_extract(eli, p, 1), F.regexp_extract(eli, p, 2), F.lpad(F.regexp_extract(eli, p, 3), 7, "0"))).otherwise(F.concat(F.lit("https://isap.sejm.gov.pl/isap.nsf/search.xsp?q="), F.url_encode(fallback)))


def article_excerpt(text: Column, number: Column, longest: int = 2000) -> Column:
    """From the header of an article to the next header, at most ``longest`` characters."""
    start = F.regexp_instr(text, F.concat(F.lit(r"(?m)^\s*(Art\.|§)\s*"), number, F.lit(r"\b")))
    rest = F.substring(text, start, F.lit(longest))
    stop = F.regexp_instr(F.substring(rest, F.lit(2), F.lit(longest)), F.lit(r"(?m)^\s*(Art\.|§)\s*\d+"))
    return F.when(start > 0, F.when(stop > 0, F.substring(rest, F.lit(1), stop)).otherwise(rest)).otherwise(F.lit(""))


def renumber_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[(\d+)\]", "(źródło $1)")


def highlight(text: Column, needle: str) -> Column:
    import re

    return F.regexp_replace(text, f"(?iU)({re.escape(needle)})", "<mark>$1</mark>")


def strip_list_marker(line: Column) -> Column:
    return F.regexp_replace(line, r"^[0-9.\-) ]+", "")


def topic(question: Column, words: dict[str, list[str]] = TOPIC_WORDS) -> Column:
    """tax, judgment or legislation by keyword counts, in that order of precedence; null where mixed."""
    tax, jud, leg = (F.regexp_count(question, F.lit(any_word(words[k]))) for k in ("tax", "judgment", "legislation"))
    return F.when((tax >= 2) & (jud == 0), "tax").when((jud >= 2) & (leg == 0), "judgment").when((leg >= 2) & (jud == 0), "legislation")


def complexity(question: Column, trivial_start: list[str] = TRIVIAL_START, trivial: list[str] = TRIVIAL_ANYWHERE, complex_: list[str] = COMPLEX, acts: list[str] = ACT_WORDS) -> Column:
    few = F.size(F.split(F.trim(question), r"\s+")) <= 4
    easy = question.rlike("(?iU)^(?:" + "|".join(trivial_start) + ")") | question.rlike(any_word(trivial))
    act = "(?:" + "|".join(acts) + ")"
    hard = question.rlike(any_word(complex_)) | question.rlike(f"(?iU){act}.{{3,50}}{act}")
    return F.when(few & easy, "trivial").when(hard, "complex").otherwise("simple")


def plural_pl(n: Column, one: str, few: str, many: str) -> Column:
    return F.when(n == 1, one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def host_allowed(origin: Column, domains: Column) -> Column:
    """Is the host listed, a subdomain of a listed one, or everything allowed."""
    host = F.lower(F.parse_url(origin, F.lit("HOST")))
    return F.exists(F.split(domains, r"\s*,\s*"), lambda d: (d == "*") | (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))


def client_ip(forwarded: Column, peer: Column) -> Column:
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), peer)


def cacheable(question: Column, fresh_words: list[str]) -> Column:
    return (F.length(F.trim(question)) >= 20) & ~question.rlike(any_word(fresh_words))
