"""Chunking: overlapping chunks, articles, sections, parent and child chunks, as higher-order functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS = 4  # characters of a token
LEAST = 50  # characters of a chunk
CUT = "\x1e"  # a record separator marks where a text is split
END = "\x1f"  # and a unit separator where a header ends


def units(text: Column, limit: int, paragraph: str = r"\n\n+") -> Column:
    """Trimmed paragraphs; one longer than ``limit`` as its sentences."""
    parts = F.filter(F.transform(F.split(text, paragraph), lambda p: F.trim(p)), lambda p: p != "")
    sentences = lambda p: F.split(F.regexp_replace(p, r"(?<=[.!?])\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ])", CUT), CUT)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > limit, sentences(p)).otherwise(F.array(p))))


def fold(parts: Column, limit: int, overlap: int) -> Column:
    """Units joined to chunks of about ``limit`` characters; a chunk begins with the end of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("open"), F.lit(0).alias("size"))

    def tail(chunk: Column) -> Column:
        end = F.when(F.length(chunk) > overlap, F.substring(chunk, -overlap, overlap)).otherwise(chunk)
        blank = F.instr(end, " ")
        return F.when(blank > 1, F.substring(end, blank + 1, F.length(end))).otherwise(end)

    def step(acc: Column, u: Column) -> Column:
        full = (acc["size"] + F.length(u) > limit) & acc["open"]
        kept = tail(acc["now"]) if overlap else F.lit("")
        now = F.when(full, kept).otherwise(acc["now"])
        held = F.when(full, F.lit(bool(overlap))).otherwise(acc["open"])
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(held, F.concat(now, F.lit(" "), u)).otherwise(u).alias("now"),
            F.lit(True).alias("open"),
            (F.when(full, F.length(kept)).otherwise(acc["size"]) + F.length(u) + 1).cast("int").alias("size"),
        )

    done = lambda acc: F.filter(F.when(acc["open"], F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]), lambda c: F.length(c) >= LEAST)
    return F.aggregate(parts, start, step, done)


def chunks(text: Column, tokens: int = 512, overlap: int = 64, paragraph: str = r"\n\n+") -> Column:
    return fold(units(text, CHARS * tokens, paragraph), CHARS * tokens, CHARS * overlap)


def explode_chunks(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """One row per chunk with its index and the number of chunks."""
    return df.select(*keep, F.size(array).alias("total_chunks"), F.posexplode(array).alias("chunk_index", "chunk"))


def child_chunks(parents: DataFrame, act: str, chunk: str = "chunk", index: str = "chunk_index", tokens: int = 128, overlap: int = 16, paragraph: str = r"\n\n+") -> DataFrame:
    """Children of parent chunks; a parent with at most one child is its own child."""
    kids = chunks(F.col(chunk), tokens, overlap, paragraph)
    own = F.when(F.size(kids) <= 1, F.array(F.col(chunk))).otherwise(kids)
    rows = parents.withColumn("_kids", own).withColumn("parent_chunk_id", F.concat(F.col(act).cast("string"), F.lit("__p"), F.col(index).cast("string")))
    return rows.select(*parents.columns, "parent_chunk_id", F.size("_kids").alias("total_children"), F.posexplode("_kids").alias("child_index", "child_text"))


SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"  # what counts as white space
WORD = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # the same, one by one
# The line of an article header, and the lines that open a part of a judgment; both in any case.
ARTICLE = r"(?dmiU)^[ \t]*((?:Art\.|Artykuł|§)\s*\d+[\w.]*[a-z]?\.?)\s*$"
HEADER = r"(?dmiu)^[ \t]*(TEZA|TEZY|SENTENCJA|OSNOWA|W IMIENIU RZECZYPOSPOLITEJ POLSKIEJ|UZASADNIENIE|MOTYWY ROZSTRZYGNIĘCIA)[ \t]*$"
SECTIONS = {  # Fixed values: header lines of judgments and the part of the judgment that they open.
    "TEZA": "thesis",
    "TEZY": "thesis",
    "SENTENCJA": "ruling",
    "OSNOWA": "ruling",
    "W IMIENIU RZECZYPOSPOLITEJ POLSKIEJ": "ruling",
    "UZASADNIENIE": "justification",
    "MOTYWY ROZSTRZYGNIĘCIA": "justification",
}
ORDER = ["thesis", "ruling", "preamble", "justification", "full"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def articles(text: Column) -> Column:
    """Parts of an act that begin at article headers, each header glued to what follows it; the part before the first header stays.

    The whole text where there are fewer than two headers or one part; parts of fewer than 50 characters go."""
    parts = F.transform(F.split(F.regexp_replace(text, ARTICLE, f"{CUT}$1\n"), CUT), stripped)
    parts = F.filter(parts, lambda p: p != "")
    whole = (F.regexp_count(text, F.lit(ARTICLE)) < 2) | (F.size(parts) < 2)
    return F.when(whole, F.array(text)).otherwise(F.filter(parts, lambda p: F.length(p) >= LEAST))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, section_text) of judgments: lines belong to the last header above them; before any: preamble.

    A section that is opened again goes on behind a blank line; those of fewer than 50 characters go."""
    table = F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))
    marked = F.split(F.regexp_replace(F.col(text), HEADER, f"{CUT}$1{END}"), CUT)

    def run(part: Column, i: Column) -> Column:
        label = F.when(i == 0, "preamble").otherwise(F.element_at(table, F.upper(F.split_part(part, F.lit(END), F.lit(1)))))
        return F.struct(label.alias("section"), stripped(F.when(i == 0, part).otherwise(F.split_part(part, F.lit(END), F.lit(2)))).alias("line"))

    runs = df.select(key, F.filter(F.transform(marked, run), lambda r: r["line"] != "").alias("runs"))
    each = runs.select(key, "runs", F.explode(F.array_distinct(F.transform("runs", lambda r: r["section"]))).alias("section"))
    own = F.transform(F.filter("runs", lambda r: r["section"] == F.col("section")), lambda r: r["line"])
    return each.select(key, "section", F.array_join(own, "\n\n").alias("section_text")).filter(F.length("section_text") >= LEAST)


def sentence_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Sentences and paragraphs joined to chunks of at most ``size`` words; each begins with the last ``overlap`` words of the one before.

    A sentence is never cut: one of more than ``size`` words is a chunk, behind the carried words. Empty chunks go.

    Only numbers of words are folded: carried words are the last words of the text before the chunk's first sentence."""
    sentences = F.split(text, rf"{SPACE}(?<=[.!?][\s\S]){SPACE}*|\n\n+")
    counts = lambda parts: F.transform(parts, lambda s: F.regexp_count(s, F.lit(f"{WORD}+")))
    start = F.struct(F.array().cast("array<struct<first: int, before: int>>").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("all"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] > 0) & (acc["n"] + n > size)
        opened = F.struct(acc["at"].alias("first"), acc["all"].alias("before"))
        return F.struct(
            F.when(full, F.array_append(acc["done"], opened)).otherwise(acc["done"]).alias("done"),
            (acc["at"] + 1).alias("at"),
            (F.when(full, F.least(acc["n"], F.lit(overlap))).otherwise(acc["n"]) + n).alias("n"),
            (acc["all"] + n).alias("all"),
        )

    def chunks(parts: Column, words: Column, breaks: Column) -> Column:
        """Chunk k has the sentences from break k - 1 to before break k."""

        def chunk(first: Column, before: Column, end: Column) -> Column:
            own = F.array_join(F.slice(parts, first + 1, end - first), " ")
            carried = F.slice(words, F.greatest(before - overlap, F.lit(0)) + 1, F.least(before, F.lit(overlap)))
            return F.when(first == 0, own).otherwise(F.concat(F.array_join(carried, " "), F.lit(" "), own))

        rest = F.transform(breaks, lambda b, k: chunk(b["first"], b["before"], F.coalesce(F.get(breaks, k + 1)["first"], F.size(parts))))
        head = chunk(F.lit(0), F.lit(0), F.coalesce(F.get(breaks, F.lit(0))["first"], F.size(parts)))
        return F.filter(F.transform(F.concat(F.array(head), rest), lambda c: F.btrim(c, F.lit(SPACES))), lambda c: c != "")

    # each made once, as the element of an array, however often it is used
    once = lambda column, use: F.element_at(F.transform(F.array(column), use), 1)
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    made = once(sentences, lambda s: once(words, lambda w: once(F.aggregate(counts(s), start, step, lambda acc: acc["done"]), lambda b: chunks(s, w, b))))
    return F.when(text.isNotNull(), made)


def word_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Chunks of ``size`` words that share ``overlap`` words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))
