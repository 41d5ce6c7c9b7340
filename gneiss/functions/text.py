"""Text expressions: tokens, sentences, overlap prefixes, cleaning and natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.stemming import STOP_WORDS

TOKEN = r"[\p{L}\p{N}]+"
# A sentence ends after a full-width mark or line break, or at white space after a mark.
SENTENCE_END = r"(?<=[。！？\n])|(?<=[.!?])\s+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Tokens that aren't English stop words."""
    stop = sorted(STOP_WORDS)
    return F.filter(tokens(text), lambda t: ~t.isin(stop))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def overlap_prefix(previous: Column, target: int = 250) -> Column:
    """Whole sentences from the end until they hold ``target`` characters, closed by a full stop.

    Null and blank give an empty text.
    """

    def take(acc, s):
        return F.when(acc["n"] >= target, acc).otherwise(F.struct(F.concat(F.array(s), acc["kept"]).alias("kept"), (acc["n"] + F.length(s)).alias("n")))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    kept = F.aggregate(F.reverse(sentences(F.coalesce(previous, F.lit("")))), start, take)["kept"]
    joined = F.array_join(kept, " ")
    return F.when(joined == "", "").when(joined.rlike("[。！？.!?]$"), joined).otherwise(F.concat(joined, F.lit("。")))


def clean_for_embedding(content: Column, limit: int = 3500) -> Column:
    """Without style attributes, and only as long as an embedding model reads."""
    without = F.regexp_replace(F.regexp_replace(content, r"\s+style='[^']*'", ""), r'\s+style="[^"]*"', "")
    return F.substring(F.when(F.contains(content, F.lit("style=")), without).otherwise(content), 1, limit)


def natural_key(name: Column) -> Column:
    """Sorts names with numbers by value: digits without leading zeros come after how many they are,
    the rest is lower-cased. Runs of up to 10**9 digits keep their order."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))

    def padded(p):
        digits = F.regexp_replace(p, "^0+(?=\\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(p)), "")


def file_name() -> Column:
    """The plain name of the file that a row was read from."""
    last = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def stem_of(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def chunk_id(file_name: Column, index: Column) -> Column:
    return F.concat(stem_of(file_name), F.lit("_c"), index.cast("string"))


def breadcrumb(titles: Column, max_length: int = 150) -> Column:
    """Non-empty titles by level, joined; a long path of over two titles keeps its ends."""
    kept = F.filter(titles, lambda t: t.isNotNull() & (t != ""))
    full = F.array_join(kept, " / ")
    short = F.concat(F.get(kept, F.lit(0)), F.lit(" / ... / "), F.element_at(kept, -1))
    return F.when(F.size(kept) == 0, "未分類章節").when((F.length(full) > max_length) & (F.size(kept) > 2), short).otherwise(full)
