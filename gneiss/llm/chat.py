"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and only
that reply under the loss mask. What stands after the last reply makes one more example without
a target, so that the output holds the whole conversation.

A turn is written as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Backslashes in
texts are doubled, and every control string (of this template and of other common ones) is
broken by a backslash after its first character; dropping each backslash before a character
gives the text back.

Defined results: null texts and roles are empty; turns are ordered by number, then role, then
text, so repeated turns have a fixed order and stay; each row without a conversation id is a
conversation of its own, told apart by ``single``; a conversation without a reply has one example
without a target; very long texts are written whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and strings that some model's template gives a meaning.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """(conv_id, single, example, is_target, formatted, loss_start, loss_length), places in characters.

    ``single`` is null where there is a conversation id.
    """
    single = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", single.alias("single"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id", "single").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = gathered.select(
        "conv_id",
        "single",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.length(escape(t["text"])) + len(END)).alias("ends"),
    )
    # An outer explode: an inner one would have the parts made twice, once for a filter.
    dealt = written.select("conv_id", "single", "roles", "parts", "ends", F.posexplode_outer("roles").alias("at", "role"))
    is_target = F.col("role") == target
    wanted = dealt.where(is_target | (F.col("at") == F.size("roles") - 1))
    formatted = F.array_join(F.slice("parts", 1, F.col("at") + 1), "")
    made = wanted.select("conv_id", "single", F.col("at").alias("example"), is_target.alias("is_target"), formatted.alias("formatted"), F.get("ends", F.col("at")).alias("tail"))
    start = F.when(F.col("is_target"), F.length("formatted") - F.col("tail"))
    size = F.when(F.col("is_target"), F.col("tail") - len(END))
    return made.select("conv_id", "single", "example", "is_target", "formatted", start.alias("loss_start"), size.alias("loss_length"))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, length))


def turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example, read back."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    pattern = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.transform(whole, lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))


def digest(made: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples."""
    each = made.select("conv_id", "single", "example", "formatted", F.when(F.col("is_target"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))).alias("loss"))
    of = each.groupBy("conv_id", "single").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    read = of.select("conv_id", turns(F.col("last")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digest from the turns themselves, in SQL.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(role) + length(text)
    + len(regexp_extract_all(role, '\\|\n|<\||</?s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))
    + 24 AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM c
), r AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last_k FROM s
)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR k = last_k)::bigint AS formatted_chars
FROM r GROUP BY conv_id
"""
