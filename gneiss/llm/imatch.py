"""I-Match document fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon is the band of terms that occur in more than a small and less than a large share of
the documents. A document's distinct lexicon terms are sorted and hashed once for each of many
random subsets of the lexicon, so that a changed word alters only the hashes of the subsets that
hold it. Subsets come at several rates, for short and for long texts.

The lexicon has at most (mean distinct terms of a document) / ``LOW`` terms, whatever the number
of documents. Texts' terms are met with it by an exact join on 64-bit hashes, broadcast up to a
bound, and gathered again inside the partitions in which the texts already stand.

Defined results: a null text counts as empty; equal texts have equal fingerprints; a text
without any lexicon term is told apart by all its terms; likeness is 1 for equal fingerprints and
else a share of equal hashes, which are kept to 16 bits each; repeated rows are fingerprinted each;
very long texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import broadcast_if_small, cut, unused

#: The band, as shares of the documents.
LOW, HIGH = 0.001, 0.25
#: Levels of random subsets: (classes into which the lexicon falls, classes that are used). A
#: level's subsets share no term, so their hashes change independently of each other. One more
#: level, of ``COARSE`` subsets, unites those of the first.
LEVELS = ((32, 32), (128, 32), (512, 32), (2048, 16))
COARSE = 8
STEP = 4
#: Terms of the largest lexicon that is broadcast; a larger one is joined by a shuffle.
MOST_TERMS = 1_000_000
#: Share of a level's subsets filled at most for the level to count as sparse.
SPARSE = 0.75
WORD = r"[\p{L}\p{N}]+"
#: Ids in a range within which neighbours are found, for up to MAX_RANGES ranges, and beyond.
RANGE_ROWS, MAX_RANGES, MAX_RANGE_ROWS = 20_000, 2_000, 1_000_000


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): hashes of the terms in the band, by the document frequencies of all rows.

    At least two documents must hold a term, however few documents there are.
    """
    total = docs.count()
    seen = docs.select(F.explode_outer(term_hashes(F.col("text"))).alias("term")).where("term is not null").groupBy("term").count()
    return cut(seen.where((F.col("count") >= max(2, low * total)) & (F.col("count") <= max(2, high * total))).select("term"))


def with_held(rows: DataFrame, terms: DataFrame, arrays: list[str], by: list[str], most: int = MOST_TERMS) -> DataFrame:
    """``rows`` with only those hashes left in its columns ``arrays`` that the lexicon has, sorted.

    One row for each hash is joined to the lexicon, which is broadcast if it has at most ``most``
    terms, and the hashes of a row are gathered again. Where ``rows`` is dealt out by the columns
    ``by``, nothing is shuffled for that.
    """
    one, uid, known = unused(rows, "one"), unused(rows, "uid"), unused(rows, "known")
    facts = [c for c in rows.columns if c not in arrays and c not in by]

    def tagged(i: int, name: str) -> Column:
        return F.transform(name, lambda h: F.struct(F.lit(i).alias("kind"), h.alias("h")))

    # An outer explode: rows without a term stay.
    every = F.concat(*(tagged(i, a) for i, a in enumerate(arrays)))
    dealt = rows.withColumn(uid, F.monotonically_increasing_id()).select(*by, uid, *facts, F.explode_outer(every).alias(one))
    lookup = broadcast_if_small(terms.select(F.col("term").alias(known)), most)
    met = dealt.join(lookup, F.col(f"{one}.h") == F.col(known), "left")
    gathered = [F.sort_array(F.collect_list(F.when(F.col(f"{one}.kind") == i, F.col(known)))).alias(a) for i, a in enumerate(arrays)]
    return met.groupBy(*by, uid).agg(*[F.first(c).alias(c) for c in facts], *gathered).drop(uid)


def _short(x: Column) -> Column:
    """The upper 16 bits of a hash; zero stands for no term."""
    high = F.shiftright(x, 16)
    return F.when(high == 0, 1).otherwise(high).cast("smallint")


def whole_hash(terms: Column) -> Column:
    """What a text without lexicon terms is told by: a hash of all its terms."""
    return _short(F.hash(F.sort_array(terms)))


def with_subset_hashes(df: DataFrame, held: str, whole: str, name: str) -> DataFrame:
    """``df`` with a fingerprint, an array of 16-bit hashes, in place of a text's sorted lexicon
    terms and the hash of all its terms.

    Classes are told by the low bits of a term's hash, the first ones by the lowest, and are
    split off in two steps. The coarsest level's hashes are made from those of the next one, whose
    classes they unite. The last hash is over all terms, and there only if no term is in the lexicon.
    """
    own = unused(df, f"_{name}_")
    while any(c.lower().startswith(own.lower()) for c in df.columns):
        own = f"_{own}"
    kept = [c for c in df.columns if c not in (held, whole, name)]

    def in_class(source: str, mask: int, value: int) -> str:
        return f"filter(`{source}`, h -> (h & {mask}L) = {value}L)"

    def short(x: str) -> str:
        return f"cast(if(shiftright({x}, 16) = 0, 1, shiftright({x}, 16)) as smallint)"

    # Text instead of Columns: hundreds of lambdas are parsed faster than they are made one by one.
    source = held
    for level, (classes, most) in enumerate(LEVELS):
        if most < classes:
            used = f"{own}u{level}"
            df = df.withColumn(used, F.expr(in_class(source, (classes - 1) & ~(most - 1), 0)))
            source = used
        parts = [f"{own}{level}_{g}" for g in range(STEP)]
        df = df.withColumns({p: F.expr(in_class(source, STEP - 1, g)) for g, p in enumerate(parts)})
        subsets = ", ".join(in_class(parts[j % STEP], most - 1, j) for j in range(most))
        df = df.withColumn(f"{own}h{level}", F.expr(f"transform(array({subsets}), x -> if(size(x) > 0, {short('hash(x)')}, 0S))"))
    groups = LEVELS[0][1] // COARSE
    united = ", ".join("array(" + ", ".join(f"get(`{own}h0`, {j + COARSE * g})" for g in range(groups)) + ")" for j in range(COARSE))
    coarse = F.expr(f"transform(array({united}), x -> if(exists(x, v -> v <> 0S), {short('hash(x)')}, 0S))")
    rest = F.when(F.size(held) == 0, F.col(whole)).otherwise(F.lit(0).cast("smallint"))
    made = F.concat(coarse, *[F.col(f"{own}h{i}") for i in range(len(LEVELS))], F.array(rest))
    return df.select(*kept, made.alias(name))


def with_fingerprint(docs: DataFrame, terms: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with its text's fingerprint by a lexicon; a column of that name is replaced."""
    held, whole = unused(docs, "held"), unused(docs, "whole")
    hashed = docs.drop(name).withColumn(held, term_hashes(F.col(text)))
    found = with_held(hashed.withColumn(whole, whole_hash(F.col(held))), terms, [held], [])
    return with_subset_hashes(found, held, whole, name).select(*[c for c in docs.columns if c != name], name)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal hashes among those that are there in either, pooled from
    the densest sparse level to the sparsest."""
    sums, first, sizes = [], 1, [COARSE, *[most for _, most in LEVELS]]
    for most in sizes:
        pair = F.zip_with(F.slice(a, first, most), F.slice(b, first, most), lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1001).otherwise(1))
        sums.append(F.aggregate(pair, F.lit(0), lambda acc, v: acc + v))
        first += most
    limits = F.array(*[F.lit(int(SPARSE * most)) for most in sizes])

    def share(s):
        # Of each sum the thousands count equal hashes, the rest those that are there.
        tail = F.transform(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), lambda i: F.aggregate(F.slice(s, i + 1, len(sizes)), F.lit(0), lambda acc, v: acc + v))
        sparse = F.filter(tail, lambda t, i: (t % 1000 > 0) & (F.get(s, i) % 1000 <= F.get(limits, i)))
        chosen = F.coalesce(F.get(sparse, F.lit(0)), F.get(F.filter(tail, lambda t: t % 1000 > 0), F.lit(0)))
        return F.when(chosen.isNotNull(), F.floor(chosen / 1000) / (chosen % 1000)).otherwise(0.0)

    wrapped = F.transform(F.array(F.array(*sums)), share)
    return F.when(a == b, 1.0).otherwise(F.get(wrapped, F.lit(0)))


def text_of(fingerprint: Column) -> Column:
    """A fingerprint as a string of hex digits."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.right(F.concat(F.lit("000"), F.hex(x)), F.lit(4)))), "")


def next_smaller(ids: DataFrame) -> DataFrame:
    """(doc_id, below): each distinct id's next smaller one; null for the least.

    Ids are dealt out by ranges, each sorted by a task of its own. The range below is found
    in the same way among the ranges' largest ids, so no task sorts more than a range.
    """
    total = ids.count()
    if total <= RANGE_ROWS:
        return ids.select("doc_id", F.lead("doc_id").over(Window.orderBy(F.desc("doc_id"))).alias("below"))
    parts = max(min(ceil(total / RANGE_ROWS), MAX_RANGES), ceil(total / MAX_RANGE_ROWS))
    ranged = cut(ids.repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id()))
    tops = cut(ranged.groupBy("range").agg(F.max("doc_id").alias("top")))
    lower = next_smaller(tops.select(F.col("top").alias("doc_id"))).select(F.col("doc_id").alias("top"), F.col("below").alias("under"))
    inside = F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.desc("doc_id")))
    found = ranged.withColumn("inside", inside).join(broadcast_if_small(tops.join(lower, "top").select("range", "under")), "range")
    return found.select("doc_id", F.coalesce("inside", "under").alias("below"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, n_chars) of the distinct ids: the next smaller id, after the last the first."""
    ids = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars")))
    first = ids.agg(F.max("doc_id")).first()[0]
    return ids.join(next_smaller(ids.select("doc_id")), "doc_id").select("doc_id", F.coalesce("below", F.lit(first)).alias("next_id"), "n_chars")


def edited_texts(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, prev_id, text, edited): the last third replaced by the next document's start; the
    rows with an id, dealt out by it, and those without.

    Texts are shuffled once, and besides only the characters that the predecessor needs. A row
    without an id has no neighbour; where an id repeats, the smallest start is taken.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wanted = pairs.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    own = texts.where("doc_id is not null").join(wanted, "doc_id")
    heads = own.groupBy(F.col("prev_id").alias("doc_id")).agg(F.min(F.substr("text", F.lit(1), F.col("need"))).alias("head"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("head", F.lit(1), third))
    columns = ("doc_id", "prev_id", "text", edited.alias("edited"))
    nameless = texts.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("prev_id"), "text", F.lit("").alias("head"))
    return own.join(heads, "doc_id").select(*columns), nameless.select(*columns)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside its edited text's and its next document's."""
    pairs = cut(neighbours(docs))
    terms = lexicon(docs)

    def printed(both: DataFrame) -> DataFrame:
        facts = both.select("doc_id", "prev_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), term_hashes(F.col("text")).alias("a"), term_hashes(F.col("edited")).alias("b"))
        wholes = facts.withColumns({"whole_a": whole_hash(F.col("a")), "whole_b": whole_hash(F.col("b"))})
        held = with_held(wholes, terms, ["a", "b"], ["doc_id"])
        return with_subset_hashes(with_subset_hashes(held, "a", "whole_a", "fp"), "b", "whole_b", "edited_fp")

    named, nameless = edited_texts(docs, pairs)
    made = printed(named)
    rows = cut(made if nameless.isEmpty() else made.unionByName(printed(nameless)))
    after = rows.where("prev_id is not null").groupBy(F.col("prev_id").alias("doc_id")).agg(F.min("fp").alias("next_fp"))
    return rows.join(after, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("fp")).alias("fingerprint"),
        text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )
