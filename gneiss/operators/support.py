"""Whether texts bear out what is quoted from them: approximate alignment by seeds and bands.

A quote and a text are lists of tokens. Where three tokens in a row of the quote stand in the text too, the
distance between the places is a seed. Seeds fall into bands of ``BAND`` distances; a quote's place in a text is
where the band with most seeds is. From there the match is extended over the whole quote: a token counts if the
text has it in that band or one beside it, so that words put in, left out or changed cost themselves alone. The
support is the share of the quote's tokens that count.

Quotes meet texts by the hashes of their seeds, so a text that shares none costs nothing more, and a text's
tokens are only looked at again where a band was found; nothing is collected for a quote or a text.

Defined results: null and empty quotes have a support of zero; quotes of one or two tokens seed by all they have;
texts without seeds don't appear; of several claims or texts with one id the best support counts; null ids don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.functions.frames import broadcast_if_small, scratch

SEED, BAND = 3, 8
ENOUGH = 0.8


def _seeds(tokens: Column, size: Column) -> Column:
    """(size, hash, place) of each run of ``size`` tokens."""
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(size.alias("size"), F.xxhash64(F.slice(tokens, i, size)).alias("hash"), i.alias("place")))


def support(claims: DataFrame, texts: DataFrame, on: tuple[str, ...] = (), claim: str = "claim_id", quote: str = "quote", key: str = "text_id", source: str = "text") -> DataFrame:
    """(claim, key, on, support) of every pair of a claim and a text that share a seed.

    With ``on``, columns of both, only pairs that agree in them are compared.
    """
    asked = claims.select(claim, *on, text.tokens(F.col(quote)).alias("q")).where(F.size("q") > 0)
    asked = asked.withColumns({"qh": F.xxhash64("q"), "size": F.least(F.lit(SEED), F.size("q"))})
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # three at most
    if not sizes:
        return asked.select(claim, *on).join(texts.select(key, *on).limit(0), list(on) or None).select(claim, key, *on, F.lit(0.0).alias("support"))
    wanted = asked.select(claim, *on, "qh", "size", F.explode(_seeds(F.col("q"), F.col("size"))).alias("s")).select(claim, *on, "qh", "size", F.col("s.hash").alias("hash"), F.col("s.place").alias("at"))
    held = texts.select(key, *on, F.xxhash64(source).alias("th"), text.tokens(F.col(source)).alias("t"))
    runs = F.flatten(F.array(*[_seeds(F.col("t"), F.lit(n)) for n in sorted(sizes)]))
    dealt = held.select(key, *on, "th", F.explode(runs).alias("s")).select(key, *on, "th", "s.size", "s.hash", "s.place")
    met = dealt.join(broadcast_if_small(wanted), ["hash", "size", *on]).withColumn("band", F.floor((F.col("place") - F.col("at")) / BAND).cast("int"))
    pair = [claim, "qh", key, "th", *on]
    counted = met.groupBy(*pair, "band").agg(F.count("*").alias("seeds"))
    # The band with most seeds, of those the first.
    chosen = counted.groupBy(*pair).agg(F.max(F.struct("seeds", (-F.col("band")).alias("before"))).alias("m")).select(*pair, (-F.col("m.before")).alias("band"))
    path = scratch(texts.sparkSession)
    chosen.write.parquet(path)
    chosen = texts.sparkSession.read.schema(chosen.schema).parquet(path)
    both = held.join(broadcast_if_small(chosen), [key, "th", *on]).join(broadcast_if_small(asked.drop("size").distinct()), [claim, "qh", *on])
    first = (F.col("band") - 1) * BAND

    def stands(token, i):
        """Whether the token at place ``i`` of the quote (from 0) stands in the text where the bands lie."""
        begin = F.greatest(F.lit(1), i + 1 + first)
        many = F.greatest(F.lit(0), i + 1 + first + 3 * BAND - begin)
        return F.array_contains(F.slice("t", begin, many), token)

    share = F.round(F.size(F.filter("q", stands)) / F.size("q"), 9)
    return both.select(claim, key, *on, share.alias("support")).groupBy(claim, key, *on).agg(F.max("support").alias("support"))


def verified(claims: DataFrame, contexts: DataFrame, on: str = "case_id", enough: float = ENOUGH) -> DataFrame:
    """(case, claim_id, flagged, support, supported) of claims (case, claim_id, flagged, quote): a claim holds if it
    is flagged as supported and one of its case's contexts (case, text) bears its quote out."""
    found = support(claims, contexts.withColumn("text_id", F.xxhash64("text")), (on,)).groupBy(on, "claim_id").agg(F.max("support").alias("support"))
    met = claims.select(on, "claim_id", "flagged").join(found, [on, "claim_id"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    return met.withColumn("supported", F.coalesce("flagged", F.lit(False)) & (F.col("support") >= enough))
