"""Retrieval metrics, acceptance checks, judge and leakage reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.operators import support
from gneiss.functions import models
from gneiss.functions.vectors import nearest
from gneiss.operators.retrieval import of_type


def _items(c) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def is_relevant(chunk_id: Column, source_file: Column, content: Column, ids: Column, files: Column, keywords: Column) -> Column:
    """An expected id, or an expected file with enough keywords; an empty list asks for nothing."""
    words, files = _items(keywords), _items(files)
    low = F.lower(F.coalesce(content, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, F.lower(w))))
    enough = hits >= F.least(F.lit(2), F.size(words))
    of_file = (F.size(files) == 0) | F.coalesce(F.array_contains(files, source_file), F.lit(False))
    return F.coalesce(F.array_contains(_items(ids), chunk_id), F.lit(False)) | (of_file & enough)


def targets(ids: Column, files: Column) -> Column:
    return F.greatest(F.size(_items(ids)), F.size(_items(files)), F.lit(1))


def metrics_at_k(flags: DataFrame, ks: list[int]) -> DataFrame:
    """(case_id, k, hits, recall, precision, hit, mrr) from (case_id, rank, relevant, targets).

    Precision divides by k, however few hits came back.
    """
    ks = sorted(set(ks))
    spread = flags.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    within = F.col("relevant") & (F.col("rank") <= F.col("k"))
    out = spread.groupBy("case_id", "k").agg(F.count_if(within).alias("hits"), F.max("targets").alias("targets"), F.min(F.when(within, F.col("rank"))).alias("first"))
    return out.select(
        "case_id",
        "k",
        "hits",
        F.least(F.lit(1.0), F.col("hits") / F.col("targets")).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the cases for each k."""
    return metrics.groupBy("k").agg(*[F.round(F.avg(m), 9).alias(n) for m, n in (("recall", "recall"), ("precision", "precision"), ("hit", "hit_rate"), ("mrr", "mrr"))])


def case_type(expected: Column, chosen: str | None) -> Column:
    """A case's own type goes before the general filter."""
    return F.coalesce(expected, F.lit(chosen))


def candidates(chunks: DataFrame, cases: DataFrame, k: int, chosen: str | None = None) -> DataFrame:
    """(query_id, chunk_id, cosine_similarity, rank_vec): the ``k`` nearest chunks of each case, among
    those of its own type, else of the chosen one.

    ``cases`` (query_id, embedding, expected_type) is a block that the driver can hold.
    """
    rows = cases.select("query_id", "embedding", case_type(F.col("expected_type"), chosen).alias("type")).collect()
    found = [nearest(of_type(chunks, t), {r["query_id"]: list(r["embedding"]) for r in rows if r["type"] == t}, k) for t in sorted({r["type"] for r in rows}, key=str)]
    out = found[0] if found else nearest(chunks, {}, k)
    for more in found[1:]:
        out = out.union(more)
    return out


def generated(cases: DataFrame, hits: DataFrame, backends: list, **how) -> DataFrame:
    """(query_id, answer): candidate answers to judge, from the contents of each case's hits.

    ``cases`` has query_id and query, ``hits`` query_id, rank and content. The first backend that
    answers counts; without any the answer says so.
    """
    block = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), F.coalesce("content", F.lit(""))).alias("text"))
    context = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    joined = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(context.schema["blocks"].dataType)), lambda b: b["text"]), "\n\n")
    prompts = cases.join(context, "query_id", "left").select("query_id", F.concat(joined, F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:")).alias("prompt"))
    return models.with_answer(prompts, backends, failed="No answer: every model is overloaded.", wait_for_quota=True, **how).select("query_id", "answer")


# ------------------------------------------------------------- acceptance checks


def embedding_check(chunks: DataFrame, dim: int, least: int = 300) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total"),
        F.count("embedding").alias("embedded"),
        F.coalesce(F.every(F.size("embedding") == dim), F.lit(False)).alias("dims_ok"),
    ).withColumn("passed", (F.col("total") == F.col("embedded")) & (F.col("total") >= least) & F.col("dims_ok"))


def table_check(chunks: DataFrame) -> DataFrame:
    """Every table chunk is one whole table."""
    low = F.lower(F.trim("content"))
    whole = F.startswith(low, F.lit("<table")) & F.endswith(low, F.lit("</table>"))
    return chunks.where("chunk_type = 'table'").agg(F.count("*").alias("tables"), F.coalesce(F.every(whole), F.lit(True)).alias("passed"))


def overlap_check(chunks: DataFrame) -> DataFrame:
    """(source_file, pairs, overlapping): text chunks whose first line is within the one before."""
    before = F.lag("content").over(Window.partitionBy("source_file").orderBy("chunk_index"))
    first = F.trim(F.get(F.split("content", "\n"), F.lit(0)))
    lagged = chunks.where("chunk_type = 'text'").select("source_file", "chunk_index", "content", before.alias("before"))
    held = (F.length(first) > 0) & F.contains(F.col("before"), first)
    return lagged.where("before is not null").groupBy("source_file").agg(F.count("*").alias("pairs"), F.count_if(held).alias("overlapping"))


def uniqueness_check(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    out = chunks.agg(F.count("*").alias("total"), F.countDistinct(key).alias("distinct_keys"))
    return out.withColumn("passed", (F.col("total") == F.col("distinct_keys")) & (F.col("total") > 0))


def top_hit_check(hits: DataFrame, floor: float, *keywords: str) -> DataFrame:
    """Whether the best hit is close enough and holds one of the keywords."""
    ok = F.col("cosine_similarity") > floor
    if keywords:
        ok = ok & F.coalesce(F.lower("content").rlike("|".join(re.escape(k.lower()) for k in keywords)), F.lit(False))
    return hits.orderBy(F.desc("cosine_similarity"), "chunk_id").limit(1).agg(F.coalesce(F.max(ok), F.lit(False)).alias("passed"))


def tally(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


# ------------------------------------------------------------- judge and leakage


def judged(reports: DataFrame, raw: str = "report") -> DataFrame:
    """Judge reports from JSON, with the verdict worked out again: all four scores at least 4.

    Text that isn't a report, or scores outside 1 to 5, give a null verdict.
    """
    parsed = reports.withColumn("r", F.from_json(raw, schemas.JUDGE_REPORT))
    scores = [F.col(f"r.{m}.score") for m in schemas.JUDGE_METRICS]
    named = parsed.select(*[c for c in reports.columns if c != raw], *[s.alias(m) for s, m in zip(scores, schemas.JUDGE_METRICS, strict=True)], F.col("r.verdict").alias("stated_verdict"))
    return named.withColumn("verdict", verdict([F.col(m) for m in schemas.JUDGE_METRICS]))


def verdict(scores: list[Column]) -> Column:
    known = scores[0].between(1, 5)
    for s in scores[1:]:
        known = known & s.between(1, 5)
    return F.when(~F.coalesce(known, F.lit(False)), F.lit(None).cast("string")).when(F.least(*scores) >= 4, "PASS").otherwise("FAIL")


def leakage(reports: DataFrame, raw: str = "report") -> DataFrame:
    """Leakage audits from JSON, with counts, rate and verdict worked out again."""
    parsed = reports.withColumn("checks", F.coalesce(F.from_json(raw, schemas.LEAKAGE_REPORT)["atomic_checks"], F.array().cast(schemas.LEAKAGE_REPORT["atomic_checks"].dataType)))
    total = F.size("checks")
    leaked = F.size(F.filter("checks", lambda c: ~F.coalesce(c["is_supported_by_context"], F.lit(False))))
    return parsed.select(*[c for c in reports.columns if c != raw], total.alias("total_claims"), leaked.alias("leaked_claims")).select("*", *leakage_verdict(F.col("leaked_claims"), F.col("total_claims")))


def verified_leakage(reports: DataFrame, contexts: DataFrame, case: str = "case_id", raw: str = "report") -> DataFrame:
    """(case, total_claims, leaked_claims, leakage_rate, verdict) of leakage audits whose flags aren't believed:
    what a claim quotes has to stand in a context (case, text) of its case, at least nearly (``support``).

    Reports that can't be read have no claims. Cases are given once.
    """
    parsed = reports.select(case, F.from_json(raw, schemas.LEAKAGE_REPORT)["atomic_checks"].alias("checks"))
    claims = parsed.select(case, F.posexplode_outer("checks").alias("claim_id", "c")).where("c is not null").select(case, "claim_id", F.col("c.is_supported_by_context").alias("flagged"), F.col("c.citation_quote").alias("quote"))
    held = support.verified(claims, contexts, case).groupBy(case).agg(F.count("*").alias("total"), F.count_if(~F.col("supported")).alias("leaked"))
    counts = reports.select(case).join(held, case, "left").select(case, F.coalesce("total", F.lit(0)).alias("total_claims"), F.coalesce("leaked", F.lit(0)).alias("leaked_claims"))
    return counts.select("*", *leakage_verdict(F.col("leaked_claims"), F.col("total_claims")))


def leakage_verdict(leaked: Column, total: Column) -> list[Column]:
    rate = F.when(total > 0, leaked / total).otherwise(0.0)
    return [rate.alias("leakage_rate"), F.when(leaked == 0, "PASS_ISOLATED").otherwise("FAIL_LEAKAGE_DETECTED").alias("verdict")]


def write_report(summaries: DataFrame, details: DataFrame, path: str) -> None:
    """Summary by k and details without candidates, as JSON."""
    summaries.withColumn("k", F.col("k").cast("string")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.drop("candidates").write.mode("overwrite").json(f"{path}/details")
