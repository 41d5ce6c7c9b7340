"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bestfit, chat, collocations, decontaminate, expiring, htmltext, imatch, licenses, ngram_lm, packing, quality, simhash, toxicity
from gneiss.llm.common import held_out, table

TOXIC_FROM = 0.5
GOOD_FROM = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _predicted(scored: DataFrame, name: str, bar: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= bar).cast("int").alias("predicted"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _predicted(toxicity.with_toxicity(docs, model), "toxicity", TOXIC_FROM)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _predicted(quality.with_quality(docs, model), "quality_score", GOOD_FROM)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.transform("license_spans", lambda s: s["sentence_id"])
    first = F.get("license_spans", F.lit(0))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join(ids, ",").alias("sentence_ids"), F.size("license_spans").cast("long").alias("n_sentences"), first["start"].alias("first_start"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return chat.digest(chat.examples(rows.unionByName(one)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    found = bestfit.placed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_expiring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiring.in_batches(spark, table(spark, sf_dir, "clicks"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of formatted instruction examples under limits on tokens, segments and loss.

    A target's loss-bearing tokens are those of its reply; half a sequence may bear loss.
    """
    made = chat.examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    counted = packing.with_counts(made.withColumn("key", F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "example")), tokenizer_path(), "formatted", "loss_start", "loss_length")
    placed = packing.pack_examples(counted, "key", "tokens", "loss", max_segments=16, max_loss=packing.LENGTH // 2)
    return placed.select("key", "tokens", "loss", "sequence_id", "offset", "fits")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_quality": op5_quality,
    "op6_license_scan": op6_license_scan,
    "op7_imatch": op7_imatch,
    "op8_chat_format": op8_chat_format,
    "op9_html_text": op9_html_text,
    "op10_lm_score": op10_lm_score,
    "op11_collocations": op11_collocations,
    "op12_best_fit": op12_best_fit,
    "op13_expiring_dedup": op13_expiring_dedup,
    "instruction_packing": instruction_packing,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op8_chat_format": chat.ORACLE_SQL,
    "op10_lm_score": ngram_lm.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_expiring_dedup": expiring.ORACLE_SQL,
}
