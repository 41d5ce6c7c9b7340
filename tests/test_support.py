"""Support of quotes by texts."""

import json

from pyspark.sql import functions as F

from gneiss.operators import evaluation, support

WORDS = [f"w{i}" for i in range(60)]


def supports(spark, quotes, texts):
    claims = spark.createDataFrame(list(quotes.items()), "claim_id string, quote string")
    held = spark.createDataFrame(list(texts.items()), "text_id string, text string")
    return {(r["claim_id"], r["text_id"]): r["support"] for r in support.support(claims, held).collect()}


def test_kinds_of_quotes(spark):
    whole = " ".join(WORDS)
    edited = WORDS[10:40]
    edited[7] = "other"
    quotes = {
        "verbatim": " ".join(WORDS[10:40]), "edited": " ".join(edited), "added": " ".join([*WORDS[10:25], "put", "in", *WORDS[25:40]]),
        "left out": " ".join([*WORDS[10:20], *WORDS[23:40]]), "invented": " ".join(reversed(WORDS[10:40])), "far apart": " ".join([*WORDS[:3], *WORDS[40:60]]),
        "short": "w5", "two": "W5, w6!", "none": "", "null": None,
    }
    got = supports(spark, quotes, {"t": f"before {whole} after", "u": "w5 alone", "v": None, "x": ""})
    assert got["verbatim", "t"] == 1.0 and got["edited", "t"] == round(29 / 30, 9) and got["added", "t"] == 30 / 32 and got["left out", "t"] == 1.0
    assert ("invented", "t") not in got and got["far apart", "t"] < 0.9
    assert got["short", "t"] == got["short", "u"] == got["two", "t"] == 1.0 and ("two", "u") not in got
    assert not {"none", "null"} & {c for c, _ in got} and not {"v", "x"} & {t for _, t in got}
    assert supports(spark, {}, {"t": whole}) == {} and supports(spark, {"a": ""}, {"t": whole}) == {}


def test_repeated_words_and_ids(spark):
    claims = spark.createDataFrame([(1, "a a a a"), (1, "a a b c")], "claim_id int, quote string").withColumn("band", F.lit(1))
    texts = spark.createDataFrame([(7, "a a a a a a a a a a"), (7, "a a b c"), (7, "a a b c"), (None, "a a a")], "text_id int, text string")
    got = {(r["claim_id"], r["text_id"]): r["support"] for r in support.support(claims, texts).collect()}
    assert got == {(1, 7): 1.0}


def test_flags_are_not_believed(spark):
    def report(*checks):
        return json.dumps({"atomic_checks": [{"statement": "s", "is_supported_by_context": f, "citation_quote": q} for f, q in checks]})

    reports = spark.createDataFrame(
        [(1, report((True, "the pump is to be licensed"), (True, "never said by anyone"))), (2, report((True, "w1 w2 w3"))), (3, report((False, "the pump is to be licensed"))), (4, "no json"), (5, report((True, "")))],
        "case_id int, report string",
    )
    contexts = spark.createDataFrame([(1, "First. The pump is to be licensed, each year."), (1, "other"), (2, "w1 w2 w3"), (3, "The pump is to be licensed"), (9, "never said by anyone")], "case_id int, text string")
    got = {r["case_id"]: (r["total_claims"], r["leaked_claims"], r["verdict"]) for r in evaluation.verified_leakage(reports, contexts).collect()}
    bad, good = "FAIL_LEAKAGE_DETECTED", "PASS_ISOLATED"
    assert got == {1: (2, 1, bad), 2: (1, 0, good), 3: (1, 1, bad), 4: (0, 0, good), 5: (1, 1, bad)}
    believed = {r["case_id"]: r["leaked_claims"] for r in evaluation.leakage(reports).collect()}
    assert believed[1] == 0 and believed[5] == 0
