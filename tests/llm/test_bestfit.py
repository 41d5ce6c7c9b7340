"""Best-fit-decreasing packing against the heuristic run piece by piece, and round trips of ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import bestfit
from gneiss.llm.common import table
from gneiss.llm.packing import load_encoder
from gneiss.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"


def one_by_one(sizes, length):
    """Room left in every sequence if pieces are placed one after the other."""
    room = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= size]
        if fitting:
            room[min(fitting, key=lambda i: room[i])] -= size
        else:
            room.append(length - size)
    return sorted(room)


def by_plan(counts, length):
    """Room left by the plan's places, which must be gapless."""
    plan, held = bestfit.fit(counts, length), {}
    for size, n in counts.items():
        rows = plan[plan[:, 0] == size]
        rows = rows[np.argsort(rows[:, 1])]
        for k in range(n):
            _, first, sequence, per, offset = rows[np.searchsorted(rows[:, 1], k, "right") - 1]
            bins, inside = divmod(k - first, per)
            held.setdefault(sequence + bins, []).append((offset + inside * size, size))
    assert sorted(held) == list(range(len(held)))
    room = []
    for pieces in held.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        room.append(length - at)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_heuristic(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([1, 5, 16, 31, 64, 100]))
    sizes = np.minimum(length, 1 + rng.poisson(length / 6, 150)) if seed % 2 else rng.integers(1, length + 1, 150)
    values, n = np.unique(sizes, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    assert by_plan(counts, length) == one_by_one(sizes.tolist(), length)


def test_plan_does_not_grow_with_the_corpus():
    small = bestfit.fit({s: 1000 // s + 1 for s in range(1, 2049)}, 2048)
    large = bestfit.fit({s: 10**12 // s + 1 for s in range(1, 2049)}, 2048)
    assert len(large) < 4 * len(small) and len(large) < 20_000


def test_least_room_is_found():
    tree = bestfit.SpaceTree(10)
    for room, first in ((3, 0), (7, 5), (7, 9), (10, 20)):
        tree.add(room, first, first + 2)
    assert [tree.take(n)[0] for n in (4, 4, 1, 1)] == [7, 7, 3, 10] and tree.take(1) is None and tree.take(10) is None


def held(packed, length):
    """Checks places and gives the ids of each (doc_id, first row's text) back."""
    rows = packed.collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= length
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return by_doc, by_sequence


def test_round_trip(spark):
    docs = table(spark, DATA, "documents")
    by_doc, by_sequence = held(bestfit.pack(docs, tokenizer_path()), 2048)
    encode, total, sizes = load_encoder(tokenizer_path()), 0, []
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        ids = [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == [*encode(text or ""), 0] and [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // 2048) and all(r["length"] == 2048 for r in pieces[1:])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist()
        total += len(ids)
        sizes += [r["length"] for r in pieces]
    assert len(by_sequence) == len(one_by_one(sizes, 2048)) <= total / 2048 + 2


def test_whole_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)], "doc_id bigint, text string").repartition(7)
    made = bestfit.sequences(bestfit.pack(docs, tokenizer_path(), 64, end_id=9)).collect()
    encode = load_encoder(tokenizer_path())
    got = [i for r in made for i in np.frombuffer(r["ids"], "<u4").tolist()]
    assert sorted(got) == sorted(i for n in range(300) for i in [*encode("word " * (n % 40)), 9])
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 64 for r in made) and sum(len(r["doc_ids"]) for r in made) == 300


def test_odd_tables(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "a " * 20_000), (3, "z" * 50_000), (4, "same"), (4, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(F.lit(0).alias("sequence_id"), F.lit(1).alias("length"), "*")
    by_doc, _ = held(bestfit.pack(docs, tokenizer_path(), 256), 256)
    assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()}[1] == 2 and set(by_doc) == {1, 2, 3, 4, None}
    assert bestfit.pack(docs.limit(0), tokenizer_path()).count() == 0
    text_ids = spark.createDataFrame([("a.b", "x")], "doc_id string, text string")
    assert [r["doc_id"] for r in bestfit.pack(text_ids, tokenizer_path()).collect()] == ["a.b"]
