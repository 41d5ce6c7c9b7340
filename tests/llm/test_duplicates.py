"""SimHash groups, shingle groups, components, leaks and I-Match against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import components, decontaminate, imatch, neardup, simhash

DOCS = "doc_id bigint, text string"


def union(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def edited(words, rng, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for k in (0, 1, 2, 4):
            if rng.random() < 0.4:
                texts.append(" ".join(edited(base, rng, k)))
    texts += ["", "  ", "one", "one two", "One\tTwo"]
    rng.shuffle(texts)
    return texts


def test_components_of_busy_nodes(spark, monkeypatch):
    """With facts that are joined by shuffles, but for those of busy nodes."""
    from gneiss.llm import common

    monkeypatch.setattr(common.join_facts, "__defaults__", (20, 10))
    rng = random.Random(4)
    pairs = [(0, i) for i in range(1, 200)] + [(700, i) for i in range(500, 700)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    expected = union(701, pairs)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {x: expected[x] for x in {x for p in pairs for x in p if p[0] != p[1]}}


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 620)]
    df = spark.createDataFrame(pairs, "u bigint, v bigint")
    expected = union(700, pairs)
    got = {r.node: r.root for r in components.roots(df).collect()}
    touched = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: expected[x] for x in touched}
    assert components.roots(df.limit(0)).count() == 0


def naive_fingerprint(text, width=3):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_simhash_groups(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(simhash.edges, "__defaults__", (simhash.RADIUS, chunk))
    fps = [naive_fingerprint(t) for t in corpus]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    expected = union(len(fps), pairs)
    df = spark.createDataFrame(list(enumerate(corpus)), DOCS)
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex64(F.col("fp")).alias("hex"), "component_id").collect()
    assert len(out) == len(corpus)
    for r in out:
        assert r.hex == f"{fps[r.doc_id]:016x}" and r.component_id == expected[r.doc_id]


def test_simhash_uses_the_same_hash_as_the_engine(spark):
    row = spark.sql("SELECT xxhash64('é x') AS h").first()
    assert simhash.fingerprint("é X".encode()) == row.h % 2**64


@pytest.mark.parametrize("part", [neardup.PART_ROWS, 2])
def test_shingle_groups(spark, corpus, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART_ROWS", part)
    sets = [set(neardup.shingle_set(t.encode().lower().split(), 5).tolist()) for t in corpus]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    expected = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    df = spark.createDataFrame(list(enumerate(corpus)), DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(expected))
    kept = {r.doc_id for r in neardup.keep_one(df.withColumn("fp", F.lit(1)).withColumn("key", F.lit(2))).collect()}
    assert kept == set(expected)


def test_block_edits_at_the_threshold_link(spark):
    """Cut copies, and copies with a passage of new words added or inserted, at 0.8 to 0.9."""
    rng = random.Random(23)
    texts = []
    for k in range(240):
        base = [f"w{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(rng.randint(60, 900))]
        new = [f"r{rng.randrange(10**9)}" for _ in range(int(len(base) * rng.uniform(0.12, 0.23)))]
        at = rng.randrange(len(base))
        texts += [base, (base[len(new) :], base + new, base[:at] + new + base[at:])[k % 3]]
    sets = [set(neardup.shingle_set([w.encode() for w in t], 5).tolist()) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    near = [k for k, s in enumerate(alike) if s >= 0.8]
    assert len(near) > 150 and sum(s < 0.84 for s in alike) > 50
    assert [k for k in near if got[2 * k + 1] != 2 * k] == []
    assert all(got[2 * k + 1] == 2 * k + 1 for k, s in enumerate(alike) if s < 0.8)


def test_minima_agree_as_texts_do():
    """The share of equal minima and of equal bits follows the similarity, for any place of the edit."""
    masks, factors = neardup.hash_functions(0.8)
    rng = np.random.default_rng(3)
    minima, bits = [], []
    for _ in range(300):
        both = rng.integers(0, 2**64, 480, np.uint64)
        a, b = (neardup.minima(h, masks, factors) for h in (both[:432], both[48:]))
        minima.append((a == b).mean())
        x, y = (np.array(neardup.sketch(m, 1)[:2]).view(np.uint64) for m in (a, b))
        bits.append(int(np.bitwise_count(x ^ y).sum()))
    assert abs(np.mean(minima) - 0.8) < 0.01 and abs(np.mean(bits) - 12.8) < 0.8 and max(bits) <= neardup.radius(0.8)


def test_groups_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc d e"), (1, "abc d e"), (None, "abc d e"), (None, "zz y"), (None, "zz y"), (2, None), (3, "")], DOCS)
    for keep in (neardup.keep_one, lambda d: simhash.keep_one(d, simhash.near_duplicates(d), simhash.with_simhash)):
        assert sorted((r.doc_id or 0, r.text or "") for r in keep(df).collect()) == [(0, "zz y"), (1, "abc d e"), (2, "")]
        assert keep(df.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    """Columns with the names that operators would take pass through."""
    names = ["utf8", "_utf8", "__utf8", "own", "fp", "root", "component", "dirty", "simhash_", "UTF8_"]
    df = spark.createDataFrame([(i // 2, f"a b c d e f {i}", *names) for i in range(8)], DOCS + "".join(f", {n} string" for n in names))
    for out in (simhash.with_simhash(df), neardup.with_key(df, "key"), neardup.keep_one(df), simhash.keep_one(df, simhash.near_duplicates(df), simhash.with_simhash)):
        assert [r[n] for r in out.collect() for n in names] == names * out.count()
    first = simhash.with_simhash(df).where("doc_id = 0").collect()[0]
    assert first.simhash % 2**64 == naive_fingerprint(first.text)
    items = spark.createDataFrame([(1, "c d e f 0")], "item_id bigint, text string")
    assert decontaminate.without_leaks(df, items).count() == 7


def test_repeated_ids_of_different_texts(spark):
    """Every group keeps one row, also where an id stands for several texts."""
    df = spark.createDataFrame([(5, "p q r s t u"), (5, "a b c d e f"), (2, "A b c d e f"), (9, "p q r s t u"), (7, "x y"), (7, "z z z")], DOCS)
    for keep in (neardup.keep_one, lambda d: simhash.keep_one(d, simhash.near_duplicates(d), simhash.with_simhash)):
        assert sorted((r.doc_id, r.text) for r in keep(df).collect()) == [(2, "A b c d e f"), (5, "p q r s t u"), (7, "x y"), (7, "z z z")]


def test_exact_links_connect_chains():
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in (0, 3, 6, 9, 100, 102)]
    assert union(6, neardup.exact_links(sets, 0.8)) == [0, 0, 0, 0, 4, 4]


def leaks_by_force(docs, items, threshold=0.8):
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            if 0 < len(v) < 5:
                at = next((s for s in range(len(w) - len(v) + 1) if w[s : s + len(v)] == v), None)
                if at is not None:
                    out[d, i] = (1.0, at)
            if len(v) < 5 or len(w) < 5:
                continue
            g = grams(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                h = grams(w[s : s + len(v)])
                both = sum((g & h).values())
                sim = both / (sum(g.values()) + sum(h.values()) - both)
                if sim >= threshold and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randint(4, 60)))) for i in range(25)] + [(90, None), (91, "a b a b a b a b a b a b"), (92, "short one"), (93, "Q"), (94, "q7 q8 q9")]
    docs = []
    for d in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 80))]
        if d % 2:
            own = items[rng.randrange(27)][1] or ""
            own = own.split()
            if d % 6 == 1 and len(own) > 40:
                own[3] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in own]
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "a b a b a b a b a b a b"), (103, "a Short, one."), (104, "q short two q one"), (105, "q7 q8 Q9")]
    out = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), part_bytes=60_000).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.window_start) for r in out}
    expected = leaks_by_force(docs, items)
    assert set(got) == set(expected) and len(got) > 15
    assert all(abs(got[k][0] - expected[k][0]) < 1e-12 and got[k][1] == expected[k][1] for k in got)


def test_windows_meet_few_items(spark):
    """Of 1,500 items of one size a window meets only those with which it shares a shingle."""
    rng = random.Random(31)
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(50)) + " " + texts[k] + " tail") for k in range(40)], DOCS)
    made = decontaminate._items(items, decontaminate.RADIUS).cache()
    held = decontaminate._anchored(docs, made.select("iid", "n", F.posexplode("item").alias("off", "shingle"))).cache()
    windows = decontaminate._windows(held).cache()
    met = decontaminate._met(windows, held, made, decontaminate.RADIUS).count()
    assert windows.count() >= 40 and 40 <= met < 0.05 * 1500 * windows.count()
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(k, k) for k in range(40)}


def test_edited_items_are_found_as_by_all_windows(spark):
    """Scattered, replaced, inserted, dropped and appended words, near the threshold; every window
    of every document against every item."""
    rng = random.Random(31)
    items = [(i, [f"q{rng.randrange(300)}" for _ in range(rng.randint(14, 70))]) for i in range(30)]
    docs = []
    for d in range(240):
        own = list(items[rng.randrange(30)][1])
        k = max(1, int(len(own) * rng.uniform(0.02, 0.14)))
        at = rng.randrange(len(own) - k + 1)
        new = [f"n{rng.randrange(10**6)}" for _ in range(k)]
        own = [edited(own, rng, 1 + k // 6), own[:at] + new + own[at + k :], own[:at] + new + own[at:], own[:at] + own[at + k :], own[k:] + new][d % 5]
        head, tail = ([f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 40))] for _ in range(2))
        docs.append((d, " ".join([*head, *own, *tail])))
    items = [(i, " ".join(w)) for i, w in items]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    expected = leaks_by_force(docs, items)
    assert len(expected) > 60 and sum(s < 0.9 for s, _ in expected.values()) > 20
    assert set(got) == set(expected)


def test_parts_of_a_large_benchmark(spark):
    items = [(i, " ".join(f"q{i * 50 + k}" for k in range(5 + i % 40))) for i in range(200)]
    made = decontaminate._items(spark.createDataFrame(items, "item_id bigint, text string"), decontaminate.RADIUS)
    parts = decontaminate._parts(made, 100_000)
    assert parts > 5 and max(r[1] for r in made.groupBy(F.pmod("iid", F.lit(parts))).agg(F.sum("bytes")).collect()) <= 200_000


def test_leaks_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (None, "x a b c d e f y", 2), (2, None, 3)], DOCS + ", n int")
    items = spark.createDataFrame([(7, "a b c d e f", 1)], "item_id bigint, text string, n int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 7), (None, 7)}
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [2]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0


def test_rows_are_judged_by_their_texts(spark):
    """A leak takes its own row only, where ids are null or repeat; near copies without ids go."""
    leak, words = "x a b c d e f y", [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(None, leak), (None, "clean one"), (4, leak), (4, "clean two"), (5, leak)], DOCS)
    items = spark.createDataFrame([(7, "a b c d e f")], "item_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.without_leaks(df, items).collect()) == [(0, "clean one"), (4, "clean two")]
    near = [" ".join(w) for w in (words, [*words, "new"], words[1:])]
    far = [" ".join(reversed(words)), " ".join([*reversed(words), "new"])]
    df = spark.createDataFrame([(None, near[0]), (None, near[1]), (8, near[2]), (None, far[0]), (None, far[1])], DOCS)
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(df).collect()]
    assert len(kept) == 2 and (8, near[2]) in kept and any(d is None and t in far for d, t in kept)


def test_imatch_neighbours(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(120)]
    rows = [(i * 3 - 20, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(500, rows[0][1]), (501, "é" * 10), (502, None), (503, "only here")]
    out = {r.doc_id: r for r in imatch.compare_neighbours(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted((d for d, _ in rows), reverse=True)
    texts = {d: t or "" for d, t in rows}
    for d, after in zip(order, order[1:] + order[:1]):
        k = len(texts[d]) // 3
        changed = texts[d][: len(texts[d]) - k] + texts[after][:k]
        r = out[d]
        assert r.n_chars == len(texts[d]) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == out[after].fingerprint:
            assert r.near_next == 1
    assert out[500].fingerprint == out[rows[0][0]].fingerprint
    long = [r for r in out.values() if r.n_chars > 150]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)


def brute_fingerprints(spark, texts):
    """I-Match from its definition: band, sorted terms, subsets by residues of the terms' hashes."""
    import re

    import xxhash

    sets = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    signed = lambda x: x - 2**64 if x >> 63 else x
    code = {w: signed(xxhash.xxh64_intdigest(w, 42)) for s in sets for w in s}
    seen = {w: sum(w in s for s in sets) for w in code}
    low, high = max(2, imatch.LOW * len(texts)), max(2, imatch.HIGH * len(texts))
    band = {w for w, n in seen.items() if low <= n <= high}

    def hashes(lists):
        rows = spark.createDataFrame(list(enumerate(lists)), "k bigint, x array<bigint>").select("k", F.hash("x")).collect()
        return [(h >> 16) or 1 for _, h in sorted(map(tuple, rows))]

    subsets, places = [], {}
    for t, s in enumerate(sets):
        for level, (classes, most) in enumerate(imatch.LEVELS):
            for j in range(most):
                held = sorted(code[w] for w in s & band if code[w] % classes == j)
                if held:
                    places[t, level, j] = len(subsets)
                    subsets.append(held)
        if not s & band:
            places[t, "rest", 0] = len(subsets)
            subsets.append(sorted(code[w] for w in s))
    found = hashes(subsets)
    found = {k: found[i] for k, i in places.items()}
    groups = imatch.LEVELS[0][1] // imatch.COARSE
    out = []
    united = spark.createDataFrame([(t, j, [found.get((t, 0, j + imatch.COARSE * g), 0) for g in range(groups)]) for t in range(len(texts)) for j in range(imatch.COARSE)], "t int, j int, x array<smallint>")
    coarse = {(r.t, r.j): ((r.h >> 16) or 1) if any(r.x) else 0 for r in united.select("t", "j", "x", F.hash("x").alias("h")).collect()}
    for t in range(len(texts)):
        row = [coarse[t, j] for j in range(imatch.COARSE)]
        row += [found.get((t, level, j), 0) for level, (_, most) in enumerate(imatch.LEVELS) for j in range(most)]
        out.append("".join(f"{x % 65536:04x}" for x in [*row, found.get((t, "rest", 0), 0)]))
    return out


@pytest.mark.parametrize("most", [imatch.MOST_TERMS, 3])
def test_imatch_equals_its_definition(spark, monkeypatch, most):
    monkeypatch.setattr(imatch.with_held, "__defaults__", (most,))
    rng = random.Random(12)
    texts = [" ".join(f"t{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randint(0, 120))) for _ in range(80)] + ["", "only here", "Écrit é 9x"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.fingerprint for r in imatch.compare_neighbours(df).collect()}
    assert got == dict(enumerate(brute_fingerprints(spark, texts)))
    alone = imatch.with_fingerprint(df.withColumn("held", F.lit("x")), imatch.lexicon(df)).select("doc_id", "held", imatch.text_of(F.col("fingerprint"))).collect()
    assert {r[0]: r[2] for r in alone} == got and {r.held for r in alone} == {"x"}


def test_next_smaller_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rng = random.Random(3)
    ids = rng.sample(range(-10**6, 10**6), 300)
    got = {r.doc_id: r.below for r in imatch.next_smaller(spark.createDataFrame([(i,) for i in ids], "doc_id bigint")).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, [None, *order], strict=False))


def test_imatch_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e f g"), (None, None)], DOCS)
    assert imatch.compare_neighbours(df).count() == 4
    assert imatch.compare_neighbours(df.limit(0)).count() == 0
