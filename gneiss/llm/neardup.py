"""Near-duplicate documents by shingle similarity, with MinHash candidates from pivot tables.

Documents link if at least ``THRESHOLD`` of the distinct five-word shingles of both are shared.
Each text gets the least hashes of its distinct shingles under ``MINIMA`` hash functions. One of
them is equal for two texts with a probability that is their similarity, whatever was edited and
where: scattered words, a cut, an added or an inserted passage. Texts are dealt out by runs of
``BAND`` minima; so many runs that a pair at the threshold meets in one of them with probability
``RECALL``, and closer pairs all the surer. The number of runs doesn't depend on the number of
texts. One bit of each of 128 minima makes a fingerprint, in which the bits of a pair at the
threshold differ with probability 0.1. Inside each group pivot distance tables discard pairs by
their largest coordinate difference, and the survivors within the radius make candidate groups.
In those the shingles themselves are compared, so that no document is linked but for its text.

A candidate group never emits its pairs: documents are joined to classes one after the other, and
a class is done as soon as one of its members links. Groups beyond a number of bytes are cut into
parts that are compared two by two.

Defined results: ASCII letters count as lower case and words stand between ASCII white space; texts
with the same words in the same order are equal; a text of fewer than five words has one
shingle, all of it; null and empty texts are equal; very long texts are hashed whole, a slice of
shingles at a time; documents without an id are compared like others, and name no group; an empty
table gives an empty result.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm import simhash
from gneiss.llm.common import WordHashes, broadcast_if_small, cut, with_utf8
from gneiss.llm.components import roots

THRESHOLD = 0.8
SHINGLE = 5
#: Probability that a pair at the threshold meets, and that its fingerprints are within the radius.
RECALL, WITHIN = 0.9999, 0.999995
#: Minima in a row that make a key, and bits of a fingerprint.
BAND, BITS = 5, 128
#: Shingles that are hashed at a time.
STEP = 256
#: Bytes of shingles that a part of a candidate group holds, about, and its documents at most.
PART_BYTES, PART_ROWS = 32_000_000, 500


def bands(threshold: float) -> int:
    """How many keys a text is dealt by."""
    return ceil(log(1 - RECALL) / log(1 - threshold**BAND))


def radius(threshold: float) -> int:
    """Bits that differ at most, but for 1 - ``WITHIN`` of the pairs at the threshold."""
    p, r, upto = (1 - threshold) / 2, 0, (1 - (1 - threshold) / 2) ** BITS
    while upto < WITHIN:
        r += 1
        upto += comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
    return r


def hash_functions(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors, one for each minimum."""
    salts = np.random.default_rng(20240502).integers(0, 2**64, (2, max(BITS, bands(threshold) * BAND)), np.uint64)
    return salts[0], salts[1] | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Hashes of the shingles as they follow, made of those of their words."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out ^ h[i : i + len(out)])
    return out


def minima(hashes: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each function."""
    least = np.full(len(masks), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at : at + STEP] ^ masks[:, None]) * factors[:, None]).min(axis=1), out=least)
    return least


def sketch(least: np.ndarray, count: int) -> tuple[int, int, list[int]]:
    """(s0, s1, keys): the fingerprint as two signed longs, and a key for each of ``count`` bands."""
    mixed = _mixed(least)
    s0, s1 = np.packbits((mixed[:BITS] & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8").tolist()
    rows = mixed[: count * BAND].reshape(count, BAND)
    keys = np.arange(count, dtype=np.uint64)
    for i in range(BAND):
        keys = _mixed(keys ^ rows[:, i])
    return s0, s1, keys.view(np.int64).tolist()


def text_key(words: list[bytes]) -> int:
    """A hash of the words in order, as a signed long."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    import xxhash

    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 3) for s in runs), np.uint64))


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the hash of each text's words."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([text_key(t.lower().split()) for t in batch.column(n).to_pylist()], pa.int64())], schema.names)

    return with_utf8(kept).mapInArrow(run, schema)


def _fingerprints(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    count = bands(threshold)

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        masks, factors = hash_functions(threshold)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                rows.append((text_key(words), *sketch(minima(shingle_hashes(words, width, known), masks, factors), count)))
            known.trim()
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [*[pa.int64()] * 3, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "fp", "s0", "s1", "keys"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint, s0 bigint, s1 bigint, keys array<bigint>"
    return with_utf8(docs.select("doc_id", "text")).drop("text").mapInArrow(run, schema)


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges between fingerprints (fp, s0, s1, keys) within the radius that share a key."""
    dealt = reps.select(F.explode("keys").alias("key"), "fp", "s0", "s1")
    return simhash.links_within(dealt, ["s0", "s1"], "fp", radius(threshold))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets share ``threshold`` of what they hold."""
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared)


def exact_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect what links connect, by place: each set is compared with the members of
    a class until one links, the latest first."""
    classes: list[list[int]] = []
    out = []
    for i, own in enumerate(sets):
        joined: list[int] | None = None
        rest = []
        for members in classes:
            link = next((j for j in reversed(members) if similar(own, sets[j], threshold)), None)
            if link is None:
                rest.append(members)
                continue
            out.append((i, link))
            joined = members if joined is None else joined + members
        rest.append([*(joined or []), i])
        classes = rest
    return out


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, threshold: float, width: int) -> DataFrame:
    """Edges (u, v) between texts of a candidate group whose shingles are similar enough.

    ``groups`` is (node, root) of candidate groups; only their texts' shingles are shuffled.
    """
    wanted = cut(groups.withColumnRenamed("node", "fp").join(reps.select("fp", "rep"), "fp"))
    ids = wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    nameless = wanted.where("rep is null").select("fp")
    if not nameless.isEmpty():
        found = with_key(docs.where("doc_id is null").select("doc_id", "text"), "fp").join(broadcast_if_small(nameless), "fp", "left_semi")
        texts = texts.union(found.select("doc_id", "text"))
    texts = with_utf8(texts).select("utf8")

    def shingled(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [t.lower().split() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([text_key(w) for w in rows], pa.int64()), pa.array([shingle_set(w, width).tobytes() for w in rows], pa.binary())], ["fp", "shingles"])

    sets = texts.mapInArrow(shingled, "fp bigint, shingles binary").dropDuplicates(["fp"]).join(wanted.select("fp", "root"), "fp")
    sets = cut(sets)
    sized = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = sized.select("root", F.greatest(F.ceil(F.col("bytes") / PART_BYTES), F.ceil(F.col("n") / PART_ROWS)).cast("long").alias("parts"))
    busy = cut(parts.where("parts > 1"))
    dealt = simhash.in_parts(sets.join(broadcast_if_small(busy), "root", "left"), "fp")

    def compared(frame):
        import pandas as pd

        frame = frame.sort_values("fp")
        fps = frame["fp"].to_numpy()
        pairs = exact_links([np.frombuffer(s, np.uint64) for s in frame["shingles"]], threshold)
        return pd.DataFrame({"u": [fps[i] for i, _ in pairs], "v": [fps[j] for _, j in pairs]}, dtype="int64")

    return dealt.groupBy("root", "a", "b").applyInPandas(compared, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: the smallest doc_id reachable by links, and
    a hash that names the component."""
    made = cut(_fingerprints(docs, threshold, width))
    reps = cut(made.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("s0", "s1", "keys")]))
    linked = verified(docs, reps, roots(candidates(reps, threshold)), threshold, width)
    return simhash.named_by_least(made.select("doc_id", "fp"), reps, roots(linked))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs, cut(near_duplicates(docs, threshold, width)), with_key)
