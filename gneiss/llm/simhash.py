"""SimHash near-duplicates, found with pivot distance tables.

Equal fingerprints are first merged, so groups of exact copies cost one row. Two fingerprints
within the radius share some of the blocks into which the bits are cut, so each fingerprint is
dealt out once for every choice of shared blocks (no pair within the radius is missed). Inside
each dealt group a pivot table holds the Hamming distances to fixed reference fingerprints; by
the triangle inequality a pair whose coordinates differ by more than the radius anywhere is
discarded, and the survivors are verified bit by bit. A group never emits its pairs, only a
spanning star of what is linked; groups beyond a size are compared in chunks by many tasks.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; very long texts are hashed whole, their bits counted in slices; repeated
rows give repeated result rows; a group whose ids are all null has a null component; an empty
table gives an empty result; a column of the input that has a result column's name is replaced.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import broadcast_if_small, cut, join_facts, unused, with_utf8
from gneiss.llm.components import roots

RADIUS = 3
SHINGLE = 3
PIVOTS = 16
#: Members of a dealt group that one task compares; larger groups are compared in chunks.
CHUNK = 4096


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of whole UTF-8 text: ASCII lower case, words between ASCII white space."""
    import xxhash

    words = text.lower().split()  # of bytes: touches A-Z only, splits at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def with_simhash(docs: DataFrame, name: str = "simhash", width: int = SHINGLE) -> DataFrame:
    """``docs`` with its fingerprint as a signed long; batches stream through."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_columns - 1
            values = np.array([fingerprint(t, width) for t in batch.column(n).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(values, pa.int64())], schema.names)

    return with_utf8(kept).mapInArrow(run, schema)


def hex64(fp: Column) -> Column:
    """Sixteen lowercase hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shared_blocks(n_rows: int, radius: int) -> int:
    """How many intact blocks to deal by: enough key bits for the number of fingerprints."""
    k = 2
    while 64 * k / (radius + k) < log2(max(2, n_rows)) and comb(radius + k, k) < 120:
        k += 1
    return k


def block_keys(fp: Column, radius: int, intact: int) -> Column:
    """One key for each choice of ``intact`` of ``radius + intact`` blocks: at least one of
    them is equal for two fingerprints within the radius."""
    n = radius + intact
    edges = [round(64 * i / n) for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), intact)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def pivot_fingerprints(count: int, words: int = 1) -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**64, (count, words), np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def links(fps: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) by place within one group, for members that aren't their own root.

    ``fps`` and ``pivots`` have a row of 64-bit words for each fingerprint.
    """
    m = len(fps)
    table = np.stack([hamming(fps, p) for p in pivots], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    label = np.arange(m)
    first = table[:, 0]
    lo = 0
    while lo < m:
        end = np.searchsorted(first, first[lo:] + radius, side="right")
        rows = max(1, int(np.searchsorted(np.cumsum(end - np.arange(lo, m)), 2_000_000)))
        hi = min(m, lo + rows)
        width = end[: hi - lo] - np.arange(lo, hi) - 1
        i = np.repeat(np.arange(lo, hi), width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + i + 1
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        near = hamming(fps[i], fps[j]) <= radius
        _merge(label, i[near], j[near])
        lo = hi
    linked = label != np.arange(m)
    return order[linked], order[label[linked]]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in place; a label is the smallest index of its class."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def linked(dealt: DataFrame, keys: list[str], fps: list[str], node: str, radius: int) -> DataFrame:
    """Edges (u, v) between nodes that share the keys and lie within the radius.

    Rows come sorted by key; a key's rows are held together, a batch's others are let go.
    """
    pivots = pivot_fingerprints(PIVOTS, len(fps))
    cols = [*keys, node, *fps]

    def run(batches):
        import pyarrow as pa

        def groups(rows):
            key, nodes, fp = rows[:, : len(keys)], rows[:, len(keys)], rows[:, len(keys) + 1 :].view(np.uint64)
            edges = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(rows))
            found, lo = [], 0
            for hi in edges:
                if hi - lo > 1:
                    u, v = links(fp[lo:hi], radius, pivots)
                    found.append(np.stack([nodes[lo:hi][u], nodes[lo:hi][v]], axis=1))
                lo = hi
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        held = np.zeros((0, len(cols)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns], axis=1)])
            last = np.flatnonzero((rows[:, : len(keys)] != rows[-1, : len(keys)]).any(axis=1))
            at = last[-1] + 1 if len(last) else 0
            yield from groups(np.ascontiguousarray(rows[:at]))
            held = rows[at:]
        yield from groups(np.ascontiguousarray(held))

    return dealt.select(*cols).repartition(*keys).sortWithinPartitions(*cols).mapInArrow(run, "u bigint, v bigint")


def links_within(dealt: DataFrame, fps: list[str], node: str, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges among rows that share ``key``; busy keys are cut into parts, any two of which are
    compared by a task of their own."""
    busy = cut(dealt.groupBy("key").count().where(F.col("count") > chunk))
    if busy.isEmpty():
        return linked(dealt, ["key"], fps, node, radius)
    parts = busy.select("key", F.ceil(F.col("count") * 2 / chunk).cast("long").alias("parts"))
    return linked(in_parts(dealt.join(broadcast_if_small(parts), "key", "left"), node), ["key", "a", "b"], fps, node, radius)


def in_parts(rows: DataFrame, node: str) -> DataFrame:
    """Each row once for every two parts of its group (a, b) of which one is its own; ``parts``
    is the number of parts, null for one."""
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(node), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("own", "other", "parts")


def edges(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links among distinct fingerprints (column fp): a spanning set, not all pairs."""
    intact = shared_blocks(fps.count(), radius)
    dealt = fps.select(F.explode(block_keys(F.col("fp"), radius, intact)).alias("key"), "fp", F.col("fp").alias("node"))
    return links_within(dealt, ["fp"], "node", radius, chunk)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: the smallest doc_id reachable by links, and
    a fingerprint that names the component."""
    base = cut(with_simhash(docs.select("doc_id", "text"), "fp", width).select("doc_id", "fp"))
    reps = cut(base.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    return named_by_least(base, reps, roots(edges(reps.select("fp"), radius)))


def named_by_least(base: DataFrame, reps: DataFrame, rooted: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row of ``base`` (doc_id, fp): a fingerprint that
    names its component, and the smallest id there, from ``reps`` (fp, rep) and the roots of those
    that have links."""
    member = cut(rooted.withColumnRenamed("node", "fp").join(reps.select("fp", "rep"), "fp"))
    least = member.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    label = join_facts(member, least, "root").select("fp", "root", "least")
    named = cut(reps.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id")))
    return base.join(named, "fp", "left").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, mark) -> DataFrame:
    """``docs`` with one row of each group in ``found`` (doc_id, fp, root, component_id): the one
    with the smallest id. ``mark`` adds a row's fp as a column.

    Rows without an id stay only where no row of their group has one, and then one of them.
    """
    # Ids that repeat, or are null, don't tell which of their rows is meant.
    own, fp, root, component = (unused(docs, c) for c in ("own", "fp", "root", "component"))
    odd = cut(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(own)))
    same = F.col("doc_id").eqNullSafe(F.col(own))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    if odd.isEmpty():
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)
    some = broadcast_if_small(odd)
    single = docs.join(some, same, "left_anti").join(broadcast_if_small(gone), "doc_id", "left_anti")
    named = found.join(some, same, "left_semi").select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component)).distinct()
    repeated = mark(docs.join(some, same, "left_semi"), fp).join(named, fp)
    first = repeated.where(F.col("doc_id") == F.col(component)).dropDuplicates([root])
    nameless = repeated.where(F.col(component).isNull()).dropDuplicates([root])
    return single.select(docs.columns).unionByName(first.select(docs.columns)).unionByName(nameless.select(docs.columns))
