"""Best-fit-decreasing packing into fixed-length sequences.

Every text becomes token ids with an end token. Texts longer than a sequence are cut into whole
sequences, the first piece taking what is left over; nothing else is cut. Pieces are then placed in
decreasing order of length, each in the sequence with the least room that still holds it. That
sequence is found by a segment tree over the room left (``SpaceTree``), in time logarithmic in the
sequence's length.

Pieces of one length are alike to this heuristic, and so are sequences with the same room. What the
heuristic does to a whole corpus therefore follows from the counts of pieces by length, at most
``length`` numbers: ``fit`` works it out once, for runs of equal pieces instead of single ones, with
exactly the outcome of placing them one by one. Spark does the rest: tasks tokenise and number their
pieces of each length, a window adds up these numbers over the tasks, and every piece looks its place
up in the plan. Neither tokens nor pieces pass the driver, and no task gets more than it reads.

Defined results: a null text is an empty one, which still has its end token; repeated rows, null ids
included, are packed each on its own; an empty table gives no piece; very long texts are encoded
whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import cut
from gneiss.llm.packing import LENGTH, load_encoder

END_ID = 0
#: Bits of a place's key that number the pieces of one length.
RANK_BITS = 44


class SpaceTree:
    """Sequences by the room they have left, over which a binary tree of flags stands.

    Sequences with the same room are kept as ranges of their numbers.
    """

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.leaves
        self.some[at] = bool(self.ranges[room])
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def add(self, room: int, first: int, end: int) -> None:
        if first < end:
            self.ranges[room].append((first, end))
            self._mark(room)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(room, first, end) of a range with the least room of at least ``need``; it leaves the tree."""
        at = need + self.leaves
        while not self.some[at]:
            while at & 1:  # the subtree to the right of the nearest ancestor that has one
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        first, end = self.ranges[room].pop()
        self._mark(room)
        return room, first, end


def fit(counts: dict[int, int], length: int) -> np.ndarray:
    """Places of ``counts[size]`` pieces of each size: rows of (size, rank, sequence, per, offset).

    From the piece numbered ``rank`` of its size on, ``per`` pieces in a row stand in ``sequence``, the
    next ``per`` in the one after it, and so on; the first of each begins at ``offset``.
    """
    tree, rows, fresh = SpaceTree(length), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            per = length // size
            room, first, end = tree.take(size) or (length, fresh, fresh + -(-left // per))
            fresh = max(fresh, end)
            per = min(left, room // size)
            full = min(end - first, left // per)
            rows.append((size, rank, first, per, length - room))
            tree.add(room - per * size, first, first + full)
            tree.add(room, first + full, end)
            rank, left = rank + full * per, left - full * per
    return np.array(rows, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): the pieces of ``docs`` (doc_id, text).

    ``ids`` holds little-endian unsigned 32-bit integers. ``nth`` numbers the pieces of a length in a
    task. The table is written, since the numbers have to last.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, task = load_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, owners = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                ends = range((len(ids) - 1) % length + 1, len(ids) + 1, length)
                for piece, end in enumerate(ends):
                    start = max(0, end - length) if piece else 0
                    size = end - start
                    rows.append((piece, start, size, ids[start:end].tobytes(), task, int(seen[size])))
                    seen[size] += 1
                    owners.append(at)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            arrays = [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, task bigint, nth bigint"))


def placed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces``, with (task, length, nth) and any further columns, with ``sequence_id`` and ``offset``
    instead of ``task`` and ``nth``. Columns that aren't needed are best dropped before, as rows are
    shuffled once."""
    counted = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most `length` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = fit(counts, length)
    keys = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (size.to_numpy() << RANK_BITS) + rank.to_numpy(), "right") - 1
        _, first, sequence, per, offset = plan[at].T
        bins, inside = np.divmod(rank.to_numpy() - first, per)
        return pd.DataFrame({"sequence_id": sequence + bins, "offset": offset + inside * size.to_numpy()})

    joined = pieces.join(base, ["task", "length"])
    found = joined.withColumn("place", place("length", F.col("before") + F.col("nth")))
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("task", "nth")]
    return found.select(*kept, "place.sequence_id", "place.offset")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of ``docs``."""
    return placed(token_pieces(docs, tokenizer_path, length, end_id), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): whole sequences, their pieces joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    gathered = packed.groupBy("sequence_id").agg(ordered.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return gathered.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("n_tokens"), ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
