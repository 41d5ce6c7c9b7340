"""Packing into fixed-length sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens, all at once. It is
filled by taking, of the pieces that fit, the one whose demand has the largest dot product with
what the sequence has left (both in shares of the limits). When none fits and cutting is allowed,
the piece with the largest product is cut to fill the rest. Every task packs the rows it reads
from a pool of bounded size, so nothing is shuffled and memory doesn't grow with the table.

A sequence that ends up short is dealt into lengths that are powers of two, which need no
padding. Sequence numbers hold the task's number in the upper bits, so they are unique.

Defined results: a null text is an empty one, which still has its end token; repeated rows are
packed each on its own under the same id; an empty table gives no piece; examples that exceed a
limit alone (without cutting) take a sequence of their own and are marked as such; very long
texts, and such of one single run, are encoded whole by the library that bears them and cut into
as many pieces as they need; further columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame

LENGTH = 2048
MAX_SEGMENTS = 128
END_ID = 1
#: Pieces that a task holds at once before it packs, and those it keeps for mixing.
POOL, KEPT = 2048, 512

#: Texts of these characters alone are split alike by both libraries; the others, and texts with
#: a special token's name, go to the slower one.
SAFE = re.compile("[\\t\\n\\r\\x20-\\x7e¡-¬®-ɏ‐-‧‰-›€]*")
#: The faster library's matcher keeps a state for each character of a run of white space, within
#: a fixed depth; texts with a longer run than this go to the slower one.
LONGEST_SPACE = 10_000
SPACE = re.compile("[\\t\\n\\r ]++")


def long_space(text: str) -> bool:
    """Whether a run of white space is longer than ``LONGEST_SPACE``; takes one pass."""
    return len(text) > LONGEST_SPACE and any(m.end() - m.start() > LONGEST_SPACE for m in SPACE.finditer(text))


def load_encoder(path: str):
    """A function from text to token ids, as the vocabulary file's own library gives them."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(map(_BYTE_OF.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SAFE.fullmatch(text) and not any(s in text for s in special) and not long_space(text):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


# The split of byte-level BPE, and the characters that stand for its bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(_HIDDEN)}


class Pool:
    """Pieces waiting for a place: demands as shares of the limits, one row each."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, float)
        self.demand = np.zeros((0, 3))
        self.pieces: list = []
        self.open: np.ndarray = np.zeros(0, bool)

    def add(self, pieces: list, demands: np.ndarray) -> None:
        alive = self.open
        self.pieces = [p for p, a in zip(self.pieces, alive, strict=True) if a] + pieces
        self.demand = np.concatenate([self.demand[alive], demands])
        self.open = np.ones(len(self.pieces), bool)

    def __len__(self) -> int:
        return int(self.open.sum())

    def fill(self, cut) -> list:
        """Take the pieces of one sequence. ``cut(piece, tokens)`` gives (head, rest, rest's demand)."""
        left, taken = self.limits.copy(), []
        shares = self.demand / self.limits
        while True:
            fits = self.open & (self.demand <= left).all(axis=1)
            if not fits.any():
                break
            at = int(np.where(fits, shares @ (left / self.limits), -1.0).argmax())
            taken.append(self.pieces[at])
            left -= self.demand[at]
            self.open[at] = False
            if not left[0]:
                return taken
        room = int(min(left[0], left[2]))
        if not taken and self.open.any():  # beyond a limit alone
            at = int(np.flatnonzero(self.open)[0])
            self.open[at] = False
            return [self.pieces[at]]
        if cut and room > 0 and left[1] >= 1 and self.open.any():
            at = int(np.where(self.open, shares @ (left / self.limits), -1.0).argmax())
            head, rest, demand = cut(self.pieces[at], room)
            taken.append(head)
            self.pieces[at], self.demand[at] = rest, demand
        return taken


def powers_of_two(pieces: list, total: int, length: int, cut) -> list[list]:
    """Deal a short sequence's pieces out to sequences whose lengths are powers of two."""
    if total == length or cut is None:
        return [pieces]
    out, queue = [], list(pieces)[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, own = total & (1 << bit), []
        while need:
            piece = queue.pop()
            if piece[2] > need:
                piece, rest, _ = cut(piece, need)
                queue.append(rest)
            own.append(piece)
            need -= piece[2]
        if own:
            out.append(own)
    return out


def _cut_ids(piece, tokens):
    doc, start, _, ids, total = piece
    rest = len(ids) - tokens
    return (doc, start, tokens, ids[:tokens], total), (doc, start + tokens, rest, ids[tokens:], total), (rest, 1, rest)


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = END_ID, pool: int = POOL, kept: int = KEPT) -> DataFrame:
    """Tokenised pieces of ``docs`` (doc_id, text) with their places in sequences.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. Every id of a
    document, its end token included, is in exactly one piece. All its tokens bear loss, so
    ``max_loss`` (``length`` by default) limits the same tokens.
    """
    limits = (length, max_segments, max_loss or length)
    most = min(limits[0], limits[2])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = load_encoder(tokenizer_path)
        waiting = Pool(limits)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40

        def placed(sequences):
            nonlocal number
            rows = []
            for taken in sequences:
                at = 0
                for doc, start, size, ids, total in taken:
                    rows.append((doc, start, size, ids.tobytes(), total, number, at))
                    at += size
                number += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def packed(down_to):
            while len(waiting) > down_to:
                taken = waiting.fill(_cut_ids)
                yield from powers_of_two(taken, sum(p[2] for p in taken), length, _cut_ids)

        fresh, whole = [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                total, start = len(ids), 0
                while total - start >= length and most == length:
                    whole.append([(doc, start, length, ids[start : start + length], total)])
                    start += length
                if start < total:
                    fresh.append((doc, start, total - start, ids[start:].copy(), total))
                if len(whole) >= 256:
                    yield placed(whole)
                    whole = []
                if len(fresh) + len(waiting) >= pool:
                    waiting.add(fresh, np.array([(p[2], 1, p[2]) for p in fresh], float).reshape(-1, 3))
                    fresh = []
                    yield placed(packed(kept))
        waiting.add(fresh, np.array([(p[2], 1, p[2]) for p in fresh], float).reshape(-1, 3))
        yield placed(whole)
        yield placed(packed(0))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def with_counts(examples: DataFrame, tokenizer_path: str, text: str, start: str, size: str, tokens: str = "tokens", loss: str = "loss") -> DataFrame:
    """``examples`` with the number of tokens of ``text`` and an end token, and of those that bear
    loss: what stands in ``size`` characters from ``start`` on, the end token included.

    A token that reaches over the edge of the span counts with the span; null spans bear none.
    """
    from pyspark.sql import types as T

    kept = examples.drop(tokens, loss)
    schema = T.StructType([*kept.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(loss, T.LongType())])

    def run(batches):
        import pyarrow as pa

        encode = load_encoder(tokenizer_path)
        for batch in batches:
            at = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, start, size)]
            counts = []
            for value, first, many in zip(*at, strict=True):
                value = value or ""
                whole = len(encode(value)) + 1
                before = len(encode(value[:first])) if many is not None else whole
                after = len(encode(value[first + many :])) if many is not None else 0
                counts.append((whole, max(0, whole - before - after)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], schema.names)

    return kept.mapInArrow(run, schema)


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = LENGTH, pool: int = POOL, kept: int = KEPT) -> DataFrame:
    """Places of whole instruction examples: (key, tokens, loss, sequence_id, offset, fits).

    Null counts are zero. Examples are never cut; one beyond a limit alone has a sequence of
    its own with ``fits`` false.
    """
    limits = (length, max_segments, max_loss)
    chosen = examples.selectExpr(f"`{key}` as key", f"coalesce(`{tokens}`, 0L) as tokens", f"coalesce(`{loss}`, 0L) as loss")
    schema = f"key {chosen.schema['key'].dataType.simpleString()}, tokens bigint, loss bigint, sequence_id bigint, offset bigint, fits boolean"

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        waiting = Pool(limits)
        number = TaskContext.get().partitionId() << 40

        def placed(down_to):
            nonlocal number
            rows = []
            while len(waiting) > down_to:
                at, taken = 0, waiting.fill(None)
                for key_, size, weight in taken:
                    rows.append((key_, size, weight, number, at, size <= length and weight <= max_loss))
                    at += size
                number += 1
            return pd.DataFrame(rows, columns=["key", "tokens", "loss", "sequence_id", "offset", "fits"])

        for frame in batches:
            rows = list(frame.itertuples(index=False, name=None))
            for lo in range(0, len(rows), pool):
                part = rows[lo : lo + pool]
                waiting.add(part, np.array([(t, 1, w) for _, t, w in part], float).reshape(-1, 3))
                yield placed(kept)
        yield placed(0)

    return chosen.mapInPandas(run, schema)
