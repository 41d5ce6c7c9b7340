"""Ingest: Markdown to sections, tables and overlapping chunks.

What carries on through a manual (headings over lines and files, numbers of chunks, the overlap from the chunk
before) is worked out in two passes over ranges of it: each range is summed up, the short summaries are
put together in order, and each range starts from what comes before it. So a manual is
dealt to many tasks. ``initial`` is the state that earlier files of a manual have left.

Files without a manual are left out. Files of one name in a manual follow one another in an order of their
own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.config import Chunking
from gneiss.functions import models, text
from gneiss.functions.frames import scratch
from gneiss.functions.vectors import PLACES, neighbour_cosines

LEVELS = 6
#: Lines, sections and chunks in a range, about.
LINE_RANGE, SECTION_RANGE, CHUNK_RANGE = 8192, 512, 2048
#: Texts whose recursive pieces are held at once.
TEXTS = 256
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*$"
SENTENCE = re.compile(text.SENTENCE_END)
# What a table is, and the separators of recursive splitting in order.
TABLE = r"(?i)(<table(?:\s+[^>]*)?>[\s\S]*?</table>)"
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "；", ";", " ", ""]


def in_order(files: DataFrame) -> DataFrame:
    """(manual, source_file, file_ord, text) of files with any text, numbered by their natural order.

    Only names are numbered in one place, texts stay where they are.
    """
    named = files.where("manual is not null").where(F.rlike("text", F.lit(r"\S"))).select("manual", "source_file", "text", F.xxhash64("text").alias("hash"))
    keys = ["manual", "source_file", "hash"]
    names = named.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("manual").orderBy(text.natural_key(F.col("source_file")), "source_file", "hash").rowsBetween(Window.unboundedPreceding, -1)
    start = names.select(F.col("manual").alias("m"), F.col("source_file").alias("f"), F.col("hash").alias("h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    met = named.withColumn("same", same).join(start, (F.col("manual") == F.col("m")) & F.col("source_file").eqNullSafe(F.col("f")) & (F.col("hash") == F.col("h")))
    return met.select("manual", "source_file", (F.col("start") + F.col("same")).alias("file_ord"), "text")


def _marked(ordered: DataFrame, line_range: int | None) -> DataFrame:
    """Lines with the level and title of headings, the range of its file that each is in, and whether it is the first there."""
    size = line_range or LINE_RANGE
    lines = ordered.select("manual", "source_file", "file_ord", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line", "value"))
    level = F.length(F.regexp_extract("value", HEADING, 1))
    title = F.when(F.startswith("value", F.lit("#")), F.regexp_extract("value", HEADING, 2)).otherwise("")
    return lines.withColumns({"level": F.when(title != "", level).otherwise(0), "title": title, "range": F.floor(F.col("line") / size), "starts": F.col("line") % size == 0})


def _head(k: int) -> Column:
    """What a line does to the heading of level k: a higher one clears it with an empty title."""
    return F.when(F.col("level") == k, F.col("title")).when((F.col("level") > 0) & (F.col("level") < k), "")


def _heads_before(marked: DataFrame, initial: DataFrame | None) -> DataFrame:
    """(manual, file_ord, range, before, own, sections): headings that stand before each range, what it sets
    itself, and how many sections its file has had. Of other lines than headings only the first of a range is looked at."""
    few = marked.where((F.col("level") > 0) | F.col("starts")).select("manual", "file_ord", "range", "line", "level", "title")
    sums = few.groupBy("manual", "file_ord", "range").agg(
        F.array(*[F.max_by(_head(k), F.when(_head(k).isNotNull(), F.col("line"))) for k in range(1, LEVELS + 1)]).alias("own"), F.count_if(F.col("level") > 0).alias("n")
    )
    so_far = Window.partitionBy("manual").orderBy("file_ord", "range").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("manual", "file_ord").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.withColumns({f"b{k}": F.last(F.get("own", F.lit(k - 1)), ignorenulls=True).over(so_far) for k in range(1, LEVELS + 1)} | {"sections": F.coalesce(F.sum("n").over(in_file), F.lit(0))})
    before = [F.col(f"b{k}") for k in range(1, LEVELS + 1)]
    if initial is not None:
        found = found.join(initial.select("manual", "heads"), "manual", "left")
        before = [F.coalesce(b, F.get("heads", F.lit(k))) for k, b in enumerate(before)]
    return found.select("manual", "file_ord", "range", F.array(*before).alias("before"), "own", "sections")


def sections(files: DataFrame, max_path: int = 150, initial: DataFrame | None = None, line_range: int | None = None) -> DataFrame:
    """(manual, source_file, file_ord, section, chapter_path, text) from (manual, source_file, text).

    A heading starts a section and stays in its text. Headings carry on over files in natural
    order: a new one drops those of its level and below.
    """
    marked = _marked(in_order(files), line_range)
    so_far = Window.partitionBy("manual", "file_ord", "range").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    local = {f"h{k}": F.last(_head(k), ignorenulls=True).over(so_far) for k in range(1, LEVELS + 1)} | {"inside": F.sum((F.col("level") > 0).cast("int")).over(so_far)}
    placed = marked.withColumns(local).join(_heads_before(marked, initial), ["manual", "file_ord", "range"]).withColumn("section", F.col("sections") + F.col("inside"))
    path = text.breadcrumb(F.array(*[F.coalesce(F.col(f"h{k}"), F.get("before", F.lit(k - 1))) for k in range(1, LEVELS + 1)]), max_path)
    return (
        placed.groupBy("manual", "source_file", "file_ord", "section")
        .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"), F.max_by(path, "line").alias("chapter_path"))
        .select("manual", "source_file", "file_ord", "section", "chapter_path", text.stripped(F.array_join(F.transform("lines", lambda x: x["value"]), "\n")).alias("text"))
        .where("text <> ''")
    )


def heads_after(files: DataFrame, initial: DataFrame | None = None, line_range: int | None = None) -> DataFrame:
    """(manual, source_file, heads): the headings that stand at the end of each file."""
    ordered = in_order(files)
    before = _heads_before(_marked(ordered, line_range), initial)
    last = before.groupBy("manual", "file_ord").agg(F.max_by(F.transform(F.arrays_zip("own", "before"), lambda x: F.coalesce(x["own"], x["before"])), "range").alias("heads"))
    return last.join(ordered.select("manual", "file_ord", "source_file"), ["manual", "file_ord"]).groupBy("manual", "source_file").agg(F.max_by("heads", "file_ord").alias("heads"))


def pieces(secs: DataFrame) -> DataFrame:
    """Sections cut into whole tables and the texts between, in order (piece, chunk_type, text)."""
    tables = F.regexp_extract_all("text", F.lit(TABLE), F.lit(1))
    texts = F.split("text", TABLE, -1)
    both = F.flatten(
        F.transform(
            F.arrays_zip(texts.alias("p"), tables.alias("t")),
            lambda z: F.array(F.struct(F.lit("text").alias("chunk_type"), text.stripped(z["p"]).alias("text")), F.struct(F.lit("table").alias("chunk_type"), F.trim(z["t"]).alias("text"))),
        )
    )
    kept = F.filter(both, lambda x: x["text"].isNotNull() & (x["text"] != ""))
    cols = [c for c in secs.columns if c != "text"]
    return secs.select(*cols, F.posexplode(kept).alias("piece", "x")).select(*cols, "piece", "x.chunk_type", "x.text")


def split_recursive(value: str, size: int = 900, overlap: int = 150, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs.

    Parts are packed greedily; each piece starts with as many of the last parts of the one
    before as fit into ``overlap``; what is too long is cut at the next separator.
    """
    options = SEPARATORS if separators is None else separators
    chosen = next((i for i, s in enumerate(options) if s == "" or s in value), len(options) - 1)
    mark, finer = options[chosen], options[chosen + 1 :]
    parts = list(value) if mark == "" else [p + mark for p in value.split(mark)[:-1]] + value.split(mark)[-1:]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def close():
        done = "".join(window).strip()
        if done:
            out.append(done)

    for part in parts:
        if len(part) > size and finer:
            close()
            window, held = [], 0
            out += split_recursive(part, size, overlap, finer)
            continue
        if held + len(part) > size and window:
            close()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    close()
    return out


def pieces_in_turn(batches: Iterator[pd.Series], size: int, overlap: int) -> Iterator[pd.Series]:
    """Recursive pieces of each text, given out for ``TEXTS`` texts at a time."""
    for values in batches:
        for lo in range(0, len(values), TEXTS):
            yield values.iloc[lo : lo + TEXTS].map(lambda v: split_recursive(v or "", size, overlap))


def recursive_chunks(size: int = 900, overlap: int = 150):
    """Array of recursive pieces as a vectorised function."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return pieces_in_turn(batches, size, overlap)

    return split


def breaks(values: list[str], embed, percentile: float, batch: int) -> list[int]:
    """Where chunks of sentences start: at the first, and after each gap that is wider than the percentile."""
    if not values:
        return []
    gaps = np.empty(len(values) - 1)
    last = None
    for lo in range(0, len(values), batch):
        vectors = np.asarray(embed(values[lo : lo + batch]), float)
        held = vectors if last is None else np.vstack([last, vectors])
        gaps[max(0, lo - 1) : lo + len(vectors) - 1] = np.round(1 - neighbour_cosines(held), PLACES)
        last = vectors[-1:]
    if not len(gaps):
        return [0]
    ordered, place = np.sort(gaps), (len(gaps) - 1) * percentile
    low, high = int(np.floor(place)), int(np.ceil(place))
    bar = ordered[low] if ordered[low] == ordered[high] else (high - place) * ordered[low] + (place - low) * ordered[high]
    return [0, *(np.flatnonzero(gaps > bar) + 1).tolist()]


def semantic_chunks(rows: DataFrame, settings: Chunking | None = None, backend=None, key: str = "piece_id") -> DataFrame:
    """(key, chunk, text): sentences cut where neighbours are further apart than the percentile.

    ``rows`` has the key and ``text``; a row is cut by itself, whatever other rows have its key. Distances are
    cosine distances of the backend's vectors, which stay in the task: only the places of cuts come back, and nothing
    is shuffled.
    """
    settings = settings or Chunking()
    embed = backend or models.hash_embedder()
    percentile, batch = settings.cut_percentile, settings.batch

    def starts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for lo in range(0, len(values), TEXTS):
                yield pa.array([breaks(v or [], embed, percentile, batch) for v in values.slice(lo, TEXTS).to_pylist()], pa.list_(pa.int32()))

    parted = rows.select(key, text.sentences(F.col("text")).alias("s"))
    cut = parted.withColumn("starts", F.arrow_udf(starts, "array<int>")(F.transform("s", lambda x: text.clean_for_embedding(x))))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("s")))
    texts = F.transform(F.arrays_zip("starts", ends.alias("ends")), lambda x: F.array_join(F.slice("s", x["starts"] + 1, x["ends"] - x["starts"]), " "))
    return cut.where(F.size("s") > 0).select(key, F.posexplode(texts).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


def trimmed(texts: Column, target: int) -> Column:
    """The last of some text chunks (ord, first, text, chars) that together have ``target`` characters of sentences."""

    def take(acc, x):
        return F.when(acc["n"] >= target, acc).otherwise(F.struct(F.concat(F.array(x), acc["kept"]).alias("kept"), (acc["n"] + x["chars"]).alias("n")))

    start = F.struct(F.array().cast("array<struct<ord: bigint, first: boolean, text: string, chars: bigint>>").alias("kept"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.reverse(texts), start, take)["kept"]


def tails(chunks: DataFrame, by: str, target: int) -> DataFrame:
    """(manual, by, tail): of each range the last text chunks, as many as an overlap can reach into.

    An overlap is made of whole sentences at the end that have ``target`` characters, whatever stands before
    them; a chunk boundary ends a sentence. So what comes after depends on no more than this. Each text chunk has a
    character at least, so the sentences of the last ``target`` ones alone are counted.
    """
    last = Window.partitionBy("manual", by).orderBy(F.desc("ord"))
    near = chunks.where("chunk_type <> 'table'").withColumn("back", F.row_number().over(last)).where(F.col("back") <= target)
    chars = F.aggregate(text.sentences(F.col("text")), F.lit(0).cast("bigint"), lambda n, s: n + F.length(s))
    texts = near.select("manual", by, F.col("ord").cast("bigint").alias("ord"), "first", "text", chars.alias("chars"))
    after = Window.partitionBy("manual", by).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    last = texts.withColumn("after", F.coalesce(F.sum("chars").over(after), F.lit(0))).where(F.col("after") < target)
    return last.groupBy("manual", by).agg(F.array_sort(F.collect_list(F.struct("ord", "first", "text", "chars"))).alias("tail"))


def file_tails(chunks: DataFrame, target: int) -> DataFrame:
    """(manual, source_file, tail) of files that have any text chunk."""
    names = chunks.select("manual", "file_ord", "source_file").distinct()
    return tails(chunks, "file_ord", target).join(names, ["manual", "file_ord"]).groupBy("manual", "source_file").agg(F.max_by("tail", "file_ord").alias("tail"))


def with_prefixes(chunks: DataFrame, target: int = 250, initial: DataFrame | None = None, chunk_range: int | None = None) -> DataFrame:
    """Chunks of manuals with the overlap from the text chunk before, as ``content``.

    ``chunks`` has manual, ord (place within the manual, from 1), chunk_type, first (first chunk of its
    piece) and text. Tables neither take nor give an overlap. A chunk inside a piece takes it
    from the plain chunk before; a piece's first chunk from the chunk before with its prefix.

    Each range of a manual gets the tail of what is before it (``tails``; of ``initial`` too, which has
    manual and tail) and runs through its own chunks in order.
    """
    ranged = chunks.withColumn("range", F.floor((F.col("ord") - 1) / (chunk_range or CHUNK_RANGE)).cast("bigint"))
    own = tails(ranged, "range", target)
    if initial is not None:
        own = own.unionByName(initial.where(F.size("tail") > 0).select("manual", F.lit(-1).cast("bigint").alias("range"), F.transform("tail", lambda x: x.withField("ord", x["ord"] - (1 << 60))).alias("tail")))
    # Every tail has a character at least.
    before = Window.partitionBy("manual").orderBy("range").rowsBetween(-target, -1)
    gathered = own.select("manual", "range", F.flatten(F.collect_list("tail").over(before)).alias("held"))
    handed = gathered.select("manual", "range", F.explode(trimmed(F.col("held"), target)).alias("t"))
    halo = handed.select("manual", "range", "t.ord", F.lit("text").alias("chunk_type"), "t.first", "t.text", F.lit(True).alias("halo"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("content", T.StringType())])
    names = [f.name for f in ranged.schema.fields]

    def carry(frame):
        frame = frame.sort_values("ord")
        out, plain, final = [], "", ""
        for kind, first, value in zip(frame["chunk_type"], frame["first"], frame["text"], strict=True):
            if kind == "table":
                out.append(value)
                continue
            prefix = prefix_of(final if first else plain, target)
            plain, final = value, f"{prefix}\n{value}" if prefix else value
            out.append(final)
        return frame.assign(content=out)[~frame["halo"].astype(bool)][[*names, "content"]]

    # Columns that the pass doesn't need are filled, since pandas has no null numbers.
    filled = {f.name: F.lit(0 if isinstance(f.dataType, T.NumericType) else None).cast(f.dataType) for f in ranged.schema.fields if f.name not in halo.columns}
    both = ranged.withColumn("halo", F.lit(False)).unionByName(halo.withColumns(filled))
    return both.groupBy("manual", "range").applyInPandas(carry, schema).drop("range")


def prefix_of(previous: str, target: int) -> str:
    """The same prefix as the expression ``overlap_prefix``, for the ordered pass: the fewest last
    sentences that together have ``target`` characters."""
    # Of a long text its end is enough, if the sentences behind the one that is cut there have as many characters.
    parts = [s for s in map(str.strip, SENTENCE.split(previous[-2 * target :])[1:]) if s] if len(previous) > 2 * target else []
    if sum(map(len, parts)) < target or target <= 0:
        parts = [s for s in map(str.strip, SENTENCE.split(previous)) if s]
    upto = list(accumulate(map(len, reversed(parts)), initial=0))
    joined = " ".join(parts[max(0, len(parts) - bisect_left(upto, target)) :])
    return joined if not joined or joined.endswith(tuple("。！？.!?")) else f"{joined}。"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with chunk_index (place in the file, from 0), ord (place in the manual, from 1) and first."""
    grouped = rows.withColumn("group", F.floor(F.col("section") / SECTION_RANGE))
    sizes = grouped.groupBy("manual", "file_ord", "group").agg(F.count("*").alias("n"))

    def before(*part):
        rest = [c for c in ("file_ord", "group") if c not in part]
        return F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    base = sizes.select("manual", "file_ord", "group", before("manual", "file_ord").alias("in_file"), before("manual").alias("in_manual"))
    inside = F.row_number().over(Window.partitionBy("manual", "file_ord", "group").orderBy("section", "piece", "chunk", "sub"))
    met = grouped.withColumn("inside", inside).join(base, ["manual", "file_ord", "group"])
    found = met.withColumns({"ord": F.col("in_manual") + F.col("inside"), "chunk_index": (F.col("in_file") + F.col("inside") - 1).cast("int"), "first": (F.col("chunk") == 0) & (F.col("sub") == 0)})
    return found.drop("group", "inside", "in_file", "in_manual")


def plain_chunks(files: DataFrame, settings: Chunking | None = None, kind: str = "recursive", backend=None, initial: DataFrame | None = None) -> DataFrame:
    """Numbered chunks of ``files`` without overlaps. They are written, since several passes read them."""
    settings = settings or Chunking()
    secs = sections(files.withColumn("manual", F.col("manual").cast("string")), settings.max_path, initial)
    parts = pieces(secs).withColumn("piece_id", F.concat_ws("|", "manual", "source_file", F.col("file_ord").cast("string"), F.col("section").cast("string"), F.col("piece").cast("string")))
    split = recursive_chunks(settings.size, settings.overlap)
    if kind == "semantic":
        texts = semantic_chunks(parts.where("chunk_type = 'text'"), settings, backend).withColumnRenamed("text", "piece_text")
        made = parts.join(texts, "piece_id", "left").withColumn("text", F.coalesce("piece_text", "text")).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
        subs = F.when((F.col("chunk_type") == "text") & (F.length("text") > settings.max_safe), split("text")).otherwise(F.array("text"))
    else:
        made = parts.withColumn("chunk", F.lit(0))
        subs = F.when(F.col("chunk_type") == "text", split("text")).otherwise(F.array("text"))
    base = ["manual", "source_file", "file_ord", "section", "chapter_path", "piece", "chunk", "chunk_type"]
    rows = made.select(*base, F.posexplode(subs).alias("sub", "text"))
    path = scratch(files.sparkSession)
    rows.write.parquet(path)
    return numbered(files.sparkSession.read.schema(rows.schema).parquet(path))


def finished(chunks: DataFrame, settings: Chunking, initial: DataFrame | None = None) -> DataFrame:
    """``plain_chunks`` with their overlaps, as chunk_id, source_file, chunk_type, chunk_index, chapter_path, content."""
    out = with_prefixes(chunks, settings.prefix, initial)
    return out.select(text.chunk_id(F.col("source_file"), F.col("chunk_index")).alias("chunk_id"), "source_file", "chunk_type", "chunk_index", "chapter_path", "content")


def chunked(files: DataFrame, settings: Chunking | None = None, kind: str = "recursive", backend=None, initial: DataFrame | None = None) -> DataFrame:
    """All of ingest but the vectors: chunk_id, source_file, chunk_type, chunk_index, chapter_path, content."""
    settings = settings or Chunking()
    return finished(plain_chunks(files, settings, kind, backend, initial), settings, initial)


def ingest(files: DataFrame, settings: Chunking | None = None, kind: str = "recursive", backend=None) -> DataFrame:
    """Chunks with vectors, ready to be merged."""
    settings = settings or Chunking()
    return models.with_embedding(chunked(files, settings, kind, backend), backend, batch=settings.batch)


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.col("chunk_type") == "table").alias("tables"), F.count_if(F.col("chunk_type") == "text").alias("texts"))


def path_of(meta: Column) -> Column:
    """Breadcrumb of a map from H1, H2, ... to titles."""
    return text.breadcrumb(F.array(*[F.trim(F.element_at(meta, F.lit(f"H{k}"))) for k in range(1, LEVELS + 1)]))
