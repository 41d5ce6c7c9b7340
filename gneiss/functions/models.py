"""Pluggable model backends; the defaults run offline and give the same result every time."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.functions.stemming import STOP_WORDS


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors from signed token hashes."""

    def embed(texts):
        import re
        import zlib

        import numpy as np

        found = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        h = np.array([zlib.crc32(w.encode()) for own in found for w in own], np.int64)
        cell = np.repeat(np.arange(len(texts)) * dim, [len(own) for own in found]) + h % dim
        out = np.bincount(cell, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def embedder_chain(backends: list[Callable[[list[str]], list[list[float]]]], width: int | None = None) -> Callable[[list[str]], list[list[float]]]:
    """The first of several backends that answers: a server, say, then the same model in the process.

    A backend that fails, or gives vectors of another number or width, is passed by for that batch; if none is
    left, the last error is raised. All must serve one model, since their vectors end up side by side.
    """

    def embed(texts):
        last: Exception = RuntimeError("no backend")
        for backend in backends:
            try:
                vectors = backend(texts)
            except Exception as e:
                last = e
                continue
            widths = {len(v) for v in vectors}
            if len(vectors) == len(texts) and len(widths) <= 1 and (width is None or widths <= {width}):
                return vectors
            last = ValueError(f"{len(vectors)} vectors of widths {sorted(widths)} for {len(texts)} texts")
        raise last

    return embed


def hub_name(model: str, owner: str = "BAAI") -> str:
    """A model's name on a hub; without an owner it gets the default one."""
    return model if "/" in model else f"{owner}/{model}"


def with_embedding(df, backend: Callable | None = None, source: str = "content", name: str = "embedding", batch: int = 32):
    """``df`` with vectors of the cleaned text, made in batches that load the model once a task."""
    from pyspark.sql import types as T

    backend = backend or hash_embedder()
    plain = df.drop(name)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    kept = plain.select("*", text.clean_for_embedding(F.col(source)).alias("clean"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            texts = whole.column(whole.num_columns - 1).to_pylist()
            vectors = [v for lo in range(0, len(texts), batch) for v in backend(texts[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*whole.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], schema.names)

    return kept.mapInArrow(run, schema)


def pair_scores(query: str, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32):
    """A vectorised function from contents to a cross-scorer's numbers for (query, content) pairs."""
    @F.pandas_udf("double")
    def scored(contents: pd.Series) -> pd.Series:
        pairs = [(query, c) for c in contents]
        return pd.Series([float(x) for lo in range(0, len(pairs), batch) for x in scorer(pairs[lo : lo + batch])], dtype="float64")

    return scored


def grams(word: str) -> frozenset[str]:
    """The three-letter runs of a word between its ends: a word's vector has ones at them."""
    marked = f"<{word}>"
    return frozenset(marked[i : i + 3] for i in range(len(marked) - 2))


def late_interaction(query: str, content: Column) -> Column:
    """Default cross-scorer: for each word of the query the cosine of its vector and that of the text's
    most similar word (``grams``), averaged, as a logit from -4 to 4.

    Inflected words are near to one another, so nothing is stemmed. Stop words of the query don't
    count; a query of such alone, a null and an empty text give -4. A batch's words are compared once each.
    """
    wanted = [grams(w) for w in sorted(set(re.findall(r"[^\W_]+", query.lower())) - STOP_WORDS)]

    @F.pandas_udf("double")
    def scored(words: pd.Series) -> pd.Series:
        import numpy as np

        known: dict[str, int] = {}
        rows = [[known.setdefault(w, len(known)) for w in own] for own in words]
        near = np.zeros((len(known) + 1, len(wanted)))
        for word, at in known.items():
            own = grams(word)
            near[at] = [len(own & q) / (len(own) * len(q)) ** 0.5 for q in wanted]
        return pd.Series([8.0 * float(near[row].max(axis=0).mean()) - 4.0 if row and wanted else -4.0 for row in rows], dtype="float64")

    return scored(F.array_distinct(text.tokens(content)))


#: What the message of an error holds that passes, and of one about quotas.
PASSING = ("429", "503", "504", "unavailable", "timeout", "deadline", "connection", "overloaded", "broken pipe", "remote disconnected", "socket", "capacity")
QUOTA = ("quota", "resource_exhausted", "limit:")


def with_retries(calls: list[Callable[[], str]], attempts: int = 3, pause: float = 1.5, sleep=time.sleep, wait_for_quota: bool = False) -> str:
    """The first text that one of several models gives, asked one after the other.

    A model is asked again, after twice as long each time, while its errors pass by themselves.
    An error about quotas moves on to the next model at once, unless ``wait_for_quota`` counts it
    among those that pass; so does any other. If none answers, the last error is raised.
    """
    last: Exception = RuntimeError("no model")
    for call in calls:
        for n in range(attempts):
            try:
                return call()
            except Exception as e:
                last, said = e, str(e).lower()
                quota = any(w in said for w in QUOTA)
                if quota and not wait_for_quota or not quota and not any(w in said for w in PASSING):
                    break
                if n + 1 < attempts:
                    sleep(pause * 2**n)
    raise last


def with_answer(prompts, models: list[Callable[[str], str]], source: str = "prompt", name: str = "answer", failed: str = "", **how):
    """``prompts`` with the text that the first of several models answers; ``failed`` if none does.

    Models are plain functions, called on the executors, one prompt after the other in each task.
    """
    from pyspark.sql import types as T

    kept = prompts.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        import pyarrow as pa

        def asked(prompt: str) -> str:
            try:
                return with_retries([lambda m=m: m(prompt) for m in models], **how)
            except Exception:
                return failed

        for batch in batches:
            texts = [asked(p or "") for p in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)
