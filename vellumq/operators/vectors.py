"""Dense vectors: cosine search, chunks of texts, context for answers, and a hashing encoder."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from math import sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine of a vector column and a query; null for vectors of another length or of length zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sqrt(sum(float(x) ** 2 for x in query))
    own = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == len(query)) & (own > 0) & F.lit(norm > 0), dot(a, q) / (own * (norm or 1.0)))


def top_k(vectors: DataFrame, query: list[float], k: int = 20, least: float = 0.3, where: Column | None = None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``id, score`` of the k most similar vectors with at least ``least``; a top-k of each partition, then one merge."""
    x = vectors if where is None else vectors.where(where)
    return x.select(F.col(id_col).alias("id"), cosine(F.col(col), query).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def top_k_many(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``query, id, score``: the k best vectors for each query of a block, itself left out.

    Blocks of vectors are multiplied with the queries in numpy; each batch keeps k rows per query.
    """
    ids = np.array([i for i, _ in queries], np.int64)
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi, qv = shared.value
        for b in batches:
            b = b[b["v"].map(lambda v: v is not None and len(v) == qv.shape[1])]
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy()).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            own = b["id"].to_numpy()
            s = qv @ v.T
            s[qi[:, None] == own[None, :]] = -2
            n = min(k, s.shape[1])
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out = pd.DataFrame({"query": np.repeat(qi, n), "id": own[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})
            yield out[out["score"] > -2]

    best = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(col).alias("v")).mapInPandas(run, "query bigint, id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2000, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """:func:`top_k_many` for all rows of ``queries`` against all vectors; blocks of queries go to the tasks one after the other."""
    out, some = None, []

    def flush() -> None:
        nonlocal out
        part = top_k_many(vectors, some.copy(), k, id_col, col)
        out = part if out is None else out.unionByName(part)
        some.clear()

    width = None
    for r in queries.select(id_col, col).where(F.col(col).isNotNull()).toLocalIterator():
        width = width or len(r[col])
        if len(r[col]) == width:
            some.append((r[id_col], r[col]))
        if len(some) == block:
            flush()
    if some or out is None:
        flush()
    return out


def chunk_text(text: str | None, size: int = 80, overlap: int = 15) -> list[str]:
    """Chunks of whole sentences up to ``size`` words; a chunk repeats trailing sentences of up to ``overlap`` words; longer sentences are cut with that stride."""
    sentences = [w for s in re.split(r"(?<=[.!?…])\s+|\n+", text or "") if (w := s.split())]
    out: list[str] = []
    for long, group in groupby(sentences, key=lambda w: len(w) > size):
        if long:
            out += [" ".join(w[a : a + size]) for w in group for a in range(0, len(w) - overlap, size - overlap)]
            continue
        some = list(group)
        ends = list(accumulate(map(len, some), initial=0))  # words before each sentence
        first = last = 0
        while last < len(some):
            last = bisect_right(ends, ends[first] + size) - 1
            out.append(" ".join(" ".join(w) for w in some[first:last]))
            if last < len(some):  # the next chunk begins so far back as the overlap and its first new sentence allow
                first = bisect_left(ends, max(ends[last] - overlap, ends[last + 1] - size))
    return out


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 80, overlap: int = 15) -> DataFrame:
    """``chunk_id, doc_id, chunk_index, chunk_count, text``; texts without words give none, repeated rows of an id count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}_chunk_{k}", i, k, len(cs), c) for i, t in zip(b["id"], b["t"]) for cs in [chunk_text(t, size, overlap)] for k, c in enumerate(cs)]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_index", "chunk_count", "text"])

    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    return x.mapInPandas(run, "chunk_id string, doc_id bigint, chunk_index int, chunk_count int, text string").dropDuplicates(["chunk_id"])


def encode(text: str | None, width: int = 64) -> list[float]:
    """A hashed bag of character trigrams of words, of length one: a stand-in where no model is installed."""
    v = np.zeros(width)
    for w in re.findall(r"\w+", (text or "").lower().replace("ё", "е")):
        s = f" {w} "
        for i in range(len(s) - 2):
            h = xxhash.xxh32_intdigest(s[i : i + 3])
            v[h % width] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(encode)


def replace_document(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with all chunks of the documents in ``fresh`` replaced."""
    return store.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").select(*store.columns).unionByName(fresh.select(*store.columns))


def context(scored: DataFrame, k: int = 5, per_doc: int = 3, most_chars: int = 6000) -> DataFrame:
    """Chunks for an answer from ``chunk_id, doc_id, text, score``: at most ``per_doc`` of a document, the k best, as many as fit into ``most_chars``."""
    by_doc = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id")
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(2 * k).withColumn("r", F.row_number().over(by_doc)).where(F.col("r") <= per_doc).orderBy(F.desc("score"), "chunk_id").limit(k)
    order = Window.partitionBy().orderBy(F.desc("score"), "chunk_id")  # k rows
    x = top.withColumn("number", F.row_number().over(order)).withColumn("before", F.sum(F.char_length("text")).over(order) - F.char_length("text"))
    room = F.lit(most_chars) - F.col("before")
    return x.where((room >= 200) | (F.col("number") == 1)).select("number", "chunk_id", "doc_id", "score", _shortened(F.col("text"), room).alias("text"))


def store_stats(chunked: DataFrame) -> DataFrame:
    return chunked.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"))


def delete_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks of all documents but those of ``gone`` (column doc_id)."""
    return chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*chunks.columns)


def _shortened(text: Column, room: Column) -> Column:
    """A text, or what of it fits up to the end of a word (of any character where there is no white space)."""
    part = F.substring(text, F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    words = F.regexp_extract(part, r"(?s)^(.*\S)\s", 1)
    return F.when(F.char_length(text) <= room, text).when(words != "", words).otherwise(part)
