"""Fingerprints of texts: hashes, shingle sketches, simhash, exact groups and the similarity of sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vellumq.functions.text import let
from vellumq.session import cut, spread

#: Words of a shingle, least words of a text, hashes of a sketch.
SHINGLE, LEAST, SKETCH = 5, 10, 256


def words(text: Column) -> Column:
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(tokens: Column) -> Column:
    """Different runs of five words; none for texts of less than ten words."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= LEAST, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))

    return let(tokens, runs)


def sketch(tokens: Column, hasher=F.xxhash64, most: int | None = SKETCH) -> Column:
    """The smallest hashes of the shingles, in order; all of them if ``most`` is none."""
    hashes = F.array_sort(F.array_distinct(F.transform(shingles(tokens), lambda s: hasher(s))))
    return hashes if most is None else F.slice(hashes, 1, most)


def sketch_similarity(a: Column, b: Column, most: int = SKETCH) -> Column:
    """Similarity from two sketches: exact when both are whole sets, else over the smallest hashes of the union."""
    union = F.array_sort(F.array_union(a, b))
    whole = (F.size(a) < most) & (F.size(b) < most)
    both = F.array_intersect(a, b)
    low = F.slice(union, 1, most)
    return F.when(F.size(union) == 0, 0.0).when(whole, F.size(both) / F.size(union)).otherwise(F.size(F.array_intersect(low, both)) / F.size(low))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, md5, sha256, size, n_shingles`` of each text; null texts give no row, repeated rows of an id count once."""
    t = F.col(text_col)
    x = df.where(t.isNotNull()).select(F.col(id_col).alias("id"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.octet_length(t).alias("size"), F.size(shingles(words(t))).alias("n_shingles"))
    return x.dropDuplicates(["id"])


@F.pandas_udf(LongType())
def simhash(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit simhash of arrays of 64-bit hashes: a bit is set if more than half have it."""
    shifts = np.arange(64, dtype=np.uint64)
    for s in hashes:
        out = []
        for a in s:
            h = np.asarray(a if a is not None else [], np.int64).view(np.uint64)
            total = np.zeros(64, np.int64)
            for at in range(0, len(h), 4096):
                total += ((h[at : at + 4096, None] >> shifts) & np.uint64(1)).sum(axis=0).astype(np.int64)
            bits = np.uint64(0)
            for k in np.flatnonzero(2 * total > len(h)):
                bits |= np.uint64(1) << np.uint64(k)
            out.append(int(bits.astype(np.int64)) if len(h) else 0)
        yield pd.Series(out, dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def exact_groups(prints: DataFrame) -> DataFrame:
    """Groups of equal texts: ``sha256, size, n, first_id``; counted with partial sums, ids are never gathered."""
    return prints.groupBy("sha256", "size").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def report(prints: DataFrame) -> DataFrame:
    """One row: ``total, unique_texts, groups, wasted_bytes``."""
    g = prints.groupBy("sha256", "size").agg(F.count("*").alias("n"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_texts"), F.count(F.when(F.col("n") > 1, 1)).alias("groups"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted_bytes"),
    )


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, hasher=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members ``id, rep`` and pairs ``a < b, similarity`` of representatives whose sketches are that similar.

    Texts with equal sketches have one representative, the smallest id. Two sketches can reach the threshold only if they share one of their rarest
    ``n - ceil(threshold * n) + 1`` hashes, so candidates come from an equi-join on those; hashes that one class alone has are left out
    first. The similarity is that of the sketches, rounded to four digits. Texts of less than ten words and nulls are in neither;
    repeated rows of an id count once.
    """
    texts = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    x = texts.select("id", sketch(words(F.col("t")), hasher).alias("s")).where(F.size("s") > 0)
    x = cut(x.dropDuplicates(["id"]).withColumn("key", F.xxhash64("s")))
    classes = cut(x.groupBy("key", "s").agg(F.min("id").alias("rep")))
    members = x.select("id", "key", "s").join(classes, ["key", "s"]).select("id", "rep")
    each = classes.select("rep", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    # the place of a hash in the order by rarity: hashes of one class alone come first and lead nowhere
    order = each.join(shared, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("m", "h"))).alias("o"))
    room = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("o"))
    front = order.where(room > 0).select("rep", F.explode(F.slice("o", F.lit(1), room.cast("int"))).alias("x")).select("rep", "x.h")
    one, two = front.select("h", F.col("rep").alias("a")), front.select("h", F.col("rep").alias("b"))
    could = one.join(two, "h").where("a < b").select("a", "b").distinct()
    both = could.join(classes.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    scored = both.select("a", "b", sketch_similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return members, scored.withColumn("similarity", F.round("similarity", 4))
