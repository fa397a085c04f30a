"""Mixing sources to target shares of the total size in tokens.

Each text has a uniform 64-bit hash. Tokens are summed by source and hash bucket (a histogram of fixed size); the budget of
a source is then a hash threshold: all whole buckets below it, and inside the boundary bucket a finer histogram of
the next bits, and so on until the boundary is one text. Thresholds of growing budgets are nested: a larger mixture
holds the smaller one. Rows are filtered against their source's threshold; nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.session import bound_arrow, cut

#: Bits of one histogram level; 60 bits of the hash are used in all.
LEVEL_BITS, ALL_BITS = 12, 60


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> str:
    """The path of a public tokenizer's file, below ``folder`` or where the installed package keeps it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("key"), batch.column("hash"), pa.array(n, pa.int64())], ["doc_id", "source", "key", "hash", "tokens"])

    return work


def source_name(col: str) -> Column:
    """A source without outer white space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.col(col), r"(?U)\s+", " ")))


def sized_texts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, hash, tokens``: each different text once, under its smallest doc_id.

    Null and empty texts and rows without a source are left out. A text that comes under several ids or
    sources counts for the row of the smallest id alone, so that no text is used more often than allowed.
    """
    bound_arrow(docs.sparkSession)
    x = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source_name(source_col).alias("source"), F.col(text_col).alias("text"))
    x = x.where("doc_id is not null and source is not null and length(trim(text)) > 0")
    # the key tells equal texts, the hash picks; both from the text alone, so copies agree
    x = x.select("doc_id", "source", "text", F.md5("text").alias("key"), F.shiftrightunsigned(F.xxhash64("text", F.lit(9)), 64 - ALL_BITS).alias("hash"))
    path = tokenizer or tokenizer_file()
    counted = x.mapInArrow(_count(path), "doc_id bigint, source string, key string, hash bigint, tokens bigint")
    return counted.groupBy("key").agg(F.min_by(F.struct("doc_id", "source", "hash", "tokens"), "doc_id").alias("r")).select("r.*")


def budgets(have: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None) -> dict[str, float]:
    """Tokens that each source is to give: its share among the sources that have texts, of ``total`` or of the most that all can give."""
    usable = {s: w for s, w in shares.items() if w and w > 0 and have.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not usable:
        return {}
    weight = sum(usable.values())
    most = min(have[s] * repeats[s] * weight / w for s, w in usable.items())
    size = most if total is None else min(total, most)
    return {s: size * w / weight for s, w in usable.items()}


def thresholds(sized: DataFrame, wanted: dict[str, float]) -> dict[str, int]:
    """For each source the largest hash threshold whose texts below it hold at most the wanted tokens.

    Level by level: a histogram of all texts first, then of the boundary bucket of each source only.
    """
    low = {s: 0 for s in wanted}  # texts with a hash below this are in
    left = dict(wanted)
    open_ = set(wanted)
    for level in range(ALL_BITS // LEVEL_BITS):
        shift = ALL_BITS - LEVEL_BITS * (level + 1)
        if not open_:
            break
        width = 1 << (shift + LEVEL_BITS)
        inside = F.lit(False)
        for s in sorted(open_):
            here = F.col("source") == s
            inside = inside | (here if level == 0 else here & F.col("hash").between(low[s], low[s] + width - 1))
        cells = sized.where(inside).groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
        by: dict[str, list] = {}
        for r in cells:
            by.setdefault(r["source"], []).append((r["bucket"], r["t"], r["n"]))
        for s in sorted(open_):
            rows = sorted(by.get(s, []))
            base = low[s]
            for bucket, t, n in rows:
                if t <= left[s]:
                    left[s] -= t
                    low[s] = (bucket + 1) << shift
                else:
                    low[s] = bucket << shift
                    if n == 1:
                        open_.discard(s)
                    break
            else:
                low[s] = base + width
                open_.discard(s)
    return low


def plan(sized: DataFrame, weights: DataFrame, total: int | None = None) -> tuple[dict[str, tuple[int, int]], list[dict]]:
    """``source -> (whole copies, hash threshold of one more)`` and the rows of weights, cleaned."""
    rows = [r.asDict() for r in weights.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m")).distinct().where("source is not null").collect()]
    listed = [r["source"] for r in rows]  # sources that aren't listed may be many, and aren't used
    have = {r["source"]: r["t"] for r in sized.where(F.col("source").isin(listed)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    shares, repeats = {r["source"]: r["w"] or 0.0 for r in rows}, {r["source"]: r["m"] or 0 for r in rows}
    budget = budgets(have, shares, repeats, total)
    whole = {s: min(repeats[s], floor(b / have[s] + 1e-12)) for s, b in budget.items()}
    rest = {s: b - whole[s] * have[s] for s, b in budget.items() if whole[s] < repeats[s]}
    low = thresholds(sized, {s: x for s, x in rest.items() if x > 0})
    return {s: (whole[s], low.get(s, 0)) for s in budget}, rows


def mixture(docs: DataFrame, weights: DataFrame, total: int | None = None, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)`` of the mixture.

    rows: ``doc_id, source, tokens, copies`` of each text used; ``copies`` (1 to max_repeats) is how often.
    report: ``source, target_share, max_repeats, tokens_available, tokens_used, actual_share, texts_used`` for every source
    listed or found. Without ``total`` the mixture is the largest that the caps allow. A listed source without texts can't give
    its share: the other shares are scaled up in proportion, and the report says so. Sources that aren't listed
    are not used. A null share or cap counts as 0. Empty tables give an empty mixture.
    """
    spark = docs.sparkSession
    sized = cut(sized_texts(docs, tokenizer))
    chosen, rows = plan(sized, weights, total)
    copies = F.lit(0)
    for s, (whole, low) in sorted(chosen.items()):
        copies = F.when(F.col("source") == s, F.lit(whole) + F.when(F.col("hash") < low, 1).otherwise(0)).otherwise(copies)
    marked = sized.withColumn("copies", copies)
    used = marked.where("copies > 0").select("doc_id", "source", "tokens", "copies")
    listed = spark.createDataFrame([(r["source"], r["w"], r["m"]) for r in rows], "source string, target_share double, max_repeats int")
    sums = marked.groupBy("source").agg(
        F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count(F.when(F.col("copies") > 0, 1)).alias("texts_used")
    )
    report = listed.join(sums, "source", "full").select(
        "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens_available", "tokens_used", "texts_used"))
    )
    n = used.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    report = report.withColumn("actual_share", F.col("tokens_used") / F.lit(float(max(n, 1))))
    return used, report
