"""Items that occur together more often than chance.

The plan is an external sort of packed 64-bit pair codes: entities are 64-bit hashes from the first step on; those in too few files are dropped, the
others get dense 31-bit numbers, a pair in a file
becomes one 64-bit code, codes are range-partitioned and sorted on disk by Spark (sorted runs are
spilled and merged), and runs are counted over Arrow batches. The range key holds the file number too,
so that a pair which occurs in a third of all files is cut into many runs on many tasks; the runs of a
pair are few and are added up afterwards. The texts of entities are only looked up for the numbered ones, where it is also checked that
no two of them have the same hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.operators.numbering import dense_numbers
from vellumq.session import broadcast_if_small, cut


def normal(col: str) -> Column:
    """Normal form of a value: white space runs as one space, trimmed, lower case, ё as е."""
    return F.translate(F.lower(F.trim(F.regexp_replace(F.col(col), r"(?U)\s+", " "))), "ё", "е")


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of ``code`` over batches sorted by (code, file_id); equal rows count once."""
    last_code = last_file = None
    code = n = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("code").to_numpy()
        f = batch.column("file_id").to_numpy()
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
        if last_code == c[0] and last_file == f[0]:
            fresh[0] = False
        last_code, last_file = c[-1], f[-1]
        c = c[fresh]
        if not len(c):
            continue
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        codes, counts = c[starts], np.diff(np.r_[starts, len(c)])
        if code is not None and codes[0] == code:
            counts[0] += n
        elif code is not None:
            codes, counts = np.r_[code, codes], np.r_[n, counts]
        code, n = codes[-1], counts[-1]
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1], pa.int64()), pa.array(counts[:-1], pa.int64())], ["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([n], pa.int64())], ["code", "n"])


def run_counts(coded: DataFrame) -> DataFrame:
    """``code, n``: the number of distinct file_ids of each code, by external sort and run-length count."""
    runs = coded.repartitionByRange("code", "file_id").sortWithinPartitions("code", "file_id").mapInArrow(count_runs, "code bigint, n bigint")
    return runs.groupBy("code").agg(F.sum("n").alias("n"))


def cooccurrence(links: DataFrame, min_files: int = 5) -> DataFrame:
    """Pairs of entities that share at least ``min_files`` file_ids, with counts and strength.

    Input columns ``entity1, entity1_type, entity2, entity2_type, file_id``; others are ignored.
    Result: ``entity1, entity1_type, entity2, entity2_type, n12, n1, n2, n_files, lift, odds_ratio,
    log_odds_z``, the smaller (type, value) by code points first.

    Defined cases: rows with a null file_id do not count at all. An end whose value or type is null is
    no entity: the row still counts for the other end and for ``n_files``, not as a pair. An entity
    paired with itself is no pair. Repeated rows count once. An empty table gives no rows.
    ``odds_ratio`` has Haldane's correction (0.5 on each cell); ``log_odds_z`` is its logarithm over its
    standard error.
    """
    rows = links.where("file_id is not null").select(
        normal("entity1").alias("v1"), F.col("entity1_type").alias("t1"), normal("entity2").alias("v2"), F.col("entity2_type").alias("t2"), F.col("file_id").cast("bigint").alias("file_id")
    )
    for seed in itertools.count():
        mark = lambda t, v: F.when(F.col(t).isNotNull() & F.col(v).isNotNull(), F.xxhash64(F.lit(seed), t, v))  # noqa: B023, E731
        hashed = rows.select("*", mark("t1", "v1").alias("h1"), mark("t2", "v2").alias("h2"))
        ends = hashed.select(F.inline(F.array(F.struct(F.col("h1").alias("h"), F.col("t1").alias("t"), F.col("v1").alias("v")), F.struct(F.col("h2").alias("h"), F.col("t2").alias("t"), F.col("v2").alias("v"))))).where("h is not null")
        narrow = cut(hashed.select("h1", "h2", "file_id"))
        often = run_counts(narrow.select(F.explode(F.array("h1", "h2")).alias("code"), "file_id").where("code is not null")).where(F.col("n") >= min_files)
        counts = cut(dense_numbers(often.select(F.col("code").alias("h"), "n")))
        small = counts.count()
        near = (lambda x, width: broadcast_if_small(x, small, width))  # noqa: B023, E731
        names = ends.join(near(counts.select("h"), 16), "h", "left_semi").groupBy("h").agg(F.min(F.struct("t", "v")).alias("x"), F.max(F.struct("t", "v")).alias("y"))
        entities = cut(counts.join(names, "h").select("eid", "h", F.col("n").alias("m"), F.col("x.t").alias("t"), F.col("x.v").alias("v"), (F.col("x") != F.col("y")).alias("clash")))
        if entities.where("clash").isEmpty():
            break  # else two entities have one hash: all over with other hashes
    if small >= 1 << 31:
        raise ValueError("more than 2^31 frequent items: pack the codes into two columns")
    n_files = narrow.agg(F.count_distinct("file_id")).first()[0]
    # a hot entity makes a skewed join, which AQE splits (the numbered side is unique)
    number = lambda k: near(counts.select(F.col("h").alias(f"h{k}"), F.col("eid").alias(f"e{k}")), 24)
    coded = narrow.where("h1 <> h2").join(number(1), "h1").join(number(2), "h2")
    pair = F.shiftleft(F.least("e1", "e2"), 32).bitwiseOR(F.greatest("e1", "e2"))
    pairs = run_counts(coded.select(pair.alias("code"), "file_id")).where(F.col("n") >= min_files)
    first, second = (entities.select(F.col("eid").alias(f"e{k}"), F.col("t").alias(f"t{k}"), F.col("v").alias(f"v{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
    counted = pairs.select(F.shiftright("code", 32).alias("e1"), F.col("code").bitwiseAND((1 << 32) - 1).alias("e2"), F.col("n").alias("n12")).join(first, "e1").join(second, "e2")
    a, b = F.struct("t1", "v1", "m1"), F.struct(F.col("t2").alias("t1"), F.col("v2").alias("v1"), F.col("m2").alias("m1"))
    x = counted.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "n12")
    n = F.lit(int(n_files or 0))
    out = x.select(
        F.col("a.v1").alias("entity1"), F.col("a.t1").alias("entity1_type"), F.col("b.v1").alias("entity2"), F.col("b.t1").alias("entity2_type"),
        "n12", F.col("a.m1").alias("n1"), F.col("b.m1").alias("n2"), n.cast("bigint").alias("n_files"),
    )
    c11, c10 = F.col("n12") + 0.5, F.col("n1") - F.col("n12") + 0.5
    c01, c00 = F.col("n2") - F.col("n12") + 0.5, n - F.col("n1") - F.col("n2") + F.col("n12") + 0.5
    odds = (c11 * c00) / (c10 * c01)
    return (
        out.withColumn("lift", F.col("n12") * n / (F.col("n1") * F.col("n2")).cast("double"))
        .withColumn("odds_ratio", odds)
        .withColumn("log_odds_z", F.log(odds) / F.sqrt(1 / c11 + 1 / c10 + 1 / c01 + 1 / c00))
    )


def associated(links: DataFrame, min_files: int = 5, min_lift: int = 8) -> DataFrame:
    """Pairs of :func:`cooccurrence` with ``n12 * n_files >= min_lift * n1 * n2``, in whole numbers."""
    return cooccurrence(links, min_files).where(F.col("n12") * F.col("n_files") >= F.lit(min_lift) * F.col("n1") * F.col("n2"))
