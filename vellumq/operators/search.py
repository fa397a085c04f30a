"""Ranked full-text search: weighted BM25 with prefixes and phrases, by one pass over the rows.

A query has few terms, so each row counts them with array functions inside its own columns; only ids, counts and lengths leave
the scan. Document frequencies and the average length are one aggregate row.
"""

from __future__ import annotations

import re
import unicodedata
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumq.session import cut, spread

#: Weights of the columns, BM25 parameters, most tokens of a query.
WEIGHTS = {"path": 5.0, "filename": 10.0, "extracted_text": 1.0, "entities_json": 3.0}
K1, B = 1.2, 0.75
MOST_TOKENS = 32
TOKEN = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Latin letters with marks, in lower case, and the letters below the marks."""
    pairs = {}
    for k in range(0xC0, 0x1F00):
        c = chr(k).lower()
        base, *marks = unicodedata.normalize("NFD", c)
        if len(c) == 1 and marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


#: Letters with marks count as the letters below: ranked search does not tell é from e; й and ё are letters of their own.
ACCENTS = _accents()


def folded(col: Column) -> Column:
    """Lower case without marks on Latin letters; null is empty."""
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), *ACCENTS)


def tokens(col: Column) -> Column:
    """Runs of letters and digits in lower case without marks on Latin letters."""
    return F.regexp_extract_all(folded(col), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower().translate(str.maketrans(*ACCENTS)))[:MOST_TOKENS]


def _count(t: Column, words: list[str], prefix: bool) -> Column:
    """Occurrences of a word (or prefix), or of words one after the other, in a folded text; only texts that hold the words are searched."""
    pattern = r"(?<![\p{L}\p{N}])" + r"(?![\p{L}\p{N}])[^\p{L}\p{N}]+".join(words) + ("" if prefix else r"(?![\p{L}\p{N}])")
    there = t.contains(words[0])
    for w in words[1:]:
        there = there & t.contains(w)
    return F.when(there, F.regexp_count(t, F.lit(pattern))).otherwise(0)


def search(files: DataFrame, query: str, limit: int = 100, prefix: bool = True, any_word: bool = False) -> DataFrame:
    """``id, path, strength, score`` of the best rows; score is 0.2 to 1.0, the best has 1.0.

    A row matches if it holds the phrase, or all words (any word with ``any_word``). A query without words, and an empty
    table, give no rows. Null columns hold nothing; rows of an id that come twice count once.
    """
    words = query_tokens(query)
    terms = [[w] for w in words] + ([words] if len(words) > 1 else [])
    if not words:
        return files.select("id", "path", F.lit(0.0).alias("strength"), F.lit(0.0).alias("score")).limit(0)
    rows = spread(files.select("id", *WEIGHTS)).select("id", "path", *(folded(F.col(c)).alias(f"_{c}") for c in WEIGHTS))
    counts = [sum((F.lit(w) * _count(F.col(f"_{c}"), t, prefix and len(t) == 1) for c, w in WEIGHTS.items()), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    length = sum((F.regexp_count(f"_{c}", F.lit(TOKEN)) for c in WEIGHTS), F.lit(0)).alias("dl")
    rows = cut(rows.select("id", "path", length, *counts).dropDuplicates(["id"]))  # the texts are read once; numbers alone are kept
    n = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms)))).first()
    has = [F.col(f"tf{i}") > 0 for i in range(len(words))]
    both = has[0]
    for h in has[1:]:
        both = (both | h) if any_word else (both & h)
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(n["avg"] or 1.0)))
    idf = lambda i: max(log((n["n"] - n[f"df{i}"] + 0.5) / (n[f"df{i}"] + 0.5)), 1e-6)
    strength = sum((F.lit(idf(i)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(terms))), F.lit(0.0))
    top = rows.where(both).select("id", "path", strength.alias("strength")).orderBy(F.desc("strength"), "id").limit(limit)
    best = F.max("strength").over(Window.partitionBy())  # over the limited rows alone
    score = F.when(best <= 1e-9, 1.0).otherwise(F.least(F.lit(1.0), 0.2 + 0.8 * F.col("strength") / best))
    return top.withColumn("score", F.round(score, 4))


def snippet(text: Column, words: list[str], around: int = 40) -> Column:
    """About ``around`` words around the first word that begins with one of the query's, which are marked; the beginning if there is none."""
    half = around // 2
    word = r"[\p{L}\p{N}]+"
    hit = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")[\p{L}\p{N}]*"
    gap = r"[^\p{L}\p{N}]+"
    near = rf"(?iu)(?:{word}{gap}){{0,{half}}}(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})[\p{{L}}\p{{N}}]*(?:{gap}{word}){{0,{half}}}"
    begin = rf"(?u)(?:{word}(?:{gap})?){{0,{around}}}"
    t = F.coalesce(text, F.lit(""))
    cut_ = F.when(t.rlike(hit), F.regexp_extract(t, near, 0)).otherwise(F.regexp_extract(t, begin, 0))
    marked = F.regexp_replace(cut_, f"({hit})", "<mark>$1</mark>")
    return F.concat(F.when(t.startswith(cut_), "").otherwise("…"), marked, F.when(t.endswith(cut_), "").otherwise("…"))


def postings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, id, tf`` (weighted by column) and ``id, path, dl``: what a ranked search needs of the rows, to be kept at rest.

    Written by :func:`write_postings`, so that a search reads the terms of its query alone.
    """
    x = files.select("id", *WEIGHTS).dropDuplicates(["id"])
    both = [x.select("id", F.lit(w).alias("w"), F.explode(tokens(F.col(c))).alias("term")) for c, w in WEIGHTS.items()]
    every = both[0]
    for y in both[1:]:
        every = every.unionByName(y)
    terms = every.groupBy("term", "id").agg(F.sum("w").alias("tf"))
    length = sum((F.size(tokens(F.col(c))) for c in WEIGHTS), F.lit(0)).alias("dl")
    return terms, x.select("id", "path", length)


def write_postings(files: DataFrame, folder: str, parts: int = 16) -> None:
    """Postings sorted by term in range-partitioned files, so that the statistics of the files prune all but a query's terms."""
    terms, docs = postings(files)
    terms.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/terms")
    docs.write.mode("overwrite").parquet(f"{folder}/docs")


def update_postings(folder: str, changed: DataFrame, removed: DataFrame, to: str, parts: int = 16) -> None:
    """The postings of a folder without removed and changed rows (``id``), with those of the changed rows (columns of files), written to another folder."""
    spark = changed.sparkSession
    gone = removed.select("id").unionByName(changed.select("id")).distinct()
    terms, docs = postings(changed)
    old = [spark.read.parquet(f"{folder}/{n}").join(gone, "id", "left_anti") for n in ("terms", "docs")]
    terms = old[0].select("term", "id", "tf").unionByName(terms)
    terms.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{to}/terms")
    old[1].select("id", "path", "dl").unionByName(docs).write.mode("overwrite").parquet(f"{to}/docs")


def search_kept(terms: DataFrame, docs: DataFrame, query: str, limit: int = 100, prefix: bool = True, any_word: bool = False) -> DataFrame:
    """The words of :func:`search` over kept postings; ``id, path, strength, score``. The phrase adds nothing here, as postings have no places."""
    words = query_tokens(query)
    if not words:
        return docs.select("id", "path", F.lit(0.0).alias("strength"), F.lit(0.0).alias("score")).limit(0)
    hit = [F.col("term").startswith(w) if prefix else F.col("term") == w for w in words]
    some = hit[0]
    for h in hit[1:]:
        some = some | h
    tf = terms.where(some).groupBy("id").agg(*(F.coalesce(F.sum(F.when(h, F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i, h in enumerate(hit)))
    tf = cut(tf)
    n = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    df = tf.agg(*(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words)))).first()
    match = F.col("tf0") > 0
    for i in range(1, len(words)):
        match = (match | (F.col(f"tf{i}") > 0)) if any_word else (match & (F.col(f"tf{i}") > 0))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(n["avg"] or 1.0)))
    idf = lambda i: max(log((n["n"] - df[f"df{i}"] + 0.5) / (df[f"df{i}"] + 0.5)), 1e-6)
    strength = sum((F.lit(idf(i)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(words))), F.lit(0.0))
    top = docs.join(tf.where(match), "id").select("id", "path", strength.alias("strength")).orderBy(F.desc("strength"), "id").limit(limit)
    best = F.max("strength").over(Window.partitionBy())  # over the limited rows alone
    return top.withColumn("score", F.round(F.when(best <= 1e-9, 1.0).otherwise(F.least(F.lit(1.0), 0.2 + 0.8 * F.col("strength") / best)), 4))


def term_stats(files: DataFrame, text_col: str = "extracted_text") -> DataFrame:
    """``term, n_files, n_all``: document frequency and frequency of all terms; counted per row before the shuffle."""
    x = files.select("id", F.explode(tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return x.groupBy("term").agg(F.count("*").alias("n_files"), F.sum("c").alias("n_all"))
