"""Evaluation passages inside training text, by one Aho-Corasick automaton.

Every run of ``run`` consecutive words of every evaluation item is a key of one automaton over normalised text
(the words joined by single spaces). A document is normalised the same way and scanned once; adjacent hits of
an item are joined into runs, and the word offsets of a run are mapped back to the original characters. The
items are a fixed table of checked size; beyond that they are scanned in blocks. The corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.functions.words import WORD, fold
from vellumq.session import bound_arrow, spread

SCHEMA = "doc_id bigint, item_id bigint, n_words int, longest int, first_char int, last_char int"
#: Characters of normalised item text that one automaton holds (about 100 MB of it); more items are scanned in blocks.
BLOCK_CHARS = 4_000_000


def item_grams(items: list[tuple[int, list[str]]], run: int) -> dict[str, list[int]]:
    """Each run of ``run`` words of the items, joined by spaces, with the ids of the items that hold it."""
    grams: dict[str, list[int]] = {}
    for item, w in items:
        for i in range(len(w) - run + 1):
            ids = grams.setdefault(" ".join(w[i : i + run]), [])
            if not ids or ids[-1] != item:
                ids.append(item)
    return grams


def automaton(grams: dict[str, list[int]]) -> ahocorasick.Automaton:
    """The automaton: its keys have a space on either side, so that only whole words match."""
    a = ahocorasick.Automaton()
    for gram, ids in grams.items():
        a.add_word(f" {gram} ", ids)
    a.make_automaton()
    return a


def leaks(text: str, a: ahocorasick.Automaton, run: int) -> list[tuple[int, int, int, int, int]]:
    """``item, words leaked, longest run, first character, end character`` of the items leaked into a text."""
    spans = WORD.findall(fold(text))
    if len(spans) < run:
        return []
    line = f" {' '.join(spans)} "
    ends: dict[int, list[int]] = {}
    for end, ids in a.iter(line):
        for item in ids:
            ends.setdefault(item, []).append(end)
    if not ends:
        return []
    # the number of the last word of each hit: spaces before the end
    number, seen, at = {}, 0, 0
    for end in sorted({e for x in ends.values() for e in x}):
        seen += line.count(" ", at, end)
        at = end
        number[end] = seen - 1
    where = [m.span() for m in WORD.finditer(fold(text))] if len(fold(text)) == len(text) else [m.span() for m in WORD.finditer(text)]
    out = []
    for item, hits in ends.items():
        runs: list[list[int]] = []
        for last in sorted({number[e] for e in hits}):
            if runs and last - run + 1 <= runs[-1][1] + 1:
                runs[-1][1] = last
            else:
                runs.append([last - run + 1, last])
        first, final = runs[0][0], min(runs[-1][1], len(where) - 1)
        out.append((item, sum(b - c + 1 for c, b in runs), max(b - c + 1 for c, b in runs), where[min(first, len(where) - 1)][0], where[final][1]))
    return out


#: The automaton that this Python worker made last, with the key of its items; workers serve many tasks.
_KEPT: list[tuple] = []


def kept_automaton(key: tuple[int, int], items, run: int):
    """The automaton of items, made once in a worker."""
    if not _KEPT or _KEPT[0][0] != key:
        _KEPT[:] = [(key, automaton(item_grams(items.value, run)))]
    return _KEPT[0][1]


def _scan(items, run: int, key: tuple[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = kept_automaton(key, items, run)
        for batch in batches:
            rows = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for x in leaks(text, a, run)] if len(a) else []
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "n_words", "longest", "first_char", "last_char"])

    return work


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id, n_words, longest, first_char, last_char``.

    An item leaks into a document if both share a run of at least ``run`` consecutive words. ``n_words`` counts the
    document's words inside such runs, ``longest`` the longest run; ``first_char`` and ``last_char`` are offsets of the
    original text around all runs. Null and empty texts, and items shorter than ``run`` words, give no row; rows of an id that
    come twice count once. Other columns are ignored whatever their names. Items above ``BLOCK_CHARS`` characters together make several automata, each of
    which scans the texts once.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    known = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for row in known.orderBy("i").toLocalIterator():
        w = WORD.findall(fold(row["t"]))
        if size and size + len(row["t"]) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        size += len(row["t"])
        blocks[-1].append((row["i"], w))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    texts = spread(texts)
    out = None
    for block in blocks:
        key = xxhash.xxh3_64_intdigest(repr(block).encode("utf-8", "surrogatepass")), run
        found = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), run, key), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "item_id"])
