"""Reading level of documents, by boosted regression trees.

Features are distributions of length, vocabulary, syntax and cohesion. Vocabulary is measured by the mean level of the
labelled texts in which a word stands. The trees are fitted on a bounded sample of labelled documents;
word levels and predictions for calibration come from other folds than the document's own, and the grades are
calibrated by source. Documents are scored in Arrow batches, whose tokens are handled as one array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.functions.words import fold
from vellumq.learn.gbt import Boosted, fit
from vellumq.session import bound_arrow, spread

TOKEN = re.compile(r"\w+|[.!?…]+|[,;:()«»\"—–]|\n\s*\n")
_VOWELS = re.compile(r"[aeiouyäöüаеёиоуыэюя]+", re.I)
#: Words that tie sentences together, in three languages.
CONNECTIVES = set(
    "потому поэтому однако причём если когда чтобы который которая которое которые поскольку хотя также либо тем вследствие посредством"
    " because therefore however if when which that whereas although whereby thereof notwithstanding moreover hence unless whether"
    " weil deshalb jedoch wenn dass obwohl sofern wodurch wobei indem daher dessen deren widrigenfalls".split()
)
FOLDS = 5
PRIOR = 4.0
LEAST_WORDS = 5


class Texts:
    """Feature rows of batches of texts; tokens are kept as rows of small tables."""

    def __init__(self, levels: dict[str, float], mean: float):
        self.levels, self.mean = levels, mean
        self.seen: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.empty((0, 7))

    def row(self, t: str) -> int:
        i = self.seen.get(t)
        if i is None:
            i = self.seen[t] = len(self.rows)
            if t[0].isalnum() or t[0] == "_":
                low = fold(t)
                level = self.levels.get(low)
                self.rows.append((0, len(t), len(_VOWELS.findall(low)), self.mean if level is None else level, level is not None, low in CONNECTIVES, t[0].isdigit()))
            else:
                self.rows.append((1 if t[0] in ".!?…\n" else 2, 0, 0, 0, 0, 0, 0))
        return i

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text; NaN where a text has too few words for the feature."""
        if len(self.seen) > 500_000:
            self.seen.clear()
            self.rows.clear()
            self.table = np.empty((0, 7))
        get, row = self.seen.get, self.row
        ids: list[int] = []
        sizes = []
        for text in texts:
            t = TOKEN.findall(text)
            sizes.append(len(t))
            ids += [i if (i := get(x)) is not None else row(x) for x in t]
        if len(self.table) < len(self.rows):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :], float)])
        n = len(texts)
        token = np.array(ids, np.int64)
        doc = np.repeat(np.arange(n), sizes)
        a = self.table[token] if len(token) else np.empty((0, 7))
        kind = a[:, 0]
        new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.empty(0, bool)
        ends = np.r_[False, kind[:-1] == 1] if len(doc) else np.empty(0, bool)
        sentence = np.cumsum(new | ends) - 1 if len(doc) else np.empty(0, np.int64)
        w = kind == 0
        d, s, x = doc[w], sentence[w], a[w]
        sums = lambda v, key=d, size=n: np.bincount(key, v, size)
        words = sums(np.ones(len(d)))
        with np.errstate(all="ignore"):
            per = lambda v: sums(v) / words
            length, level = x[:, 1], x[:, 3]
            # sentences that have words
            us, first = np.unique(s, return_index=True) if len(s) else (np.empty(0, np.int64), np.empty(0, np.int64))
            of = d[first]
            size = np.add.reduceat(np.ones(len(s)), first) if len(s) else np.empty(0)
            mean_level = np.add.reduceat(level, first) / size if len(s) else np.empty(0)
            mean_length = np.add.reduceat(length, first) / size if len(s) else np.empty(0)
            count = np.bincount(of, minlength=n).astype(float)
            sent = lambda v: np.bincount(of, v, n) / count
            spread = lambda v: np.sqrt(np.maximum(sent(v * v) - sent(v) ** 2, 0))
            high, low = np.full(n, -np.inf), np.full(n, np.inf)
            np.maximum.at(high, of, mean_level)
            np.minimum.at(low, of, mean_level)
            longest = np.zeros(n)
            np.maximum.at(longest, of, size)
            heavy = np.bincount(of, size * (mean_level > 3.4), n) / words
            light = np.bincount(of, size * (mean_level < 2.2), n) / words
            # quantiles of word levels and lengths
            start = np.r_[0, np.cumsum(words)[:-1]].astype(np.int64)
            at = lambda v, q: v[np.minimum(start + (q * np.maximum(words - 1, 0)).astype(np.int64), max(len(v) - 1, 0))] if len(v) else np.full(n, np.nan)
            by_level, by_length = level[np.lexsort((level, d))], length[np.lexsort((length, d))]
            # different words, and words shared by neighbouring sentences
            t = token[w]
            types = np.bincount(np.unique(d * (1 << 32) + t) >> 32, minlength=n).astype(float)
            pair = np.unique(s * (1 << 32) + t) if len(s) else np.empty(0, np.int64)
            both = np.intersect1d(pair, pair + (1 << 32), assume_unique=True)
            doc_of = np.zeros(int(sentence[-1]) + 2 if len(sentence) else 1, np.int64)
            doc_of[sentence] = doc
            shared = both[doc_of[both >> 32] == doc_of[np.maximum((both >> 32) - 1, 0)]]
            cohesion = np.bincount(doc_of[shared >> 32], minlength=n) / np.maximum(words, 1)
            signs = np.bincount(doc[kind == 2], minlength=n) / words
            out = np.stack([
                np.log1p(words), count, words / count, spread(size), longest, per(length), at(by_length, 0.5), at(by_length, 0.9), sent(mean_length), spread(mean_length),
                per(length >= 7), per(length >= 10), per(length >= 13), per(x[:, 2]), types / words, per(level), at(by_level, 0.1), at(by_level, 0.25), at(by_level, 0.5), at(by_level, 0.75), at(by_level, 0.9),
                sent(mean_level), spread(mean_level), high, low, heavy, light, per(x[:, 4]), per(x[:, 5]), per(x[:, 6]), signs, cohesion,
            ], axis=1)
        out[words < LEAST_WORDS] = np.nan
        out[~np.isfinite(out)] = np.nan
        return out


def word_levels(texts: list[str], y: np.ndarray) -> tuple[dict[str, float], float]:
    """Mean level of the texts in which a word stands (each text once), drawn to the overall mean; words of less than three texts are left out."""
    mean = float(np.mean(y)) if len(y) else 0.0
    total: dict[str, list[float]] = {}
    for t, level in zip(texts, y):
        for w in {fold(x) for x in TOKEN.findall(t) if x[0].isalpha()}:
            v = total.setdefault(w, [0.0, 0.0])
            v[0] += level
            v[1] += 1
    return {w: (s + PRIOR * mean) / (n + PRIOR) for w, (s, n) in total.items() if n >= 3}, mean


class Reader:
    """Word levels, trees and the calibration by source."""

    def __init__(self, levels: dict[str, float], mean: float, trees: Boosted, scale: tuple[float, float], offsets: dict[str, float]):
        self.levels, self.mean, self.trees, self.scale, self.offsets = levels, mean, trees, scale, offsets

    def grade(self, x: np.ndarray, sources: list[str | None]) -> np.ndarray:
        """Calibrated grades; NaN where there is no real text."""
        g = self.scale[0] + self.scale[1] * self.trees.raw(x) + np.array([self.offsets.get(normal_source(s), 0.0) for s in sources])
        g[np.isnan(x).all(axis=1)] = np.nan
        return np.clip(g, 1, 5)


def normal_source(s: str | None) -> str:
    return re.sub(r"\s+", " ", s).strip().lower() if s else ""


def fold_of(text: str) -> int:
    """Fold by text, so that copies stay together."""
    import xxhash

    return xxhash.xxh32_intdigest(text) % FOLDS


def learn(texts: list[str], y: np.ndarray, sources: list[str | None]) -> tuple[Reader, dict[str, float]]:
    """Fit the reader; the report holds the error and the agreement at level 4, cross-validated."""
    folds = np.array([fold_of(t) for t in texts])
    settings = {"trees": 150, "depth": 4, "rate": 0.07, "least": max(3, min(20, len(texts) // 40))}
    x = np.full((len(texts), len(Texts({}, 0).features(["a b c d e."])[0])), np.nan)
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(folds == k), np.flatnonzero(folds != k)
        if len(inside) and len(outside):
            x[inside] = Texts(*word_levels([texts[i] for i in outside], y[outside])).features([texts[i] for i in inside])
    held = np.full(len(texts), float(np.mean(y)))
    for k in range(FOLDS):
        inside, outside = folds == k, folds != k
        if inside.any() and outside.any():
            # word levels of the documents that train here must not know the documents held out
            z = x.copy()
            for j in set(folds[outside].tolist()):
                some, others = np.flatnonzero(folds == j), np.flatnonzero(outside & (folds != j))
                if len(others):
                    z[some] = Texts(*word_levels([texts[i] for i in others], y[others])).features([texts[i] for i in some])
            held[inside] = fit(z[outside], y[outside], **settings).raw(x[inside])
    # slope and offset from held-out predictions, then what is left by source, drawn to 0
    var = float(np.var(held))
    slope = float(np.clip(np.cov(held, y)[0, 1] / var, 0.8, 1.25)) if var > 1e-6 and len(y) > 20 else 1.0
    base = float(np.mean(y) - slope * np.mean(held))
    rest = y - base - slope * held
    names = np.array([normal_source(s) for s in sources])
    offsets = {str(s): float(rest[names == s].sum() / ((names == s).sum() + 50)) for s in np.unique(names)}
    final = base + slope * held + np.array([offsets[s] for s in names])
    report = {"error": float(np.abs(final - y).mean()), "agree4": float(((final >= 3.5) == (y >= 3.5)).mean())}
    return Reader(*word_levels(texts, y), fit(x, y, **settings), (base, slope), offsets), report


def _score(reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader.value
        texts = Texts(r.levels, r.mean)
        for batch in batches:
            ids, t, sources = (c.to_pylist() for c in batch.columns)
            g = r.grade(texts.features(t), sources)
            level = np.where(np.isnan(g), 0, np.round(np.nan_to_num(g, nan=0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(g, pa.float64(), from_pandas=True), pa.array(level, pa.int32(), mask=np.isnan(g))], ["doc_id", "grade", "level"]
            )

    return run


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], np.ndarray, list[str | None]]:
    """Texts, mean levels and sources of at most ``most`` labelled documents (those of smallest hash)."""
    y = labels.where("level is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("level").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    x = docs.select(F.col("doc_id").alias("id"), "text", "source").where("text is not null and length(text) >= 12")
    # the sample is bounded, so it may be broadcast
    rows = x.join(F.broadcast(y), "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], float), [r["source"] for r in rows]


def reading_levels(docs: DataFrame, labels: DataFrame, most: int = 6000) -> DataFrame:
    """``doc_id, grade, level`` of each document: a calibrated grade from 1 to 5, and the grade as a whole number.

    Both are null for documents without real text (null, or less than five words) and where there are no labels. Null levels are
    left out; levels of several raters are averaged. Rows of an id that come twice count once.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    texts, y, sources = labelled_texts(docs, labels, most)
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source").where("doc_id is not null")
    if not len(y):
        return x.select("doc_id", F.lit(None).cast("double").alias("grade"), F.lit(None).cast("int").alias("level")).distinct()
    reader, _ = learn(texts, y, sources)
    return spread(x).mapInArrow(_score(spark.sparkContext.broadcast(reader)), "doc_id bigint, grade double, level int").dropDuplicates(["doc_id"])


def reading_profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by source and level: ``source, level, n, mean_grade``; level is null for documents without real text."""
    levels = reading_levels(docs, labels)
    named = docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")).dropDuplicates(["doc_id"])
    return levels.join(named, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n"), F.avg("grade").alias("mean_grade"))
