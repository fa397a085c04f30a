"""Repair of text from scanned pages into continuous paragraphs.

One pass over all files counts words and word pairs (the corpus lexicon); the counts stay in Spark. Lines that only
number a page and headings repeated at page breaks are told from the layout of the lines. The words of the scanned texts are joined with the lexicon
on a symmetric-delete index: a word that the index can reach from a far more frequent word by confusions of
characters is misread, and the weighted edit distance, the frequency and the word before choose the repair. Words broken at line ends are repaired
by the counts of the whole and its parts. Only what a text needs of the lexicon goes to its task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.functions.words import fold
from vellumq.session import bound_arrow, cut, spread

#: What comes from a scanner.
SCANNED = [".pdf", ".tiff", ".tif", ".djvu", ".jpg", ".jpeg", ".png"]
DEFECTS = ["hyphenation", "misread", "running_header", "page_number"]
#: Pairs (right, as recognised) and the cost of the confusion.
CONFUSIONS = [
    ("l", "1", 0.3), ("i", "1", 0.4), ("o", "0", 0.3), ("e", "c", 0.4), ("t", "f", 0.4), ("h", "li", 0.4), ("m", "rn", 0.3), ("d", "cl", 0.3), ("w", "vv", 0.3),
    ("u", "ii", 0.4), ("s", "5", 0.4), ("b", "8", 0.4), ("z", "2", 0.5), ("g", "9", 0.5), ("i", "l", 0.5), ("l", "i", 0.5), ("n", "ri", 0.6), ("c", "e", 0.6), ("f", "t", 0.6), ("q", "g", 0.6),
    ("п", "л", 0.4), ("л", "п", 0.6), ("и", "н", 0.4), ("н", "и", 0.4), ("б", "6", 0.3), ("з", "3", 0.3), ("ч", "4", 0.4), ("в", "b", 0.3), ("ю", "lo", 0.3), ("ш", "щ", 0.5), ("щ", "ш", 0.5),
    ("о", "0", 0.3), ("ы", "ьl", 0.3), ("ы", "ьi", 0.3), ("г", "r", 0.4), ("т", "m", 0.5), ("п", "n", 0.4), ("и", "u", 0.4), ("й", "и", 0.6), ("и", "й", 0.6), ("ц", "u", 0.6), ("д", "g", 0.6),
    ("а", "a", 0.1), ("е", "e", 0.1), ("о", "o", 0.1), ("р", "p", 0.1), ("с", "c", 0.1), ("у", "y", 0.1), ("х", "x", 0.1), ("к", "k", 0.2), ("м", "m", 0.2), ("т", "t", 0.2), ("н", "h", 0.2),
]
#: Cost above which a word is left alone.
MOST_COST = 1.3
#: Likeness from which two headings are the same one.
LIKE = 0.84

WORDS = re.compile(r"[^\W_]+(?:\.(?=[^\W\d_]{2}))?[^\W_]*")
TOKEN = re.compile(r"[^\W_]+")
NUMBERED = re.compile(r"(?:[-–—\[(]\s*)?(?:(?:стр|с|p|s)\.|страница|лист|page|seite|blatt|sheet)?\s*\d{1,4}(?:\s*(?:из|of|von|/)\s*\d{1,4})?\s*[-–—\])]?", re.I)
#: Signs that break a word at a line end.
SIGNS = "-‐‑–¬\xad"
ONLY_LETTERS = re.compile(r"[^\W\d_]+")


def clean_word(w: str) -> bool:
    """Letters only, of one script."""
    return w.isalpha() and (w.isascii() or not any("a" <= c <= "z" for c in w) or all(c < "Ͱ" for c in w))


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    code: dict[str, int] = {}
    codes: list[np.ndarray] = []
    pairs: dict[int, int] = {}
    held = 0

    def fold_pairs() -> None:
        if codes:
            u, n = np.unique(np.concatenate(codes), return_counts=True)
            for k, v in zip(u.tolist(), n.tolist()):
                pairs[k] = pairs.get(k, 0) + v
            codes.clear()

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if not t:
                continue
            w = TOKEN.findall(fold(t))
            words.update(w)
            for x in set(w).difference(code):
                code[x] = xxhash.xxh32_intdigest(x) if x.isalpha() else 0
            h = np.fromiter(map(code.__getitem__, w), np.uint64, len(w))
            if len(code) > 500_000:
                code.clear()
            both = (h[:-1] << np.uint64(31)) ^ h[1:]
            codes.append(both[(h[:-1] != 0) & (h[1:] != 0)].view(np.int64))
            held += len(w)
            if held > 3_000_000:
                fold_pairs()
                held = 0
    fold_pairs()
    few = [(w, n) for w, n in words.items() if clean_word(w)]
    names = ["kind", "word", "code", "n"]
    for at in range(0, len(few), 50_000):
        part = few[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(part)), pa.array([w for w, _ in part]), pa.array([0] * len(part), pa.int64()), pa.array([n for _, n in part], pa.int64())], names)
    keys = list(pairs)
    for at in range(0, len(keys), 100_000):
        part = keys[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(part)), pa.array([None] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array([pairs[k] for k in part], pa.int64())], names)


def lexicon(texts: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """``word, n`` and ``code, n``: words and word pairs that come at least ``least`` times in all texts; what is rarer is no evidence."""
    counts = texts.select("text").mapInArrow(_lexicon, "kind string, word string, code bigint, n bigint").groupBy("kind", "word", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = cut(counts)
    return counts.where("kind = 'word'").select("word", "n"), counts.where("kind = 'pair'").select("code", "n")


def pair_code(a: str, b: str) -> int:
    """The code of a word pair, as counted."""
    h = ((xxhash.xxh32_intdigest(a) << 31) ^ xxhash.xxh32_intdigest(b)) & (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def deletes(w: str, n: int) -> set[str]:
    """The word and what is left of it without up to n characters."""
    out, last = {w}, {w}
    for _ in range(n):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


COST = {(right, seen): c for right, seen, c in CONFUSIONS}
#: Words up to this length are found by what is left of them without up to two characters, longer ones by a quarter that is whole.
SHORT = 20


def distance(seen: str, right: str) -> float:
    """Weighted edit distance from the right word to the one recognised; single edits that are no confusion cost more than a repair may."""
    rows = [[0.0] * (len(seen) + 1) for _ in range(len(right) + 1)]
    for i in range(len(right) + 1):
        for j in range(len(seen) + 1):
            if i == j == 0:
                continue
            best = 9.0
            if i and j:
                same = right[i - 1] == seen[j - 1]
                best = rows[i - 1][j - 1] + (0 if same else COST.get((right[i - 1], seen[j - 1]), 1.6))
                if j > 1:
                    best = min(best, rows[i - 1][j - 2] + COST.get((right[i - 1], seen[j - 2 : j]), 9))
            if j:
                best = min(best, rows[i][j - 1] + (0.5 if seen[j - 1] == "." else 1.6))
            if i:
                best = min(best, rows[i - 1][j] + 1.6)
            rows[i][j] = best
    return rows[-1][-1]


def within(seen: str, right: str, i: int = 0, j: int = 0, drop_seen: int = 2, drop_right: int = 1) -> bool:
    """Whether the word without up to two characters is the right one without up to one."""
    while i < len(seen) and j < len(right) and seen[i] == right[j]:
        i, j = i + 1, j + 1
    if i == len(seen) or j == len(right):
        return len(seen) - i <= drop_seen and len(right) - j <= drop_right
    return (drop_seen > 0 and within(seen, right, i + 1, j, drop_seen - 1, drop_right)) or (drop_right > 0 and within(seen, right, i, j + 1, drop_seen, drop_right - 1))


def _quarters(n: int) -> list[tuple[int, int]]:
    return [(k * n // 4, (k + 1) * n // 4) for k in range(4)]


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts))) >> 1


def keys_of_lexicon(w: str) -> set[int]:
    """Index keys of a word of the lexicon: the word without up to one character; of a long one its quarters."""
    out: set[int] = set()
    if len(w) <= SHORT + 1:
        out = {_hash(d) for d in deletes(w, 1)}
    if len(w) > SHORT - 2:  # three edits leave one of four quarters whole
        out |= {_hash(len(w), k, w[a:b]) for k, (a, b) in enumerate(_quarters(len(w)))}
    return out


def keys_of_seen(w: str) -> set[int]:
    """Keys under which the index has all words that a recognised word may stand for."""
    if len(w) <= SHORT:
        return {_hash(d) for d in deletes(w, 2 if len(w) > 4 else 1)}
    return {_hash(n, k, w[a + by : b + by]) for n in range(len(w) - 2, len(w) + 2) for k, (a, b) in enumerate(_quarters(n)) for by in range(-1, 3) if a + by >= 0}


class Facts:
    """What the lexicon tells of the words of one text: counts, which are misread, and repairs by the word before."""

    def __init__(self, rows: Iterable[tuple[str, str | None, int, str | None, str | None]] = ()):
        self.n: dict[str, int] = {}
        self.good: dict[tuple[str, str | None], str] = {}
        self.misread: dict[str, str] = {}  # with the best candidate whatever stands before
        for word, before, n, good, first in rows:
            self.n[word] = n
            if first is not None:
                self.good[word, before] = good or first
                self.misread[word] = first

    def right(self, w: str, before: str) -> str | None:
        """The repair of a word after another, or none."""
        if w not in self.misread:
            return None
        return self.good.get((w, before)) or self.misread[w]


def _like(model: str, w: str) -> str:
    return w.upper() if model.isupper() and len(model) > 1 else w[0].upper() + w[1:] if model[:1].isupper() else w


def heading(line: str) -> str:
    """What stays the same of a heading from page to page."""
    return re.sub(r"\s{2,}[\d./-]+$", "", line.strip()).casefold()


def layout(lines: list[str]) -> tuple[set[int], set[int]]:
    """The lines that number a page, and the lines that are headings repeated on the pages."""
    full = sorted(len(x) for x in lines if x.strip())
    if not full:
        return set(), set()
    width = full[int(len(full) * 0.8)]
    numbers = {i for i, x in enumerate(lines) if NUMBERED.fullmatch(x.strip("\x0c \t"))}
    short = {}
    for i, x in enumerate(lines):
        s = heading(x.strip("\x0c"))
        if i not in numbers and 5 <= len(s) <= 0.85 * width and (x.strip()[0].isupper() or x.strip()[0] in "«\"“") and s[-1] not in ",;:-–¬\xad‐" and not (s[-1] == "." and not re.search(r"(inc|ltd|co)\.$", s)):
            short[i] = s
    if not short:
        return numbers, set()
    first = min((i for i, x in enumerate(lines) if x.strip()), default=0)
    heads = Headings(short.values())
    kept: dict[int, str] = {}
    for i, s in short.items():
        repeated = heads.repeated(s)
        small = len(s) <= 0.62 * width
        marked, runs = _page_break(lines, i, numbers)
        inside = i + 1 < len(lines) and lines[i + 1].strip("\x0c \t") != ""
        if repeated:
            is_head = i == first or first in short and heads.same(s, short[first]) or marked or (small and (runs or inside))
        else:
            is_head = small and marked and runs
        if is_head:
            kept[i] = s
    return numbers, set(kept) if any(i != first for i in kept) else set()


class Headings:
    """The different headings of a text and how many lines have each."""

    def __init__(self, lines: Iterable[str]):
        self.count = Counter(lines)
        self.known: dict[str, bool] = {}
        self.near: dict[str, list[str]] = {}  # headings that share their beginning or their end are compared
        for s in self.count:
            self.near.setdefault(s[:3], []).append(s)
            self.near.setdefault("$" + s[-3:], []).append(s)
        self.bags: dict[str, tuple[dict[str, int], np.ndarray, np.ndarray]] = {}

    def bag(self, key: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Columns of the characters, counts of characters and lengths of the headings with a key."""
        if key not in self.bags:
            some = self.near[key]
            column = {c: k for k, c in enumerate(sorted(set("".join(some))))}
            counts = np.zeros((len(some), len(column)), np.int16)
            for row, s in enumerate(some):
                for c in s:
                    counts[row, column[c]] += 1
            self.bags[key] = column, counts, np.array([len(s) for s in some])
        return self.bags[key]

    def same(self, s: str, t: str) -> bool:
        """Whether a line with t is compared with one with s and is like it."""
        return (s[:3] == t[:3] or s[-3:] == t[-3:]) and _alike(s, t)

    def repeated(self, s: str) -> bool:
        """Whether another line is like s. Only headings with too few characters in common to be like it are passed over, so nothing is lost."""
        if s not in self.known:
            self.known[s] = self.count[s] > 1 or any(self._found(s, key) for key in (s[:3], "$" + s[-3:]))
        return self.known[s]

    def _found(self, s: str, key: str) -> bool:
        some = self.near[key]
        if len(some) == 1:
            return False
        column, counts, lengths = self.bag(key)
        mine = np.zeros(len(column), np.int16)
        for c in s:
            mine[column[c]] += 1
        apart = np.abs(counts - mine).sum(axis=1)
        rows = np.flatnonzero((np.abs(lengths - len(s)) <= 3) & (apart <= (1 - LIKE) * (lengths + len(s)) + 1e-6))
        return any(some[k] != s and _alike(s, some[k]) for k in rows[np.argsort(apart[rows], kind="stable")])


def _alike(s: str, t: str) -> bool:
    return s == t or abs(len(s) - len(t)) <= 3 and SequenceMatcher(None, s, t, autojunk=False).ratio() >= LIKE


def _page_break(lines: list[str], i: int, numbers: set[int]) -> tuple[bool, bool]:
    """Whether a page ends just before or after line i, and whether the sentence runs on around it."""
    a = i - 1
    marked = lines[i].startswith("\x0c")
    while a >= 0 and (a in numbers or not lines[a].strip("\x0c \t")):
        marked |= a in numbers or "\x0c" in lines[a]
        a -= 1
    marked |= a >= 0 and lines[a].endswith("\x0c")
    b = i + 1
    while b < len(lines) and (b in numbers or not lines[b].strip("\x0c \t")):
        marked |= b in numbers
        b += 1
    runs = a >= 0 and b < len(lines) and lines[a].rstrip("\x0c \t")[-1:] not in (".", "!", "?", "…", ":", "") and lines[b].lstrip("\x0c \t")[:1].islower()
    return marked, runs


GAP, REMOVED = 1, 2


def lay_out(text: str) -> tuple[str, list[str]]:
    """The lines that are text, each behind a digit that tells of a blank line or a removed line before it, and the defects of the layout."""
    lines = text.replace("\r\n", "\n").replace("\x0c", "\x0c\n").split("\n")
    numbers, heads = layout(lines)
    out: list[str] = []
    flags = 0
    for i, raw in enumerate(lines):
        x = raw.strip("\x0c \t")
        if i in numbers or i in heads:
            flags |= REMOVED
        elif x:
            out.append(f"{flags}{x}")
            flags = 0
        elif out:
            flags |= GAP
    return "\n".join(out), [d for d, there in (("running_header", heads), ("page_number", numbers)) if there]


def broken(line: str) -> tuple[str, str] | None:
    """The letters before the sign at the end of a line, and the sign."""
    if not line or line[-1] not in SIGNS:
        return None
    at = len(line) - 1
    while at and line[at - 1].isalpha():
        at -= 1
    return (line[at:-1], line[-1]) if at < len(line) - 1 else None


def _lines(laid: str) -> Iterator[tuple[int, str]]:
    return ((int(x[0]), x[1:]) for x in laid.split("\n")) if laid else iter(())


def _tokens(s: str) -> list[str]:
    return WORDS.findall(fold(s))


def asked(laid: str) -> Iterator[tuple[str, str, str | None]]:
    """What is asked of the lexicon: ``word, word before, sort`` with sort None for a word of the text and "part" for the parts and wholes of broken ones."""
    last, before = "", ""
    for flags, x in _lines(laid):
        m = broken(last)
        if m and x[0].isalpha() and (not flags & GAP or flags & REMOVED):
            head = ONLY_LETTERS.match(x)
            left, right = fold(m[0]), fold(head.group()) if head else ""
            for w in (left + right, left, right):
                yield w, "", "part"
            # the words around the break if it is closed
            at = max(last.rfind(" ") + 1, last.rfind("\t") + 1)
            prior = _tokens(last[:at])
            b = prior[-1] if prior else ""
            for w in _tokens(last[at:-1] + x.split(None, 1)[0]):
                yield w, b, None
                b = w
            rest = x.split(None, 1)
            nexts = _tokens(rest[1]) if len(rest) > 1 else []
            if nexts:
                yield nexts[0], b, None
        for w in _tokens(x):
            yield w, before, None
            before = w
        last = x


def repair(laid: str, defects: list[str], facts: Facts) -> tuple[str, list[str]]:
    """The text as continuous paragraphs, and the defects that it showed."""
    found = set(defects)
    paragraphs: list[list[str]] = []
    here: list[str] = []  # stretches of the paragraph, the last of them open to a join
    for flags, x in _lines(laid):
        gap, removed = flags & GAP, flags & REMOVED
        if not here:
            here = [x]
            continue
        m = broken(here[-1])
        joined = _join(m, x, facts) if m and x[0].isalpha() and (not gap or removed) else None
        if joined is not None:
            if joined:
                found.add("hyphenation")
                here[-1] = here[-1][:-1]
            here[-1] += x
        elif gap and not (removed and here[-1][-1] not in ".!?…:»”" and x[0].islower()):
            paragraphs.append(here)
            here = [x]
        else:
            here.append(x)
    if here:
        paragraphs.append(here)
    fixed: list[str] = []
    for stretches in paragraphs:
        p = " ".join(stretches)
        before, parts, at = "", [], 0
        for m in WORDS.finditer(p):
            w = m.group()
            low = fold(w)
            good = facts.right(low, before)
            if good:
                found.add("misread")
                parts += [p[at : m.start()], _like(w, good)]
                at = m.end()
            before = low
        fixed.append("".join(parts) + p[at:])
    return "\n\n".join(fixed), [d for d in DEFECTS if d in found]


def _join(m: tuple[str, str], x: str, facts: Facts) -> bool | None:
    """Whether a word was broken at the line end (True), or is spelled with the sign (False); none if it is neither."""
    a, sign = m
    b = ONLY_LETTERS.match(x)
    if sign in "¬\xad" or sign in "–‐‑" and (x[0].islower() or len(a) > 1 and a.isupper()):
        return True
    if sign == "–" or not b:
        return None
    whole, left, right = fold(a + b.group()), fold(a), fold(b.group())
    n = facts.n
    if n.get(whole) or whole in facts.misread:
        return True
    if x[0].isupper() and not a.isupper():
        return False
    return not (n.get(left, 0) > 1 and n.get(right, 0) > 1 and len(left) > 2 and len(right) > 2)


# ---------------------------------------------------------------- the plan

#: Bits of word hashes in the bitmaps of misread and ambiguous words.
BITS = 26


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *lay_out(t)) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.list_(pa.string())))], ["id", "laid", "defects"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            held.update(w for w, _, _ in asked(t))
        if len(held) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(held))], ["word"])
            held = set()
    yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.string())], ["word"])


def _seen_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, w, n) for w, n in zip(*(c.to_pylist() for c in batch.columns)) if len(w) >= 3 and not w.isdigit() for k in keys_of_seen(w)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["key", "seen", "mine"])


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, w, n) for w, n in zip(*(c.to_pylist() for c in batch.columns)) if len(w) >= 3 for k in keys_of_lexicon(w)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["key", "word", "n"])


CANDIDATES = "array<struct<cost:double,word:string>>"


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("cost", pa.float64()), ("word", pa.string())]))
    for batch in batches:
        words, out = [], []
        for seen, near in zip(*(c.to_pylist() for c in batch.columns)):
            some = sorted((cost - 0.08 * log(x["n"]), x["word"]) for x in near if within(seen, x["word"]) and (cost := distance(seen, x["word"])) <= MOST_COST)
            if some:
                words.append(seen)
                out.append([{"cost": c, "word": w} for c, w in some])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(out, kind)], ["word", "candidates"])


def candidates(seen: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n, candidates`` of the words ``seen`` that the lexicon has or that may be misread.

    Candidates are words of the lexicon, at least ten times as frequent, within two edits and the cost of a repair, the best first.
    """
    counted = cut(seen.join(words, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    left = counted.select("word", "n").mapInArrow(_seen_keys, "key bigint, seen string, mine bigint")
    index = words.select("word", "n").mapInArrow(_index_keys, "key bigint, word string, n bigint")
    near = left.join(index, "key").where("n >= 10 * mine + 5 and word <> seen").groupBy("seen").agg(F.collect_set(F.struct("word", "n")).alias("near"))
    found = near.mapInArrow(_costs, f"word string, candidates {CANDIDATES}")
    return counted.join(found, "word", "left").where("n > 0 or candidates is not null")


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) of the hashes of words; it lets through a few more."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.array([_slot(w) for b in batches for w in b.column(0).to_pylist()], np.int64))
        for part in np.split(at, np.flatnonzero(np.diff(at >> 16)) + 1):
            if len(part):
                bits = np.zeros(1 << 16, bool)
                bits[part & 0xFFFF] = True
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> 16)], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in words.select("word").mapInArrow(slots, "block int, bits binary").toLocalIterator():
        at = r["block"] << 13
        out[at : at + 8192] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _slot(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1)


def _questions(shared):
    """Of each text the words that may be misread, with the word before where that may decide, and the parts of broken words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        misread, ambiguous = shared.value
        known: dict[str, int] = {}

        def kind(w: str) -> int:
            k = known.get(w)
            if k is None:
                if len(known) > 300_000:
                    known.clear()
                at = _slot(w)
                k = known[w] = (1 if misread[at >> 3] & (128 >> (at & 7)) else 0) + (1 if ambiguous[at >> 3] & (128 >> (at & 7)) else 0)
            return k

        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                rows = {(w, None if part or k < 2 else before) for w, before, part in asked(t) if (k := kind(w)) or part}
                for w, before in rows:
                    for col, v in zip(out, (i, w, before)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string()))], ["id", "word", "before"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of the pairs that a word makes with each of its candidates, behind the word before as it stands or as it is repaired."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for word, before, some, first in zip(*(batch.column(k).to_pylist() for k in ("word", "before", "candidates", "first"))):
            for x in some:
                for col, v in zip(out, (word, before, x["cost"], x["word"], pair_code(first or before, x["word"]))):
                    col.append(v)
        types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["word", "before", "cost", "good", "code"])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, t, defects, facts in zip(*(batch.column(k).to_pylist() for k in ("id", "laid", "defects", "facts"))):
            rows.append((i, *repair(t, defects, Facts((f["word"], f["before"], f["n"], f["good"], f["first"]) for f in facts or ()))))
        cols = list(zip(*rows)) or [(), (), ()]
        types = (pa.int64(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "repaired", "defects"])


def repaired_scans(files: DataFrame, id_col: str = "id", text_col: str = "extracted_text", name_col: str = "filename") -> DataFrame:
    """``id, repaired, defects`` of each scanned file with a text: paragraphs parted by a blank line, and the defects repaired.

    A file is scanned if its name has the ending of a scanner's format. The lexicon is counted over the texts of all files.
    ``defects`` is empty where the text needed no repair. Null and empty texts and null names give no row; of rows of an
    id that come twice one is kept (their texts are the same). Other columns are ignored whatever their names.
    """
    spark = files.sparkSession
    bound_arrow(spark)
    x = files.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lower(F.regexp_extract(F.col(name_col), r"(\.\w+)$", 1)).alias("ending"))
    x = spread(x.where("id is not null and text is not null and text <> ''"))
    words, pairs = lexicon(x)
    laid = cut(x.where(F.col("ending").isin(SCANNED)).select("id", "text").mapInArrow(_laid_out, "id bigint, laid string, defects array<string>").dropDuplicates(["id"]))
    known = cut(candidates(laid.select("laid").mapInArrow(_words, "word string").distinct(), words))
    misread = known.where("candidates is not null")
    shared = spark.sparkContext.broadcast((_bitmap(misread), _bitmap(misread.where(F.size("candidates") > 1))))
    told = cut(laid.select("id", "laid").mapInArrow(_questions(shared), "id bigint, word string, before string").join(known, "word"))
    # the word before chooses among several candidates; it is itself repaired to its best candidate
    several = told.where("before is not null and size(candidates) > 1").select("word", "before", "candidates").dropDuplicates(["word", "before"])
    firsts = misread.select(F.col("word").alias("before"), F.col("candidates")[0]["word"].alias("first"))
    coded = several.join(firsts, "before", "left").mapInArrow(_contexts, "word string, before string, cost double, good string, code bigint")
    scored = coded.join(pairs, "code", "left").select("word", "before", "good", (F.col("cost") - 0.25 * F.log(1 + F.coalesce("n", F.lit(0)))).alias("cost"))
    chosen = scored.groupBy("word", "before").agg(F.min(F.struct("cost", "good"))["good"].alias("chosen"))
    first = F.col("candidates")[0]["word"].alias("first")
    facts = told.join(chosen, ["word", "before"], "left").groupBy("id").agg(F.collect_list(F.struct("word", "before", "n", F.col("chosen").alias("good"), first)).alias("facts"))
    return laid.join(facts, "id", "left").mapInArrow(_repairs, "id bigint, repaired string, defects array<string>")


def scan_defects(files: DataFrame) -> DataFrame:
    """``id, defect``, one row per defect of :func:`repaired_scans`."""
    return repaired_scans(files).select("id", F.explode("defects").alias("defect"))
