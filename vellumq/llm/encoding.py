"""Texts garbled by a wrong character encoding.

Garbled segments are joined with clean near-twins: segments that are equal when each run of digits counts as one and only the place of a
character that is not ASCII is kept. A twin pair has such a run of characters wherever the other has one, of the same length
(one sign for each character) or of the length in UTF-8 (one sign for each byte). Both are aligned character by character; a pair
whose characters don't map one to one is no twin. All twins of a segment are aligned; they meet by their shape and by which of their foreign
characters are equal, so that only those meet that map one to one. A twin by chance shows in that no transformation holds most of what
it aligns. The aligned characters of the other pairs are added up, and the transformations that
explain them are taken one after the other, the best first: a transformation is a pair of code tables (any of Python's single-byte
tables, or UTF-8, read by any single-byte table) that holds what was aligned, which completes it for characters that no twin has; what no
tables explain stays as it was learned. Nothing is restored that was not learned from twins. The learned mappings are applied
to all records, repeatedly where a text was garbled more than once, if a character bigram model counted over the whole corpus
finds that a segment gets more like the corpus.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from encodings.aliases import aliases
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumq.session import bound_arrow, cut, spread

RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
GERMAN = "äöüßÄÖÜ"
SIGNS = "«»№—–“”„’‘…€©®°§·×éèêàáâãåæçíîïñóôõøúûýþðœšžÉÈÀÁÂÃÅÆÇÍÎÑÓÔÕØÚÛÝÞÐŒŠŽ\xa0"
USUAL = set(map(chr, range(128))) | set(RUSSIAN + GERMAN + "«»№—–")

#: What makes a segment worth a try: unusual signs, lower case before capitals, long runs of capitals or of Latin-1 letters, mixed scripts.
_PLAIN = re.compile(rf"№|[—–]|[«“„]?(?:[{RUSSIAN}]+|[A-Za-z{GERMAN}]+)[»”“]?")
#: A word that mixes scripts only by letters of the same shape, as misread scans do.
MISREAD = re.compile("(?=.*[А-яЁё])(?=.*[aAcCeEoOpPxXyYKMHTBbgru3064lI1])[А-яЁёaAcCeEoOpPxXyYKMHTBbgru3064lI1-]+")
_FINE = USUAL | set(SIGNS)
SUSPECT = re.compile(
    r"[^\x00-\x7fА-яЁёÄÖÜäöüß«»№—–“”─-╏║-╿\xac\xad‐]|[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4}|[a-z][А-яЁё]|[А-яЁё][a-z]|[а-яё][А-ЯЁ](?![а-яёА-ЯЁ])|[╨╤][^═║╔╗╚╝╦╩╠╣╬]|[╧╦╚╩][^═║╔╗╚╝╦╩╠╣╬]"
)
LOST = re.compile("�")
SEGMENT = re.compile(r"[^\n.!?]+[\n.!?]*[ \t]*|[\n.!?]+[ \t]*")


@lru_cache
def bytes_of(read_as: str) -> dict[str, int]:
    """The byte behind each non-ASCII character; bytes without a character stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(read_as)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache
def single_byte_tables() -> list[str]:
    """All encodings of Python that give each byte one character and keep ASCII; of equal tables the first, the most usual ones before."""
    usual = ["cp1251", "cp1252", "latin_1", "koi8_r", "cp866", "cp437", "cp850", "mac_cyrillic", "mac_roman", "iso8859_5"]
    out, seen = [], set()
    for name in [*usual, *sorted(set(aliases.values()))]:
        try:
            if bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
            table = tuple(sorted(bytes_of(name).items()))
            known = sum(not 0x80 <= ord(c) < 0xA0 for c, _ in table)  # bytes without a character stand for themselves
            if len(table) == 128 and known >= 80 and table not in seen:
                seen.add(table)
                out.append(name)
        except (LookupError, UnicodeError):
            continue
    return out


@lru_cache
def letter_map(read_as: str, written: str) -> dict[str, str]:
    """Garbled character to right one, for two single-byte encodings."""
    good, out = set(RUSSIAN + GERMAN + SIGNS), {}
    for c, b in bytes_of(read_as).items():
        try:
            r = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if r in good:
            out[c] = r
    return out


@lru_cache
def utf8_map(read_as: str) -> dict[str, str]:
    """The sequences that UTF-8 bytes of known characters become."""
    char = {b: c for c, b in bytes_of(read_as).items()}
    between = "".join(c for r in ("cp1251", "cp1252", read_as) for c in bytes_of(r))  # what a text garbled twice holds in between
    return {"".join(char[b] for b in c.encode()): c for c in dict.fromkeys(RUSSIAN + GERMAN + SIGNS + between)}


class Mapping:
    """A transformation undone: garbled unit (a character, or those that the UTF-8 bytes of one became) to the right character."""

    def __init__(self, name: str, table: dict[str, str]):
        self.name, self.table = name, table
        self.wide = any(len(k) > 1 for k in table)
        if self.wide:
            units = sorted(map(re.escape, table), key=len, reverse=True)
            self.pattern = re.compile("(?:" + "|".join(units) + ")+")
            self.first, self.further = frozenset(k[0] for k in table), frozenset(c for k in table for c in k[1:])
            self.sizes = sorted({len(k) for k in table}, reverse=True)
        else:
            self.keys = frozenset(table)
            self.signs = {ord(k): v for k, v in table.items()}


#: Classes of characters for the bigram model.
_KNOWN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + GERMAN + RUSSIAN
_CLASS = {c: i + 3 for i, c in enumerate(_KNOWN)}
WIDTH = len(_KNOWN) + 6
_EDGE, _LATIN_X, _CYRILLIC_X, _SIGN = 0, WIDTH - 3, WIDTH - 2, WIDTH - 1


def char_class(c: str) -> int:
    """0 for anything between words, 1 for digits, a number for known letters, three classes for foreign signs."""
    if c in _CLASS:
        return _CLASS[c]
    o = ord(c)
    if c.isdigit() and o < 128:
        return 1
    if o < 128 or c in "«»№—–“”„’…‐\xad\xac" or 0x2500 <= o < 0x2580 and o != 0x2568 and o != 0x2564:
        return _EDGE
    if 0xC0 <= o < 0x250:
        return _LATIN_X
    if 0x400 <= o < 0x530:
        return _CYRILLIC_X
    return _SIGN


_TABLE = np.array([char_class(chr(i)) if not 0xD800 <= i < 0xE000 else _SIGN for i in range(0x3000)], np.uint8)


def classes(text: str) -> np.ndarray:
    """Class of each character, with an edge on either side."""
    u = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(u) + 2, np.int64)
    out[1:-1] = _TABLE[np.minimum(u, 0x2FFF)]
    return out


def model(first: DataFrame) -> np.ndarray:
    """Log probabilities of character bigrams over all texts, from the first pass: a table of fixed size."""
    n = np.zeros((WIDTH, WIDTH))
    for r in first.where("segment is null").groupBy("key").agg(F.sum("n").alias("n")).collect():
        n[r["key"] // WIDTH, r["key"] % WIDTH] = r["n"]
    # garbled text is in the counts too: what is below a share of all letters counts as never seen
    n = np.maximum(n - 2e-3 * n.sum(axis=1, keepdims=True), 0)
    n[_LATIN_X:] = n[:, _LATIN_X:] = 0
    p = (n + 1e-9) / (n.sum(axis=1, keepdims=True) + 1e-9 * WIDTH)
    return np.maximum(np.log(np.maximum(p, 1e-12)), -9.0)


_KIND = np.full(0x3000, 8, np.uint8)
for _i in range(0x3000):
    _c = chr(_i)
    if _c in RUSSIAN:
        _KIND[_i] = 2 if _c.isupper() else 1
    elif _i < 128:
        _KIND[_i] = 4 if _c.isalpha() else 0
    elif _c in GERMAN + "«»№—–“”‐\xac\xad" or 0x2500 <= _i < 0x2580 and _c not in "╨╤╧╦╚╩":
        _KIND[_i] = 0


def suspect(t: str) -> bool:
    """Whether any part of a text is worth a try, by array operations; true wherever SUSPECT or LOST matches."""
    k = _KIND[np.minimum(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), 0x2FFF)]
    if (k == 8).any():
        return True
    low, up, latin = k == 1, k == 2, k == 4
    if (low[:-1] & up[1:]).any() or (up[3:] & up[2:-1] & up[1:-2] & up[:-3]).any():
        return True
    russian = low | up
    return bool((latin[:-1] & russian[1:]).any() or (russian[:-1] & latin[1:]).any())


#: A word of a text that may be garbled: all but ASCII white space, digits and signs.
_WORD = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


class Restorer:
    """Finds and restores garbled segments with the mappings given."""

    def __init__(self, logp: np.ndarray, learned: list[Mapping]):
        self.logp = logp
        self.wide = [m for m in learned if m.wide]
        self.single = [m for m in learned if not m.wide]
        self.known: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Log probability of a word, kept while few are."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            c = classes(word)
            out = self.known[word] = float(self.logp[c[:-1], c[1:]].sum())
        return out

    def utf8(self, text: str, mapping: Mapping) -> tuple[str, int]:
        """Sequences of UTF-8 read as another encoding put right, and how many letters they were.

        A single short sequence between other signs may be chance; it counts where longer ones stand in the segment,
        or where it is all that is not ASCII in its word.
        """
        pattern, seq, sizes = mapping.pattern, mapping.table, mapping.sizes
        if not pattern.search(text):
            return text, 0
        count = sure = 0

        def right(m: re.Match) -> str:
            nonlocal count, sure
            s, out, i = m.group(), [], 0
            while i < len(s):
                for k in sizes:
                    if s[i : i + k] in seq:
                        out.append(seq[s[i : i + k]])
                        i += k
                        break
            count += len(out)
            alone = len(out) > 1 or len(s) > 2
            if not alone and s[0] not in RUSSIAN:
                around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
                alone = around.isascii()
            # letters that a text of the corpus may hold anyway prove nothing
            sure += alone and any(c not in USUAL for c in s)
            return "".join(out)

        t = pattern.sub(right, text)
        return (t, count) if sure else (text, 0)

    def further(self, t: str) -> str:
        """A text that was garbled more than once, with all further layers undone; of several mappings the one that leaves fewest strange characters."""
        while True:
            tries = [(sum(c not in _FINE for c in u), place, u) for place, (u, n) in enumerate(self.utf8(t, m) for m in self.wide) if n and len(u) < len(t)]
            if not tries:
                return t
            t = min(tries)[2]

    def segment(self, s: str) -> tuple[str, Mapping | None]:
        """The segment restored, and the mapping that did it."""
        if s.isascii() or not SUSPECT.search(s):
            return s, None
        best = None
        there = frozenset(s)
        for place, mapping in enumerate(self.wide):
            if there.isdisjoint(mapping.first) or there.isdisjoint(mapping.further):
                continue
            t, n = self.utf8(s, mapping)
            if n and t != s:
                t = self.further(t)
                strange = sum(c not in _FINE for c in t)
                rank = (n - 2 * strange, -place)
                if n > 2 * strange and (best is None or rank > best[0]):
                    best = (rank, t, mapping)
        if best:
            return best[1], best[2]
        words = {w: frozenset(c for c in w if c > "\x7f") for w in set(_WORD.findall(s)) if not w.isascii()}
        if all(map(MISREAD.fullmatch, (w for w in words if SUSPECT.search(w)))):
            return s, None  # a few letters of the other script with the same shape
        top = None
        for which in self.single:
            gain, changed = 0.0, {}
            for w, signs in words.items():
                if signs <= which.keys:
                    v = w.translate(which.signs)
                    d = self.score(v) - self.score(w)
                    if d > 0 and v != w:
                        gain += d
                        changed[w] = v
            if gain > (top[0] if top else 0) and all(map(_PLAIN.fullmatch, changed.values())):
                top = (gain, changed, which)
        if top is None:
            return s, None
        gain, changed, which = top
        letters = sum(map(len, changed))
        after = sum(self.score(v) for v in changed.values()) / (letters + len(changed))
        # one short word is enough if it holds a sign that no language of the corpus has, or two scripts
        sure = any(any(char_class(c) == _SIGN for c in w) or not _one_script(w) for w in changed)
        if gain < (3.0 if sure else 10.0) or after < -3.6 or (gain / letters < 0.9 and not sure):
            return s, None
        return self.by_table(s, which, words, changed), which

    def by_table(self, s: str, which: Mapping, words: dict[str, frozenset], changed: dict[str, str]) -> str:
        """The segment with the changed words, and with those others that the mapping makes no less likely by much."""
        table, keys = which.signs, which.keys
        for w, signs in words.items():
            if w not in changed and signs <= keys:
                v = w.translate(table)
                if _PLAIN.fullmatch(v) and self.score(v) - self.score(w) > -2.0:
                    changed[w] = v
        return s.translate(table) if len(changed) == len(words) else _WORD.sub(lambda m: changed.get(m.group(), m.group()), s)

    def alike(self, s: str, proved: list[Mapping]) -> str | None:
        """A suspect segment under that mapping by which it gains most, of those that other segments of its text proved; none if it gains nothing."""
        gain, out = max((self._alike(s, which) for which in proved), key=lambda x: x[0])
        return out if gain > 3.0 else None

    def _alike(self, s: str, which: Mapping) -> tuple[float, str]:
        table, keys = which.signs, which.keys
        words = {w: frozenset(c for c in w if c > "\x7f") for w in set(_WORD.findall(s)) if not w.isascii()}
        changed = {w: v for w, signs in words.items() if signs <= keys and _PLAIN.fullmatch(v := w.translate(table)) and self.score(v) > self.score(w)}
        gain = sum(self.score(v) - self.score(w) for w, v in changed.items())
        return gain, self.by_table(s, which, words, changed)

    def text(self, t: str) -> tuple[str, str | None, int]:
        """The text restored, how it was garbled (null if it was not), and the number of garbled segments."""
        if t.isascii() or not suspect(t):
            return t, None, 0
        out, how, n = [], None, 0
        proved: list[Mapping] = []
        open_: list[int] = []
        for s in SEGMENT.findall(t):
            r, which = self.segment(s)
            if which:
                n += 1
                how = how or which.name
                if not which.wide and which not in proved:
                    proved.append(which)
            elif not s.isascii() and SUSPECT.search(s):
                open_.append(len(out))
            out.append(r)
        for i in open_ if proved else ():
            if (r := self.alike(out[i], proved)) is not None:
                out[i] = r
                n += 1
        fixed = "".join(out)
        if LOST.search(fixed):
            return fixed, how or "characters lost", n + 1
        return fixed, how, n


def _one_script(w: str) -> bool:
    latin = any("A" <= c <= "z" or c in GERMAN for c in w)
    return not (latin and any(c in RUSSIAN for c in w))


# ---------------------------------------------------------------- learning from near-twins

#: Bits of a key that the bitmap of garbled segments keeps.
KEY_BITS = 28
_MASK = bytes(range(48)) + b"0" * 10 + bytes(range(58, 128)) + b"?" * 128
_DIGITS = re.compile(rb"00+")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def shape(s: str, wide: bool) -> bytes:
    """A segment with one 0 for each run of digits and a ? for each character that is not ASCII, or for each of its bytes in UTF-8."""
    return _DIGITS.sub(b"0", (s.encode("utf-8", "replace") if wide else s.encode("ascii", "replace")).translate(_MASK))


def key_of(shaped: bytes) -> int | None:
    """A hash of a shape, if it has words enough to tell a segment from others: 12 signs beside white space, in three words."""
    words = shaped.split()
    return xxhash.xxh3_64_intdigest(shaped) >> 1 if len(words) >= 3 and sum(map(len, words)) >= 12 else None


def class_of(key: int, lens: str, units: Iterable[str]) -> int:
    """A hash of a shape's key, the lengths of the clean characters in UTF-8 (none if each is one sign) and which units are equal.

    Units map one to one only to those of the same class.
    """
    first: dict[str, int] = {}
    return xxhash.xxh3_64_intdigest(lens.encode() + array("I", [first.setdefault(u, len(first)) for u in units]).tobytes(), key) >> 1


def _twin(key: int, wide: bool, s: str) -> tuple[int, str, int, str, int]:
    """A row of ``TWIN``: with ``lens`` if the twin is one of sequences of UTF-8, and a hash of its text."""
    runs = _FOREIGN.findall(s)
    signs = "".join(runs)
    lens = "".join(str(len(c.encode("utf-8", "replace"))) for c in signs) if wide else ""
    return key, lens, class_of(key, lens, signs), " ".join(runs), xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) >> 1


TWIN = "key bigint, lens string, class bigint, twin string, id bigint"
_TWIN_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _segments(t: str) -> Iterable[str]:
    return (s.strip(" \t\r\n") for s in SEGMENT.findall(t) if not s.isascii())


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character bigrams (key: cell) and, with their shapes' keys, the segments that may be garbled."""
    total = np.zeros(WIDTH * WIDTH, np.int64)
    names = ["key", "n", "segment"]

    def rows(keys, counts, segments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(segments, pa.string())], names)

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        text = "\n".join(texts)
        for at in range(0, len(text), 1 << 20):
            c = classes(text[at : at + (1 << 20)])
            total += np.bincount(c[:-1] * WIDTH + c[1:], minlength=WIDTH * WIDTH)
        found = {s for t in texts if not t.isascii() and suspect(t) for s in _segments(t) if SUSPECT.search(s)}
        keyed = [(k, s) for s in found if (k := key_of(shape(s, False))) is not None]
        yield rows([k for k, _ in keyed], [None] * len(keyed), [s for _, s in keyed])
    cells = np.flatnonzero(total)
    yield rows(cells, total[cells], [None] * len(cells))


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = np.unique(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() & ((1 << KEY_BITS) - 1) for b in batches)]))
    for part in np.split(slots, np.flatnonzero(np.diff(slots >> 16)) + 1):
        if len(part):
            bits = np.zeros(1 << 16, bool)
            bits[part & 0xFFFF] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> 16)], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["block", "bits"])


def _twins(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, mask = bits.value, (1 << KEY_BITS) - 1
        for batch in batches:
            found: set[tuple[int, str, int, str, int]] = set()
            for t in batch.column(0).to_pylist():
                if not t or t.isascii():
                    continue
                some = suspect(t)
                for s in _segments(t):
                    if some and SUSPECT.search(s):
                        continue
                    for wide in (False, True):
                        k = key_of(shape(s, wide))
                        if k is not None and there[(k & mask) >> 3] & (128 >> (k & 7)):
                            found.add(_twin(k, wide, s))
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TWIN_TYPES)], ["key", "lens", "class", "twin", "id"])

    return run


def align(garbled: str, clean: str, wide: bool) -> dict[str, str]:
    """Garbled unit to clean character of a segment and its twin, position by position; empty if they don't map one to one.

    With ``wide`` a unit is as many characters as the clean one has bytes in UTF-8. Letters that stay or only change their case tell nothing;
    if these are most, the pair differs by a slip of a letter or by capitals and is no garbling.
    """
    g, c = _FOREIGN.findall(garbled), _FOREIGN.findall(clean)
    out: dict[str, str] = {}
    back: dict[str, str] = {}
    if len(g) != len(c):
        return out
    same = told = 0
    for a, b in zip(g, c):
        at = 0
        for x in b:
            unit = a[at : at + (len(x.encode()) if wide else 1)]
            at += len(unit)
            if not unit or out.setdefault(unit, x) != x or back.setdefault(x, unit) != unit:
                return {}
            if unit.casefold() == x.casefold():
                same += x.isalpha()
            else:
                told += 1
        if at != len(a):
            return {}
    return {u: x for u, x in out.items() if u.casefold() != x.casefold()} if told > same else {}


@lru_cache
def transformations() -> tuple[list[tuple[str, dict[str, str]]], dict[tuple[str, str], int], np.ndarray]:
    """All pairs of code tables with their units, the place of each unit and character, and there the bits of the pairs of tables that hold it."""
    tables = single_byte_tables()
    known = [(f"utf-8 read as {r}", utf8_map(r)) for r in tables] + [(f"{w} read as {r}", letter_map(r, w)) for w in tables for r in tables if r != w]
    place: dict[tuple[str, str], int] = {}
    for _, table in known:
        for p in table.items():
            place.setdefault(p, len(place))
    held = np.zeros((len(place), (len(known) + 7) // 8), np.uint8)
    for i, (_, table) in enumerate(known):
        held[[place[p] for p in table.items()], i >> 3] |= 128 >> (i & 7)
    return known, place, held


def told(pairs: dict[str, str]) -> set[tuple[str, str]]:
    """Of the characters that two segments align, those that the transformations hold which hold most of them; none if that is not more than half."""
    _, place, held = transformations()
    some = [p for p in pairs.items() if p in place]
    if 2 * len(some) <= len(pairs):
        return set()
    bits = np.unpackbits(held[[place[p] for p in some]], axis=1)
    n = bits.sum(axis=0, dtype=np.int64)
    if 2 * n.max() <= len(pairs):
        return set()
    return {p for p, there in zip(some, bits[:, n == n.max()].any(axis=1)) if there}


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of garbled segments for the lengths of the clean characters that twins of their shape have."""
    for batch in batches:
        out = []
        for key, lens, s, n in zip(*(batch.column(k).to_pylist() for k in ("key", "lens", "segment", "n"))):
            runs = _FOREIGN.findall(s)
            units, at = "".join(runs), 0
            if lens:
                ends = np.cumsum([int(x) for x in lens]).tolist()
                units = [units[i:j] for i, j in zip([0, *ends], ends)]
            out.append((class_of(key, lens, units), lens != "", " ".join(runs), n))
        cols = list(zip(*out)) or [()] * 4
        types = (pa.int64(), pa.bool_(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["class", "wide", "segment", "n"])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[tuple[str, str]] = Counter()
    other: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for wide, s, n, twin in zip(*(batch.column(k).to_pylist() for k in ("wide", "segment", "n", "twin"))):
            pairs = align(s, twin, wide)
            sure = told(pairs)
            for pair in sure or pairs.items():
                (total if sure else other)[pair] += n
    cols = list(zip(*((*k, total[k], other[k]) for k in total | other))) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["unit", "right", "n", "other"])


UNKNOWN = "an unknown table"


def explain(votes: dict[tuple[str, str], int], least_votes: int = 12, least_units: int = 3, other: dict[tuple[str, str], int] | None = None) -> list[Mapping]:
    """The transformations behind aligned characters, those that explain most first.

    ``votes`` counts the twin pairs in which a unit stands for a character. In each round the pair of code tables that holds most of the votes
    left is taken, with all characters that its tables know, if at least ``least_votes`` in ``least_units`` different units are left for it.
    What no tables explain makes mappings of its own where a unit clearly stands for one character. ``other`` counts the pairs of segments
    that no tables explain, beside no character what a unit stands for else.
    """
    left, other = dict(votes), Counter(other or {})
    built = [(name, set(table.items())) for name, table in transformations()[0]]
    out: list[Mapping] = []
    while built:
        best = None
        rest = []
        for name, pairs in built:
            some = pairs.intersection(left)
            n = sum(left[p] for p in some)
            if n >= least_votes and len(some) >= least_units:
                rest.append((name, pairs))
                if best is None or n > best[0]:
                    best = (n, name, pairs)
        if best is None:
            break
        n, name, pairs = best
        out.append(Mapping(name, dict(pairs)))
        for p in pairs:
            left.pop(p, None)
            other.pop(p, None)
        built = [x for x in rest if x[0] != name]
    other.update(left)
    for wide in (True, False):
        own: dict[str, tuple[int, str]] = {}
        total: Counter[str] = Counter()
        for (u, x), n in other.items():
            if (len(u) > 1) == wide:
                total[u] += n
                own[u] = max(own.get(u, (0, "")), (n, x))
        table = {u: x for u, (n, x) in own.items() if x and n >= 4 * least_votes and n >= 0.9 * total[u]}
        if len(table) >= 4 * least_units:
            out.append(Mapping(UNKNOWN, table))
    return out


def _votes(garbled: DataFrame, twins: DataFrame, least: int) -> tuple[dict[tuple[str, str], int], dict[tuple[str, str], int]]:
    """Aligned characters of ``key, segment, n`` and all twins (``TWIN``): those of segments that tables explain, and of the others.

    A segment votes once for each way in which its twins differ from it, and once more where a second twin differs from it so. What tables hold is bounded by
    the tables; of the rest come those pairs that ``least`` segments have in common, and for each of their units the number of all others.
    """
    twins = cut(twins.groupBy("key", "lens", "class", "twin").agg((1 + (F.min("id") < F.max("id")).cast("bigint")).alias("times")))
    forms = twins.select("key", "lens").distinct()
    sides = garbled.join(forms, "key").mapInArrow(_classes, "class bigint, wide boolean, segment string, n bigint")
    sides = sides.groupBy("class", "wide", "segment").agg(F.sum("n").alias("n"))
    pairs = sides.join(twins.select("class", "twin", "times"), "class").select("wide", "segment", (F.col("n") * F.col("times")).alias("n"), "twin")
    votes = pairs.mapInArrow(_vote, "unit string, right string, n bigint, other bigint")
    votes = votes.groupBy("unit", "right").agg(F.sum("n").alias("n"), F.sum("other").alias("other"))
    all_of = F.sum(F.col("n") + F.col("other")).over(Window.partitionBy("unit")).alias("total")
    rows = votes.select("*", all_of).where((F.col("n") > 0) | (F.col("other") >= least)).collect()
    other = Counter({(r["unit"], r["right"]): r["other"] for r in rows if r["other"]})
    for unit, total in {r["unit"]: r["total"] for r in rows}.items():
        other[unit, ""] = total
    for r in rows:
        other[r["unit"], ""] -= r["n"] + r["other"]
    return {(r["unit"], r["right"]): r["n"] for r in rows if r["n"]}, other


def _windows(shared):
    """Two neighbouring words with foreign characters beside ASCII ones: of segments that a mapping restores as clean twins, of the others as garbled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for s in batch.column(0).to_pylist():
                if sum(c < "\x80" for c in s) < 0.5 * len(s):
                    continue  # hardly any ASCII to tell windows by
                t, mapping = fix.segment(s)
                w = t.split()
                for a, b in zip(w, w[1:]):
                    x = f"{a} {b}"
                    if not x.isascii() and sum("!" <= c <= "~" for c in x) >= 6:
                        keys = [xxhash.xxh3_64_intdigest(shape(x, wide)) >> 1 for wide in ((False, True) if mapping else (False,))]
                        out += [_twin(k, wide, x) for k, wide in zip(keys, (False, True))] if mapping else [(keys[0], None, None, x, None)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TWIN_TYPES)], ["key", "lens", "class", "twin", "id"])

    return run


def learned(texts: DataFrame, first: DataFrame, logp: np.ndarray, least_votes: int = 12) -> list[Mapping]:
    """The mappings learned from garbled segments (of the first pass) and their clean near-twins.

    The keys of the garbled segments go to all tasks as a bitmap of fixed size (32 MB); the join itself is on the
    full keys. To the driver come the aligned characters that code tables hold, and of the others those that make a mapping of their own. Segments that are restored then
    serve as clean twins for those that are not, by pairs of words, until nothing more is learned.
    """
    share = texts.sparkSession.sparkContext.broadcast
    suspects = cut(first.where("segment is not null").select("key", "segment").distinct())
    blocks = suspects.select("key").mapInArrow(_bitmap, "block int, bits binary")
    bits = np.zeros(1 << (KEY_BITS - 3), np.uint8)
    for r in blocks.toLocalIterator():
        at = r["block"] << 13
        bits[at : at + 8192] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    twins = texts.select("text").mapInArrow(_twins(share(bits)), TWIN)
    votes, other = _votes(suspects.withColumn("n", F.lit(1).cast("bigint")), twins, 4 * least_votes)
    out = explain(votes, least_votes, other=other)
    more = out
    while more:
        windows = cut(suspects.select("segment").mapInArrow(_windows(share((logp, out))), TWIN))
        garbled = windows.where("lens is null").groupBy("key", F.col("twin").alias("segment")).agg(F.count("*").alias("n"))
        known, there = {m.name for m in out}, {p for m in out for p in m.table.items()}
        votes, other = _votes(garbled, windows.where("lens is not null"), 4 * least_votes)
        more = [m for m in explain(votes, least_votes, other=other) if (m.name not in known if m.name != UNKNOWN else not m.table.items() <= there)]
        out = out + more
    return out


def prepared(texts: DataFrame) -> tuple[np.ndarray, list[Mapping]]:
    """The bigram model and the learned mappings of texts."""
    bound_arrow(texts.sparkSession)
    first = cut(texts.select("text").mapInArrow(_first_pass, "key bigint, n bigint, segment string"))
    logp = model(first)
    return logp, learned(texts, first, logp)


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(*shared.value)
        for batch in batches:
            out = [(n, i, *fix.text(t)) for n, i, t in zip(*(c.to_pylist() for c in batch.columns)) if t]
            cols = list(zip(*(r for r in out if r[3]))) or [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["table_name", "row_id", "restored", "how", "n_segments"])

    return run


def garbled_rows(texts: DataFrame) -> DataFrame:
    """Garbled rows of ``table_name, row_id, text``: ``table_name, row_id, how, n_segments, restored``.

    ``how`` names the transformation of the first garbled segment, or says that characters are lost (U+FFFD);
    ``restored`` is the text with all garbled segments put right where a mapping does. A transformation of which the texts hold too few
    garbled segments with clean twins is not found. Rows with null or empty texts are never garbled; rows that come twice count once.
    """
    texts = spread(texts.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text").where("text is not null and text <> ''"))
    shared = texts.sparkSession.sparkContext.broadcast(prepared(texts))
    found = texts.mapInArrow(_apply(shared), "table_name string, row_id bigint, restored string, how string, n_segments int")
    return found.dropDuplicates(["table_name", "row_id"]).select("table_name", "row_id", "how", "n_segments", "restored")


def texts_of(files: DataFrame, results: DataFrame) -> DataFrame:
    """The texts of both tables as ``table_name, row_id, text``."""
    a = files.select(F.lit("files").alias("table_name"), F.col("id").alias("row_id"), F.col("extracted_text").alias("text"))
    return a.unionByName(results.select(F.lit("extraction_results").alias("table_name"), F.col("result_id").alias("row_id"), "text"))
