"""Personal data in free text, by a linear-chain conditional random field.

Features are the shape, ending and (frequent) form of the tokens in a window of five; the weights are trained on a small
labelled table and decoding is Viterbi over numpy batches. The labelled table is a bounded sample of the files whose entities were
computed: their entity lists and a few sure patterns label the tokens. As features depend on the token's type alone, a
document's scores are sums of table rows; tokens that are proved to be in no entity of the best labelling need
no decoding, and texts pass through Python once. Plain checks of the found spans follow (digits of a number, sign of an address).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.session import bound_arrow, spread

KINDS = ["person", "email", "phone", "id_number", "address"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N = len(LABELS)
PLACEHOLDER = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}

#: Tokens with the white space before them: e-mail addresses (plain or disguised), groups of digits, words, single signs.
_EMAIL = r"[\w.+-]*\w(?:@| ?\(at\)\s| ?\[at\] ?|\s\(at\)\s)\w[\w-]*(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)\w[\w-]*)+"
_NUMBER = r"\+?\(?\d[\d().-]*(?:[ \n\xa0][\d(][\d().-]*)*\d|\d"
TOKEN = re.compile(rf"\s*(?:{_EMAIL}|{_NUMBER}|[^\W\d_]+(?:-[^\W\d_]+)*|\S)", re.I)
#: The same for texts without a sign of an address, of which most are.
PLAIN_TOKEN = re.compile(rf"\s*(?:{_NUMBER}|[^\W\d_]+(?:-[^\W\d_]+)*|\S)")
EMAIL = re.compile(_EMAIL, re.I)
_DIGITS = str.maketrans("012345678", "999999999")
ROUNDS = 8
LEAN = 1.0
#: Pieces of the labelled table that differ in names and digits alone: so many are kept.
ALIKE = 5
GLUE = re.compile(r"[\w+/=]")
ODD = re.compile(r"[^\x00-\x7fА-яЁёÄÖÜäöüß«»№—–“”„…]+")
OFFSETS = (-2, -1, 0, 1, 2)


def tokens(text: str) -> list[str]:
    """The tokens of a text, each with the white space before it."""
    low = text.lower()
    return (TOKEN if "@" in text or "(at)" in low or "[at]" in low else PLAIN_TOKEN).findall(text)


def shape(w: str) -> str:
    """Letters and digits as classes; runs of letters as one, digits one by one."""
    s = re.sub(r"\d", "9", w)
    s = re.sub(r"[A-ZА-ЯЁÄÖÜ]", "X", s)
    s = re.sub(r"[a-zа-яёäöüß]", "x", s)
    s = re.sub(r"[^\x00-\x7f«»№—–“”„…]+", "o", s)  # signs of no language here, as in garbled text
    return re.sub(r"(x|X)\1{2,}", r"\1\1", s)


def features(token: str, known: set[str]) -> list[str]:
    """Features of a token alone."""
    w = token.strip()
    if EMAIL.fullmatch(w):
        return ["email"]
    low = w.lower()
    out = [f"s={shape(w)[:24]}"]
    if w[0].isalpha():
        script = "l" if low[0] < "ɐ" else "c"
        out += [f"e3={low[-3:]}", f"e2={script}{low[-2:]}", f"n={script}{min(len(w), 4)}{w[0].isupper()}{'-' in w}"]
    elif w[0].isdigit() or len(w) > 1:
        out.append(f"d={min(12, sum(c.isdigit() for c in w))}")
    if low in known:
        out.append(f"w={low}")
    if "\n\n" in token:
        out.append("break")
    return out


class Crf:
    """Weights of token features by offset, and of label pairs."""

    def __init__(self, index: dict[str, int], known: set[str], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.known = index, known
        self.weights = weights  # offset, feature, label
        self.pairs = pairs
        self.rows: dict[str, int] = {"": 0}  # row 0 is the empty token between texts
        self.table = np.zeros((1024, len(OFFSETS), N), np.float32)

    def row(self, token: str) -> int:
        """The table row with the scores that a token gives to its neighbourhood."""
        i = self.rows.get(token)
        if i is None and (same := token.translate(_DIGITS)) != token and token.strip().lower() not in self.known and "@" not in token:
            i = self.rows[token] = self.row(same)  # digits count by their number and place alone
        if i is None:
            f = [self.index[x] for x in features(token, self.known) if x in self.index]
            key = "\x00" + ",".join(map(str, f))
            i = self.rows.get(key)
            if i is None:
                i = self.rows[key] = len(self.rows)
                while i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[i] = self.weights[:, f].sum(axis=1)
            self.rows[token] = i
        return i

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores of labels for the tokens of one text, leaning to entities as the lists that taught lack some."""
        e = self.table[ids, 2].copy()
        e[:, 0] -= LEAN
        for k, o in enumerate(OFFSETS):
            if o < 0:
                e[-o:] += self.table[ids[:o], k]
            elif o > 0:
                e[:-o] += self.table[ids[o:], k]
        return e

    def forget(self, most: int = 400_000) -> None:
        if len(self.rows) > most:
            self.rows.clear()
            self.rows[""] = 0


def viterbi(runs: list[np.ndarray], pairs: np.ndarray) -> list[np.ndarray]:
    """Best labels of each run of token scores; a run is preceded and followed by O. Runs of like length go together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    into = np.ascontiguousarray(pairs.T)
    at = 0
    while at < len(order):
        size = len(runs[order[at]])
        stop = at
        while stop < len(order) and len(runs[order[stop]]) <= size * 1.2 + 2 and stop - at < 4096:
            stop += 1
        part = order[at:stop]
        at = stop
        longest = max(len(runs[i]) for i in part)
        e = np.zeros((len(part), longest, N), np.float32)
        e[:, :, 1:] = -1e4  # behind the end only O
        for r, i in enumerate(part):
            e[r, : len(runs[i])] = runs[i]
        best = e[:, 0] + pairs[0]
        flat = np.arange(len(part) * N)
        back = np.zeros((len(part), longest, N), np.int8)
        for t in range(1, longest):
            s = best[:, None, :] + into
            k = s.argmax(axis=2)
            back[:, t] = k
            best = s.reshape(-1, N)[flat, k.ravel()].reshape(-1, N) + e[:, t]
        last = (best + pairs[:, 0]).argmax(axis=1)
        path = np.zeros((len(part), longest), np.int64)
        path[:, -1] = last
        rows = np.arange(len(part))
        for t in range(longest - 1, 0, -1):
            last = back[rows, t, last]
            path[:, t - 1] = last
        for r, i in enumerate(part):
            out[i] = path[r, : len(runs[i])]
    return out


# ---------------------------------------------------------------- training


def _matrix(sequences: list[list[str]], index: dict[str, int], known: set[str]) -> list[list[list[int]]]:
    memo: dict[str, list[int]] = {}
    out = []
    for seq in sequences:
        ids = []
        for w in seq:
            if w not in memo:
                memo[w] = [index[x] for x in features(w, known) if x in index]
            ids.append(memo[w])
        out.append(ids)
    return out


def train(sequences: list[list[str]], labels: list[list[int]], rounds: int = ROUNDS, rate: float = 0.25, seed: int = 7) -> Crf:
    """Maximum likelihood with AdaGrad over batches; the expected counts come from forward-backward in numpy."""
    forms = Counter(w.strip().lower() for s in sequences for w in s)
    known = {w for w, n in forms.items() if n >= 4 and len(w) < 25}
    count: Counter[str] = Counter()
    for w, n in Counter(w for s in sequences for w in s).items():
        for x in features(w, known):
            count[x] += n
    index = {f: i for i, f in enumerate(f for f, n in sorted(count.items()) if n >= 2)}
    ids = _matrix(sequences, index, known)
    nf = len(index) + 1  # the last is padding
    width = max((len(x) for s in ids for x in s), default=1)
    weights, pairs = np.zeros((len(OFFSETS), nf, N), np.float32), np.zeros((N, N), np.float32)
    for i, a in enumerate(LABELS):  # I only after B or I of its kind
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                pairs[i, j] = -30
    allowed = pairs > -20
    gw, gp = np.full_like(weights, 1e-2), np.full_like(pairs, 1e-2)
    rng = np.random.default_rng(seed)
    order = np.array(sorted(range(len(ids)), key=lambda i: len(ids[i])))
    batches = [b for b in np.array_split(order, max(1, len(order) // 128)) if len(b)]
    for _ in range(rounds):
        for b in rng.permutation(len(batches)):
            part = batches[b]
            t_max = max(len(ids[i]) for i in part)
            f = np.full((len(part), t_max + 4, width), nf - 1, np.int64)
            y = np.zeros((len(part), t_max), np.int64)
            real = np.zeros((len(part), t_max), bool)
            for r, i in enumerate(part):
                for t, x in enumerate(ids[i]):
                    f[r, t + 2, : len(x)] = x
                y[r, : len(ids[i])] = labels[i]
                real[r, : len(ids[i])] = True
            e = np.zeros((len(part), t_max, N), np.float32)
            for k, o in enumerate(OFFSETS):
                e += weights[k][f[:, 2 + o : 2 + o + t_max]].sum(axis=2)
            e[~real] = -1e3
            e[~real, 0] = 0
            fw, bw = np.zeros_like(e), np.zeros_like(e)
            fw[:, 0] = e[:, 0] + pairs[0]
            for t in range(1, t_max):
                x = fw[:, t - 1, :, None] + pairs
                m = x.max(axis=1)
                fw[:, t] = e[:, t] + m + np.log(np.exp(x - m[:, None]).sum(axis=1))
            for t in range(t_max - 2, -1, -1):
                x = pairs + (e[:, t + 1] + bw[:, t + 1])[:, None, :]
                m = x.max(axis=2)
                bw[:, t] = m + np.log(np.exp(x - m[:, :, None]).sum(axis=2))
            z = fw[:, -1].max(axis=1)
            z = z + np.log(np.exp(fw[:, -1] - z[:, None]).sum(axis=1))
            g = -np.exp(np.minimum(fw + bw - z[:, None, None], 0))
            g[np.arange(len(part))[:, None], np.arange(t_max), y] += 1
            g[~real] = 0
            gt = np.zeros_like(pairs)
            if t_max > 1:
                joint = np.exp(np.minimum(fw[:, :-1, :, None] + pairs + (e[:, 1:] + bw[:, 1:])[:, :, None, :] - z[:, None, None, None], 0))
                joint[~real[:, 1:]] = 0
                gt -= joint.sum(axis=(0, 1))
                np.add.at(gt, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
            gt = np.where(allowed, gt, 0)
            gp += gt * gt
            pairs += rate * gt / np.sqrt(gp)
            at = f.reshape(-1)
            by = np.argsort(at, kind="stable")
            by = by[at[by] != nf - 1]
            used, first = np.unique(at[by], return_index=True)
            source = by // width
            shifted = np.zeros((len(part), t_max + 4, N), np.float32)
            for k, o in enumerate(OFFSETS):
                shifted[:] = 0
                shifted[:, 2 + o : 2 + o + t_max] = g
                sums = np.add.reduceat(shifted.reshape(-1, N)[source], first, axis=0) - 2e-3 * weights[k][used]
                gw[k][used] += sums * sums
                weights[k][used] += rate * sums / np.sqrt(gw[k][used])
    return Crf(index, known, weights[:, :-1], pairs)


# ---------------------------------------------------------------- the labelled table

#: Sure forms of the numbers, and words that name them.
_PHONE = [r"\+?[78][ -]?\(?9\d{2}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}", r"\+7\d{10}", r"\+1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}", r"\(\d{3}\) \d{3}-\d{4}", r"(?:\+49 |0)\d{2,4} \d{5}[ -]\d{3}"]
PHONE = re.compile("|".join(f"(?:{p})" for p in _PHONE))
_ID = [r"\d{3}-\d{3}-\d{3} \d{2}", r"\d{3}-\d{2}-\d{4}", r"\d{2} ?\d{2} \d{6}", r"\d{12}"]
IDENTITY = re.compile("|".join(f"(?:{p})" for p in _ID))
PASSPORT = re.compile(r"(?:паспорт|passport)\s+(?:серии\s+)?(\d{2} ?\d{2}\s+№\s*\d{6}|№\s*\d{10}|\d{2} ?\d{2}\s+\d{6})", re.I)
NOT_PERSONAL = re.compile(r"организаци|счёт|order|lot|bestell|заказ|конто|iban", re.I)
#: Types of the entity lists whose values are no personal data.
NEUTRAL = {"ORGANIZATIONS", "MONEY", "DATES"}


def squeeze(s: str) -> str:
    """White space runs as one space."""
    return re.sub(r"\s+", " ", s).strip()


def parse_entities(text: str | None) -> list[tuple[str, str]]:
    """``(type, value)`` of an entity list in JSON; of a list that is cut at the end, the values that are whole."""
    if not text:
        return []
    try:
        got = json.loads(text)
        if not isinstance(got, dict):
            return []
        return [(str(k), v) for k, vs in got.items() if isinstance(vs, list) for v in vs if isinstance(v, str)]
    except ValueError:
        pass
    out, key = [], None
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"\s*(:?)', text):
        try:
            s = json.loads(f'"{m.group(1)}"')
        except ValueError:
            continue
        if m.group(2):
            key = s
        elif key is not None:
            out.append((key, s))
    return out


def value_kind(kind: str, value: str) -> str | None:
    """What the labelled table takes an entry of a list to be; none if it is unsure, "-" if it is no personal data."""
    if EMAIL.fullmatch(value):
        return "email"
    if kind == "PERSONS" and not any(c.isdigit() for c in value):
        return "person"
    if kind == "CONTACTS":
        return "phone" if sum(c.isdigit() for c in value) >= 9 else None
    if kind == "DOCUMENTS":
        return "id_number"
    if kind == "LOCATIONS" and any(c.isdigit() for c in value):
        return "address"
    return "-" if kind in NEUTRAL else None


def labelled(text: str, entities: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Tokens of a text and their labels from the entity lists and the sure patterns."""
    toks = tokens(text)
    starts, ends, at = [], [], 0
    for w in toks:
        at += len(w)
        ends.append(at)
        starts.append(at - len(w.lstrip()))
    y = [0] * len(toks)
    where = {s: i for i, s in enumerate(starts)}
    stop = {e: i for i, e in enumerate(ends)}

    def mark(a: int, b: int, kind: str) -> None:
        i, j = where.get(a), stop.get(b)
        if i is None or j is None or any(y[i : j + 1]):
            return
        k = 1 + 2 * KINDS.index(kind)
        y[i : j + 1] = [k] + [k + 1] * (j - i)

    for m in EMAIL.finditer(text):
        mark(m.start(), m.end(), "email")
    for kind, value in sorted(set(entities), key=lambda x: -len(x[1])):
        k = value_kind(kind, value)
        if k in ("person", "address"):
            p = re.escape(value).replace(r"\ ", r"\s+")
            for m in re.finditer(rf"(?<!\w){p}(?!\w)", text):
                mark(m.start(), m.end(), k)
    for m in PASSPORT.finditer(text):
        a, b = m.span(1)
        mark(a + 1 + len(text[a + 1 : b]) - len(text[a + 1 : b].lstrip()) if text[a] == "№" else a, b, "id_number")
    for i, w in enumerate(toks):
        s = squeeze(w)
        if y[i] or not s[-1].isdigit():
            continue
        if PHONE.fullmatch(s):
            y[i] = 1 + 2 * KINDS.index("phone")
        elif IDENTITY.fullmatch(s) and not NOT_PERSONAL.search("".join(toks[max(0, i - 4) : i])):
            y[i] = 1 + 2 * KINDS.index("id_number")
    return toks, y


def in_list(kind: str, value: str) -> str:
    """An entry of a list as text, with its type before it."""
    return f"{kind}: {value}"


def sequences_of(rows: list[tuple[str | None, str | None]]) -> tuple[list[list[str]], list[list[int]], list[list[str]]]:
    """Labelled sequences of a sample of ``(text, entities_json)``: pieces of texts, and entries of lists.

    Third, pieces with capitals that no list explains: their lists may lack a name, so they are labelled later.
    """
    xs, ys, open_ = [], [], []
    seen: Counter[str] = Counter()
    entries: set[tuple[str, str]] = set()
    for text, raw in rows:
        ents = parse_entities(raw)
        entries.update(ents)
        if not text or not ents:
            continue
        toks, y = labelled(text, ents)
        unsure = [v for k, v in ents if value_kind(k, v) is None]
        named = {w for k, v in ents for w in v.split()}
        a = 0
        for i in range(len(toks) + 1):
            if i == len(toks) or (i - a >= 100 and y[i] in (0, 1, 3, 5, 7, 9)) or (i - a >= 8 and toks[i - 1].strip() in ".!?;" and y[i - 1] == 0 and (i < 2 or len(toks[i - 2].strip()) > 2)):
                part, py = toks[a:i], y[a:i]
                s = squeeze("".join(part))
                # names that the list lacks would teach the opposite
                lacking = any(w.strip()[:1].isupper() and w.strip() not in named and t > 0 and part[t - 1].strip() not in ".«:!?" and not l for t, (w, l) in enumerate(zip(part, py))) if not any(py) else False
                odd = sum(len(m) for m in ODD.findall(s)) > 0.1 * len(s)
                masked = re.sub(r"[A-ZА-ЯЁÄÖÜ]\w*", "X", re.sub(r"\d", "9", s))
                seen[masked] += 1
                if not part or seen[masked] > ALIKE or not any(py) and not re.search(r"\d|\W[A-ZА-ЯЁÄÖÜ]", s[1:]):
                    pass  # enough of its like, or nothing in it that could be taken for an entity
                elif odd:
                    xs.append(part)
                    ys.append([0] * len(part))
                elif lacking:
                    open_.append(part)
                elif not any(v in s for v in unsure):
                    xs.append(part)
                    ys.append(py)
                a = i
    for kind, value in sorted(entries):
        k = value_kind(kind, value)
        masked = kind + re.sub(r"[A-ZА-ЯЁÄÖÜ]\w*", "X", re.sub(r"\d", "9", value))
        seen[masked] += 1
        if k is None or not value.strip() or seen[masked] > 40:
            continue
        t = tokens(in_list(kind, value))
        n = len(tokens(f"{kind}:"))
        b = 0 if k == "-" else 1 + 2 * KINDS.index(k)
        xs.append(t)
        ys.append([0] * n + ([b] + [b + 1] * (len(t) - n - 1) if b else [0] * (len(t) - n)))
    return xs, ys, open_


def learn(rows: list[tuple[str | None, str | None]]) -> Crf | None:
    """Train on the labelled table, label the open pieces with the model, train again on all."""
    xs, ys, open_ = sequences_of(rows)
    if not xs:
        return None
    crf = train(xs, ys)
    # the lists lack names: what the model finds besides is taken over, and open pieces without doubt are added
    every = xs + open_
    e = [crf.scores(np.array([crf.row(w) for w in part])) for part in every]
    n = len(xs)
    for k, (part, x, y) in enumerate(zip(every, e, viterbi(e, crf.pairs))):
        if k < n:
            if y.any() and not any(a and not b for a, b in zip(ys[k], y)):
                ys[k] = [a or int(b) for a, b in zip(ys[k], y)] if not any(a and a != b for a, b in zip(ys[k], y)) else ys[k]
        elif not ((y == 0) & (x[:, 1:].max(axis=1) - x[:, 0] > -3)).any():
            xs.append(part)
            ys.append(y.tolist())
    crf = train(xs, ys)
    return crf


# ---------------------------------------------------------------- decoding


def decode_all(crf: Crf, texts: list[str], most: int = 1_000_000) -> list[list[tuple[str, int, int, str]]]:
    """:func:`decode` over groups of texts of about ``most`` characters."""
    out: list[list[tuple[str, int, int, str]]] = []
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            out += decode(crf, texts[a : i + 1])
            a, size = i + 1, 0
    return out + decode(crf, texts[a:]) if a < len(texts) else out


def possible(e: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether a token may be part of an entity in the best labelling; the others are O in it for sure.

    An entity gains at most the best scores of its tokens over O and the best transitions; a token that no stretch with a gain holds is O.
    """
    inner = float(pairs[1:, 1:].max() - pairs[0, 0])
    ends = float(pairs[0, 1:].max() + pairs[1:, 0].max() - 2 * pairs[0, 0])
    s = np.cumsum((e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64) + inner)
    high = np.maximum.accumulate(s[::-1])[::-1]
    low = np.minimum.accumulate(np.r_[0.0, s[:-1]])
    return high - low + ends - inner > -1e-3


def decode(crf: Crf, texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
    """``kind, start, end, value as written`` of the entities of each text.

    The texts are scored as one row of tokens, with two empty tokens between them so that they don't touch.
    """
    found: list[list[tuple[str, int, int, str]]] = [[] for _ in texts]
    toks_of = [tokens(t) for t in texts]
    ids: list[int] = []
    begin = []
    get, row = crf.rows.get, crf.row
    for toks in toks_of:
        ids += (0, 0)
        begin.append(len(ids))
        ids += [i if (i := get(w)) is not None else row(w) for w in toks]
    ids += (0, 0)
    e = crf.scores(np.array(ids))
    starts = np.array(begin)
    ends = starts + np.array([len(t) for t in toks_of])
    hot = np.flatnonzero(possible(e, crf.pairs))
    text_of = np.searchsorted(starts, hot, "right") - 1
    ok = (text_of >= 0) & (hot < ends[text_of])
    hot, text_of = hot[ok], text_of[ok]
    if not len(hot):
        return found
    cut = np.flatnonzero((np.diff(hot) > 3) | (np.diff(text_of) > 0))
    first, last = np.r_[0, cut + 1], np.r_[cut, len(hot) - 1]
    which = text_of[first]
    low = np.maximum(starts[which], hot[first] - 2)
    high = np.minimum(ends[which], hot[last] + 3)
    labels = viterbi([e[a:b] for a, b in zip(low.tolist(), high.tolist())], crf.pairs)
    for d, lo, y in zip(which.tolist(), (low - starts[which]).tolist(), labels):
        y = y.tolist()
        if not any(y):
            continue
        toks, i, at, done = toks_of[d], 0, None, lo
        while i < len(y):
            if y[i] and y[i] % 2:
                j = i + 1
                while j < len(y) and y[j] == y[i] + 1:
                    j += 1
                part = "".join(toks[lo + i : lo + j])
                value = part.lstrip()
                at = sum(map(len, toks[: lo + i])) if at is None else at + sum(map(len, toks[done : lo + i]))
                done = lo + i
                start = at + len(part) - len(value)
                # a piece of a longer string of letters and digits (encoded data) is no value
                before, behind = toks[lo + i - 1][-1:] if lo + i and part == value else "", toks[lo + j][:1] if lo + j < len(toks) else ""
                if not GLUE.match(before) and not GLUE.match(behind):
                    found[d].append((KINDS[(y[i] - 1) // 2], start, start + len(value), value))
                i = j
            else:
                i += 1
    crf.forget()
    return found


#: Words before a name that are no part of it.
TITLES = r"(?:mr|mrs|ms|miss|dr|prof|inspector|herr|herrn|frau|господин\w*|госпож\w*|граждан\w*|товарищ\w*|доктор\w*|инспектор\w*|г-н\w*|г-ж\w*)"
_BEFORE = re.compile(rf"^(?:\W+|{TITLES}\b\.?\s+)+", re.I)
_PART = r"(?:[A-ZÄÖÜ](?:[a-zäöüß]*|[A-ZÄÖÜ]+)|[А-ЯЁ](?:[а-яё]*|[А-ЯЁ]+))"
_NAME = re.compile(rf"(?:(?<!\w)[A-ZА-ЯЁÄÖÜ]\.\s*|(?<!\w){_PART}(?:[-'’]{_PART})*(?!\w)(?:,\s+|\s+|(?=\W|$)))+")


def refine(kind: str, value: str) -> list[tuple[int, int]]:
    """Where in a found span the values themselves stand; none if there is no value of the kind."""
    if kind in ("phone", "id_number"):
        return [(0, len(value))] if 7 <= sum(c.isdigit() for c in value) <= 15 else []
    if kind == "email":
        return [(0, len(value))] if EMAIL.fullmatch(value) else []
    if kind == "address":
        end = re.search(r"(?:(?<=\d)[a-zа-я]?|(?<=[^\W\d_]{4})|\.)\.\s+(?=[^\W\d_])", value)
        v = re.sub(r"\.\s+$", "", value[: end.end()]) if end else value.rstrip(" ,;:\n")
        return [(0, len(v))] if any(c.isdigit() for c in v) and re.search(r"[^\W\d_]{3}", v) and re.search(r"\s", v) and not re.search(r"[+/=@]", v) else []
    out = []
    m = _BEFORE.match(value)
    for m in _NAME.finditer(value, m.end() if m else 0):
        a, b = m.start(), m.start() + len(m.group().rstrip(" ,\n\t"))
        title = _BEFORE.match(value[a:b])
        a += title.end() if title else 0
        if re.search(r"[^\W\d_]{2}", value[a:b]):
            out.append((a, b))
    return out


def values(kind: str, span: str) -> list[str]:
    """The values as reported."""
    some = [squeeze(span[a:b]) for a, b in refine(kind, span)]
    return [re.sub(r"\D", "", v) for v in some] if kind in ("phone", "id_number") else some


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*model.value)
        for batch in batches:
            ids, texts, raws = (c.to_pylist() for c in batch.columns)
            out: tuple[list, ...] = ([], [], [], [], [])
            for k in range(0, len(ids), 1000):
                some = decode_all(crf, [t or "" for t in texts[k : k + 1000]])
                for d, spans in enumerate(some):
                    for kind, a, _, v in spans:
                        for c in values(kind, v):
                            for col, x in zip(out, (ids[k + d], "extracted_text", kind, c, a)):
                                col.append(x)
                for d, pairs in enumerate(entry_kinds(crf, raws[k : k + 1000], some)):
                    for what, v in pairs:
                        for c in values(what, v)[:1]:
                            for col, x in zip(out, (ids[k + d], "entities_json", what, c, None)):
                                col.append(x)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "field", "kind", "value", "start"])

    return run


#: The last models of this process by the hash of their labelled table, so that queries over the same files train once.
_MODELS: dict[int, tuple] = {}


def fit(files: DataFrame, most: int = 900) -> tuple:
    """Train on at most ``most`` files with computed entities, half of them with the rarer types (those of smallest hash). Without any there is nothing to learn."""
    known = files.where("entities is not null and length(entities) > 2 and text is not null").select("id", F.xxhash64("id").alias("h"), F.col("entities").rlike("LOCATIONS|CONTACTS|DOCUMENTS").alias("rare"))
    # ids first: a top-k of whole texts would bring a sample of each partition to the driver
    ids = [r["id"] for x, n in ((known.where("rare"), most // 2), (known.where("not rare"), most - most // 2)) for r in x.orderBy("h", "id").limit(n).collect()]
    if not ids:
        return {}, set(), np.zeros((len(OFFSETS), 0, N), np.float32), np.zeros((N, N), np.float32)
    wanted = F.broadcast(files.sparkSession.createDataFrame([(i,) for i in set(ids)], "id bigint"))  # at most ``most`` rows
    some = files.where("entities is not null and text is not null").join(wanted, "id", "left_semi").dropDuplicates(["id"]).orderBy("id").select("text", "entities").collect()
    rows = [(r["text"], r["entities"]) for r in some]
    digest = xxhash.xxh3_128()
    for text, entities in rows:
        for part in (text, entities):
            raw = part.encode("utf-8", "surrogatepass")
            digest.update(len(raw).to_bytes(8, "little") + raw)
    which = digest.intdigest()
    if which not in _MODELS:
        crf = learn(rows)
        none = {}, set(), np.zeros((len(OFFSETS), 0, N), np.float32), np.zeros((N, N), np.float32)
        while len(_MODELS) >= 4:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[which] = none if crf is None else (crf.index, crf.known, crf.weights, crf.pairs)
    return _MODELS[which]


def personal_data(files: DataFrame, most: int = 900, id_col: str = "id", text_col: str = "extracted_text", json_col: str = "entities_json") -> DataFrame:
    """``id, field, kind, value``, distinct, of both fields; see :func:`redacted` for the texts with placeholders.

    ``value`` is as written with white space runs as one space; of phones and identity numbers only the digits. Null and
    empty texts and lists hold nothing; a list that is no JSON object holds nothing, of one that is cut the whole values count.
    Rows of an id that come twice count once. Other columns are ignored whatever their names.
    """
    spark = files.sparkSession
    bound_arrow(spark)
    x = files.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(json_col).alias("entities")).where("id is not null")
    model = spark.sparkContext.broadcast(fit(x, most))
    found = spread(x.where("text is not null or entities is not null")).mapInArrow(_find(model), "id bigint, field string, kind string, value string, start int")
    return found.select("id", "field", "kind", "value").distinct()


def redact(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with a typed placeholder for each span."""
    out, at = [], 0
    for kind, a, _, v in sorted(spans, key=lambda s: s[1]):
        for low, high in refine(kind, v):
            if a + low >= at:
                out += [text[at : a + low], PLACEHOLDER[kind]]
                at = a + high
    return "".join(out) + text[at:]


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?')


def redact_entities(raw: str | None, kinds: dict[str, str]) -> str | None:
    """An entity list in JSON with placeholders in its values; ``kinds`` tells the kind of a value. Keys and what is cut at the end stay as they are."""

    def one(m: re.Match) -> str:
        try:
            v = json.loads(f'"{m.group(1)}"')
        except ValueError:
            return m.group()
        kind = None if m.group(2) else kinds.get(v)
        if kind is None:
            return m.group()
        return json.dumps(redact(v, [(kind, 0, len(v), v)]), ensure_ascii=m.group(1).isascii())

    return _LITERAL.sub(one, raw) if raw else raw


def entry_kinds(crf: Crf, raws: list[str | None], spans_of: list[list[tuple[str, int, int, str]]]) -> list[list[tuple[str, str]]]:
    """``(kind, value)`` of the entries of each list that are personal data, told by the same value in the text or by the model alone."""
    entries = [parse_entities(r) for r in raws]
    flat = [(d, kind, v) for d, es in enumerate(entries) for kind, v in es if v.strip()]
    alone = decode(crf, [in_list(kind, v) for _, kind, v in flat])
    said = [{c: kind for kind, _, _, v in spans for c in [squeeze(v), *values(kind, v)]} for spans in spans_of]
    out: list[list[tuple[str, str]]] = [[] for _ in raws]
    for (d, _, v), spans in zip(flat, alone):
        what = said[d].get(squeeze(v)) or next((s[0] for s in spans if s[2] - s[1] >= 0.6 * len(v)), None)
        if what == "email" and not EMAIL.fullmatch(squeeze(v)):
            what = "id_number" if IDENTITY.fullmatch(squeeze(v)) else "phone" if PHONE.fullmatch(squeeze(v)) else "person"
        if what:
            out[d].append((what, v))
    return out


def _redact(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*model.value)
        for batch in batches:
            ids, texts, raws = (c.to_pylist() for c in batch.columns)
            spans = decode_all(crf, [t or "" for t in texts])
            kinds = entry_kinds(crf, raws, spans)
            lists = [redact_entities(r, {v: kind for kind, v in some}) for r, some in zip(raws, kinds)]
            cols = (ids, [None if t is None else redact(t, s) for t, s in zip(texts, spans)], [len(s) for s in spans], lists, [len(k) for k in kinds])
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "redacted", "n_spans", "redacted_entities", "n_entries"])

    return run


def redacted(files: DataFrame, most: int = 900, id_col: str = "id", text_col: str = "extracted_text", json_col: str = "entities_json") -> DataFrame:
    """``id, redacted, n_spans, redacted_entities, n_entries``: text and entity list with personal data replaced by typed placeholders, otherwise unchanged.

    Rows without text and list give no row, a null text or list stays null and an empty one empty; a list that is cut stays cut. Of rows of
    an id that come twice one is kept.
    """
    spark = files.sparkSession
    bound_arrow(spark)
    x = files.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(json_col).alias("entities")).where("id is not null")
    model = spark.sparkContext.broadcast(fit(x, most))
    some = spread(x.where("text is not null or entities is not null"))
    return some.mapInArrow(_redact(model), "id bigint, redacted string, n_spans int, redacted_entities string, n_entries int").dropDuplicates(["id"])
