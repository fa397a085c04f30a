"""The newly written text of e-mails.

A mail body is cut into blocks (paragraphs, cut again where the quote depth changes or a separator, an introduction
or a closing line stands). Gradient-boosted trees classify each block as new, quoted, signature or disclaimer
by contact density, quote depth, frequency of the block with its sender, overlap with earlier mails of the thread and the form of
its lines. They are trained on two labelled tables: threads of mails that a fixed generator puts together, whose counts over other mails are
computed as those of real ones, and a bounded sample of the real mails, of which those blocks have a label that their
structure gives away (marks of quotation, text found in an earlier mail of the thread, lines behind a separator, blocks repeated by a sender).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.functions.words import words
from vellumq.learn.gbt import Boosted, fit
from vellumq.llm.encoding import Restorer, prepared
from vellumq.session import bound_arrow, cut, spread

PARTS = ["new", "quoted", "signature", "disclaimer"]

MARK = re.compile(r"((?:[>|](?!=)[ ]?)+)")
BANNER = re.compile(r"-{2,}+\s*+[^\W\d_][^\n]*(?<=--)|_{5,}|={5,}|-- ?|-{10,}")
HEADER = re.compile(r"[^\W\d_][\w .-]{0,24}: \S.*")
NAME = re.compile(r"(?:[^\W\d_]++\.? )?(?:[A-ZА-ЯЁÄÖÜ][\w.'-]*+[., ]*+){1,4}")
CONTACT = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d ().-]{7,}\d|https?://\S+|www\.\S+")
WHEN = re.compile(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d\d-\d\d|\d{1,2} [^\W\d_]{3,9}\.? \d{4}|[^\W\d_]{3,9} \d{1,2}, \d{4}")
CLOCK = re.compile(r"\b\d{1,2}:\d\d\b")
#: Words of closing formulas, of lines that devices add, of legal notices and of introductions, as beginnings in three languages.
CLOSING = re.compile(r"(?:с |с\b.{0,12})?(?:уважени|наилучшими пожелани|искренне|всего добр|спасибо|благодар|ваш\b)|(?:kind |best |warm )?regards|best wishes|best\b|sincerely|yours|thanks|thank you|cheers|mit (?:freundlich|besten|herzlich)|freundliche gr|viele gr|beste gr|liebe gr|mfg\b|danke|vielen dank|gruß|grüße|hochachtungsvoll", re.I)
DEVICE = re.compile(r"отправлено (?:с|из)|sent from|get outlook|von meinem|von unterwegs|gesendet (?:mit|von)|мобильн\w* почт|my (?:phone|iphone|mobile)|diese mail kam vom", re.I)
LEGAL_START = re.compile(r"(?:внимание|disclaimer|hinweis|notice|confidentiality notice|achtung)\b.{0,3}:|(?:настоящ|данн|эт)\w+ (?:сообщени|письм|документ)\w* (?:и |предназ|содерж|явля|не )|содержание (?:этого |данного )?письма|this (?:message|e-?mail|communication)\b|nothing in this|the (?:content|information)s? (?:of|in) this|any (?:views|opinions)|(?:diese|die vorliegende) (?:nachricht|e-?mail|mitteilung)|der inhalt dieser|jede haftung", re.I)
LEGAL = re.compile(r"meant only|addressee|attachments|binding|без согласия|приложени\w* предназнач|author\b|ограниченного доступа|конфиденциальн|предназначен\w* только|адресат|получили .{0,20}ошибк|запрещен|оферт|обязательств .{0,40}|юридическ|distribution|confidential|intended (?:only|solely)|disclaimer|liability|privileged|received .{0,30}error|bestimmt|vertraulich|irrtümlich|rechtlich|verbindlich|haftung|unauthori[sz]ed|views expressed|вирус|virus|не является|copying|notify the sender|löschen|unbefugt", re.I)
INTRO = re.compile(r"(?:wrote|writes|schrieb|пишет|писал|написал)\w*(?:\([^)]*\))?[^\n]{0,40}:\s*$|(?:original|forwarded|исходн|пересланн|пересыла|ursprüngliche|weitergeleitet)\w* (?:message|mail|сообщени|nachricht|письмо)|begin forwarded", re.I)
SUBJECT = re.compile(r"(?:Тема|Subject|Betreff): ")
DATE = re.compile(r"(?:Дата|Date|Datum|Sent|Gesendet|Отправлено): ")
REPLY = re.compile(r"^(?:\s*(?:re|fwd?|aw|wg|отв|пер)\s*:)+", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n")


def head_and_body(text: str) -> tuple[list[str], str] | None:
    """Header lines and body of a mail; none if the text does not begin as a mail."""
    head, blank, body = text.replace("\r\n", "\n").partition("\n\n")
    lines = head.split("\n")
    if len(lines) < 3 or not all(re.match(r"[^\s:]{1,40}: ", x + " ") for x in lines) or "@" not in head:
        return None
    return lines, body


def depth_of(line: str) -> tuple[int, str]:
    """Quote depth of a line and the line without its marks."""
    m = MARK.match(line)
    return (sum(c in ">|" for c in m.group(1)), line[m.end() :]) if m else (0, line)


def blocks(body: str) -> list[dict]:
    """Blocks in order: depth, lines without marks, number of lines before, whether a blank line stands before, separator before."""
    out: list[dict] = []
    here: dict | None = None
    blank, sep = True, 0
    for line in body.split("\n"):
        depth, x = depth_of(line)
        s = x.strip()
        if not s:
            if here is not None and here["lines"]:
                here = None
            blank = True
            continue
        banner = bool(BANNER.fullmatch(s))
        starts = banner or (len(s) < 110 and bool(INTRO.search(s))) or (len(s) <= 48 and len(s.split()) <= 6 and bool(CLOSING.match(s))) or (len(s) <= 64 and bool(DEVICE.match(s))) or bool(LEGAL_START.match(s) and (LEGAL.search(s) or len(s) < 100))
        if here is None or here["depth"] != depth or starts or (here["lines"] and here["closed"]):
            here = {"depth": depth, "lines": [], "blank": blank, "sep": sep, "closed": False}
            out.append(here)
        here["lines"].append(s)
        sep = 0
        if banner:
            here["closed"] = True
            sep = 2 if s.strip("-_= ") else 1
        blank = False
    return out


def normal(lines: list[str]) -> str:
    """A block's words in one string, for counting."""
    return " ".join(words(" ".join(lines)))


def key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


def features(bs: list[dict], sender: str) -> np.ndarray:
    """A row for each block of a mail, without the counts over other mails."""
    names = {w for w in words(re.sub(r"<.*?>", " ", sender)) if len(w) > 2 and not w.isdigit()}
    rows = []
    quoted_before = 0.0
    for i, b in enumerate(bs):
        text = "\n".join(b["lines"])
        flat = " ".join(b["lines"])
        w = flat.split()
        n = len(b["lines"])
        first, last = b["lines"][0], b["lines"][-1]
        contacts = len(CONTACT.findall(text))
        name_lines = sum(bool(NAME.fullmatch(x)) for x in b["lines"])
        org_lines = sum(len(x) < 50 and bool(re.search(r"«.+»|\b(?:Ltd|LLC|Inc|PLC|Group|GmbH|AG|KG)\b\.?$", x)) for x in b["lines"])
        header_lines = sum(bool(HEADER.fullmatch(x)) for x in b["lines"])
        intro = bool(INTRO.search(first[:160])) or bool(INTRO.search(flat)) and n <= 3
        when = bool(WHEN.search(flat)) and bool(CLOCK.search(flat))
        legal = len(LEGAL.findall(flat))
        closing = len(first) <= 48 and bool(CLOSING.match(first)) and first[-1:] not in ".?"
        device = len(first) <= 64 and bool(DEVICE.match(first)) and first[-1:] not in "?!:"
        own = len(names & set(words(flat))) / max(1, len(names))
        prev = bs[i - 1] if i else None
        prev_first = prev["lines"][0] if prev else ""
        prev_closing = bool(prev and len(prev["lines"]) == 1 and len(prev_first) <= 48 and CLOSING.match(prev_first) and prev_first[-1] not in ".?")
        rows.append([
            b["depth"], n, len(flat), len(flat) / n, i, len(bs) - 1 - i, contacts / n, contacts, name_lines / n, org_lines / n,
            header_lines / n, float(intro), float(when), float(intro and when), b["sep"], float(bool(BANNER.fullmatch(first))), float(closing), float(prev_closing), legal, legal / max(1, len(w)) * 10,
            float(device), own, float(last[-1:] in ".!?"), float(last[-1:] == ":"), len(w), float(b["blank"]), float(bool(LEGAL_START.match(first))), quoted_before, float(bool(re.search(r"\b(?:не|not|nicht|kein)\b.{0,3} ?(?:конфиденц|confidential|vertraulich|geheim)", flat, re.I))),
            sum(c.isdigit() for c in flat) / max(1, len(flat)), float(len(first) < 48 and first[-1:] == ","),
        ])
        if b["depth"] or intro and (when or header_lines or BANNER.fullmatch(first)):
            quoted_before = 1.0
    return np.array(rows, float).reshape(len(bs), N_OWN)


N_OWN = 31

# ---------------------------------------------------------------- the labelled table

#: Parts of the mails of the labelled table, in three languages.
_TABLE = {
    "ru": {
        "hello": ["Здравствуйте,", "Добрый день!", "Коллеги,", "Привет,"],
        "new": ["Отчёт готов, пришлю его завтра утром.", "Прошу проверить счёт до пятницы.", "Мы получили ваше письмо и ждём ответа.", "Телефон в приёмной не работает.", "С уважением отношусь к вашему труду, но сроки вышли.", "Вот что сказал поставщик: цена прежняя.", "Это не конфиденциально, можно показать всем.", "Склад открыт до шести.", "Спасибо за помощь, она пришлась кстати.", "Порог такой:\n>= 12 штук в день."],
        "close": ["С уважением,", "Всего доброго,", "С наилучшими пожеланиями,", "Спасибо,", "Искренне ваш,"],
        "name": ["Павел Громов", "Елена Игоревна Дроздова", "А.П. Соколова", "Кузьмин Т. Р.", "гражданин Лавров"],
        "org": ["ООО «Ветер»", "АО «Полюс»", "ЗАО «Маяк»"],
        "device": ["Отправлено с телефона", "Отправлено из мобильной почты"],
        "legal": ["ВНИМАНИЕ: сведения в этом письме конфиденциальны. Копирование запрещено.", "Это сообщение предназначено только для адресата. Если вы получили его по ошибке, удалите его.", "Содержание письма не является офертой и не порождает обязательств ООО «Ветер», пока договор не подписан."],
        "intro": ["{d} {t}, {n} <{m}> пишет:", "{d} {t} {n} <{m}> пишет:", "{n} писал(а) {d} {t}:"],
        "banner": ["-----Исходное сообщение-----", "---------- Пересланное сообщение ----------", "________________________________"],
        "heads": ["От: {n} <{m}>", "Отправлено: {d} {t}", "Кому: {m}", "Тема: Отв: Счёт 12"],
    },
    "en": {
        "hello": ["Hello,", "Dear colleagues,", "Good morning,", "Hi Tom,"],
        "new": ["The report is ready and goes out tomorrow.", "Please check the invoice before Friday.", "We got your letter and wait for a reply.", "My phone is broken again.", "I have high regards for her work, but time is up.", "Here is what the vendor wrote: the price stays.", "This is not confidential, show it to all.", "The store closes at six.", "Thanks for the help, it was timely.", "The rule is:\n>= 12 pieces a day."],
        "close": ["Best regards,", "Kind regards", "Thanks,", "Yours sincerely,", "Regards", "Cheers,"],
        "name": ["Peter Lowell", "Mary J. Hatfield", "T. Winslow", "Dr Marsh", "Hatfield, Mary"],
        "org": ["Northwind Trading Ltd", "Hollow Oak LLC", "Stonebridge Group"],
        "device": ["Sent from my phone", "Sent from my mobile", "Sent from a small screen, please excuse brevity"],
        "legal": ["DISCLAIMER: Northwind Ltd accepts no liability for loss caused by viruses. Views expressed are those of the author.", "This e-mail is confidential and intended only for the recipient. If you received it in error, please notify the sender and delete it.", "The content of this mail is not legally binding until signed by both parties. Unauthorised copying is prohibited.", "This communication and its attachments are meant for the addressee alone and may be privileged.", "Nothing in this mail is a binding offer by Hollow Oak LLC until a contract is signed."],
        "intro": ["On {d} at {t}, {n} <{m}> wrote:", "On {d} at {t} {n} <{m}> wrote:", "{n} wrote on {d} at {t}:"],
        "banner": ["-----Original Message-----", "---------- Forwarded message ---------", "________________________________"],
        "heads": ["From: {n} <{m}>", "Sent: {d} at {t}", "To: {m}", "Subject: Re: Invoice 12"],
    },
    "de": {
        "hello": ["Hallo,", "Sehr geehrte Damen und Herren,", "Guten Morgen,"],
        "new": ["Der Bericht ist fertig und kommt morgen.", "Bitte die Rechnung bis Freitag prüfen.", "Wir haben Ihren Brief bekommen und warten.", "Das Telefon im Büro ist defekt.", "Viele Grüße auch an die Werkstatt, richte das bitte aus.", "Hier steht, was der Lieferant schrieb: der Preis bleibt.", "Das ist nicht vertraulich, alle dürfen es sehen.", "Das Lager schließt um sechs.", "Danke für die Hilfe, sie kam recht.", "Die Regel ist:\n>= 12 Stück am Tag."],
        "close": ["Mit freundlichen Grüßen", "Viele Grüße", "MfG", "Danke,", "Beste Grüße"],
        "name": ["Karl Winter", "Anna-Lena Voss", "T. Brandt", "Frau Seidel", "Voss, Anna"],
        "org": ["Nordlicht GmbH", "Eichenhof AG", "Silberbach KG"],
        "device": ["Von meinem Telefon gesendet", "Von unterwegs gesendet"],
        "legal": ["HINWEIS: Der Inhalt dieser E-Mail ist rechtlich nicht verbindlich.", "Diese Nachricht ist nur für den Empfänger bestimmt und kann vertrauliche Angaben enthalten. Wenn Sie sie irrtümlich erhalten haben, löschen Sie sie bitte.", "Jede Haftung für Schäden durch Viren ist ausgeschlossen. Unbefugtes Kopieren ist nicht gestattet."],
        "intro": ["Am {d} {t} schrieb {n} <{m}>:", "Am {d} um {t} schrieb {n} <{m}>:"],
        "banner": ["-----Ursprüngliche Nachricht-----", "---------- Weitergeleitete Nachricht ----------", "________________________________"],
        "heads": ["Von: {n} <{m}>", "Gesendet: {d} {t}", "An: {m}", "Betreff: Re: Rechnung 12"],
    },
}


def _wrap(s: str, width: int) -> list[str]:
    out, here = [], ""
    for w in s.split(" "):
        if here and len(here) + len(w) >= width:
            out.append(here)
            here = w
        else:
            here = f"{here} {w}" if here else w
    return [*out, here]


class Sender:
    """A sender of the labelled table, with signatures and notices of their own."""

    def __init__(self, r: random.Random):
        self.lang = r.choice(list(_TABLE))
        t = _TABLE[self.lang]
        self.name = r.choice(t["name"])
        self.address = f"{r.choice(['info', 'p.grom', 'lowell77', 'anna'])}{r.randint(1, 999)}@{r.choice(['wind.example', 'oak.test'])}"
        self.legal = r.choice(t["legal"])
        self.phone = r.choice([f"+7 ({r.randint(900, 999)}) 000-{r.randint(10, 99)}-{r.randint(10, 99)}", f"0{r.randint(30, 90)} {r.randint(10000, 99999)} {r.randint(100, 999)}", f"+7{r.randint(9000000000, 9999999999)}"])
        self.usual = r.random() < 0.5  # signs the same way always
        self.rows: list[str] | None = None

    def signature(self, r: random.Random) -> list[str]:
        if self.usual and self.rows:
            return self.rows
        t = _TABLE[self.lang]
        if r.random() < 0.25:
            rows = [r.choice(t["device"])]
        else:
            rows = [self.name if r.random() < 0.5 else r.choice(t["name"])]
            if r.random() < 0.6:
                rows += [r.choice(t["org"]), r.choice([self.phone, self.address, f"{self.phone} | {self.address}"])]
            if r.random() < 0.6:
                rows = [r.choice(t["close"]), *([""] if r.random() < 0.5 else []), *rows]
            else:
                rows = [r.choice(["-- ", "--", "_" * r.randint(10, 30)]), *([r.choice(t["close"])] if r.random() < 0.4 else []), *rows]
        self.rows = rows
        return rows


def labelled_mail(r: random.Random, sender: Sender, earlier: list[str]) -> list[tuple[str, str]]:
    """Labelled stretches ``(part, text)`` of a mail of the table; it may quote paragraphs of the earlier mails of its thread."""
    t = _TABLE[sender.lang]
    mail = lambda: f"{r.choice(['info', 'p.grom', 'lowell77', 'anna'])}@{r.choice(['wind.example', 'oak.test'])}"
    date = lambda: r.choice([f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.20{r.randint(15, 25)}", f"{r.randint(1, 28)} {r.choice(['Mar', 'June', 'Oct'])} 20{r.randint(15, 25)}"])
    fill = lambda s: s.format(d=date(), t=f"{r.randint(8, 19):02d}:{r.randint(0, 59):02d}", n=r.choice(t["name"]), m=mail())
    fresh = lambda: " ".join(r.choice(t["new"]) for _ in range(r.randint(1, 5)))

    def para() -> str:
        here = fresh()
        earlier.append(here)
        return here

    def old() -> str:
        return r.choice(earlier) if earlier and r.random() < 0.5 else fresh()

    def signature() -> list[str]:
        return (sender if r.random() < 0.8 else Sender(r)).signature(r)

    def quote(depth: int = 1) -> list[str]:
        mark = r.choice(["> ", ">", "| ", ">> "])
        inner: list[str] = []
        for _ in range(r.randint(1, 2)):
            inner += [*_wrap(old().replace("\n>= ", " "), r.choice([60, 68])), ""]
        if r.random() < 0.3:
            inner += Sender(r).signature(r)
        if r.random() < 0.25 and depth < 3:
            inner += [fill(r.choice(t["intro"])), *quote(depth + 1)]
        return [mark + x for x in inner if x or r.random() < 0.7]

    out: list[tuple[str, str]] = []
    if r.random() < 0.5:
        out.append(("new", r.choice(t["hello"]) + "\n\n"))
    above = r.random() < 0.15
    if above:
        out += [("quoted", fill(r.choice(t["intro"])) + "\n" + "\n".join(quote()) + "\n\n")]
    for _ in range(r.randint(1, 3) if r.random() > 0.06 else 0):
        out.append(("new", para() + r.choice(["\n\n", "\n\n", "\n"])))
        if r.random() < 0.12:
            out.append(("quoted", "\n".join(quote()) + "\n\n"))
    if r.random() < 0.1:
        out.append(("new", "---\n" + r.choice(t["new"]) + "\n"))
    gap = lambda: r.choice(["\n", "\n\n", "\n\n\n"])
    if r.random() < 0.5:
        out.append(("signature", gap() + "\n".join(signature()) + "\n"))
    tail = [("disclaimer", lambda: gap() + "\n".join(_wrap(sender.legal if r.random() < 0.5 else r.choice(t["legal"]), r.choice([70, 200]))) + "\n")] if r.random() < 0.35 else []
    if not above and r.random() < 0.5:
        if r.random() < 0.6:
            tail.append(("quoted", lambda: gap() + fill(r.choice(t["intro"])) + r.choice(["\n", "\n\n"]) + "\n".join(quote()) + "\n"))
        else:
            tail.append(("quoted", lambda: gap() + r.choice([r.choice(t["banner"]) + "\n", "", r.choice(t["banner"]) + "\n"]) + "\n".join(fill(x) for x in t["heads"][: r.randint(2, 4)]) + "\n\n" + old() + "\n"))
    r.shuffle(tail) if r.random() < 0.3 else None
    return out + [(p, f()) for p, f in tail]


class Counts:
    """Counts over other mails: what share of all mails and of those of its sender have a block, and when a sentence first stood in its thread.

    Shares, not numbers, so that a collection of any size gives the same features.
    """

    def __init__(self, rows: Iterable[tuple[int, int, int, float | None]] = (), total: int = 1):
        self.known = {(kind, k): (n, first) for kind, k, n, first in rows}
        self.total = total

    @classmethod
    def over(cls, mails: Iterable[tuple[str, str, float | None, list[dict]]]) -> Counts:
        n: dict[tuple[int, int], int] = {}
        first: dict[tuple[int, int], float] = {}
        total = 0
        for address, subject, at, bs in mails:
            total += 1
            for x in block_keys(address, subject, bs):
                n[x] = n.get(x, 0) + 1
                if at is not None:
                    first[x] = min(at, first.get(x, at))
        return cls(((*x, m, first.get(x)) for x, m in n.items()), total)

    def others(self, kind: int, k: int) -> int:
        """How many other mails have a key."""
        return self.known.get((kind, k), (1, None))[0] - 1

    def features(self, address: str, subject: str, at: float | None, bs: list[dict]) -> np.ndarray:
        """Sender frequency, block frequency and ancestor overlap of each block: a sentence counts if an earlier mail of the thread has it."""
        c = np.zeros((len(bs), 3))
        mine = max(1, self.others(3, key(address)))
        for k, b in enumerate(bs):
            s = normal(b["lines"])
            if len(s) >= 4:
                c[k, 0] = self.others(1, key(f"{address} {s}")) / mine
                c[k, 1] = self.others(0, key(s)) / max(1, self.total - 1)
            ks = sentence_keys(b["lines"], subject)
            firsts = (self.known.get((2, q), (1, None))[1] for q in ks)
            c[k, 2] = sum(at is not None and f is not None and f < at for f in firsts) / len(ks) if ks else 0
        return c


def block_keys(address: str, subject: str, bs: list[dict]) -> set[tuple[int, int]]:
    """Keys of the blocks of a mail (kind 0), with the sender (kind 1), of its sentences in the thread of its subject (kind 2), and of the sender (kind 3)."""
    out: set[tuple[int, int]] = {(3, key(address))}
    for b in bs:
        s = normal(b["lines"])
        if len(s) >= 4:
            out |= {(0, key(s)), (1, key(f"{address} {s}"))} | {(2, k) for k in sentence_keys(b["lines"], subject)}
    return out


def labelled_table(mails: int = 1500, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the blocks of the generated threads."""
    r = random.Random(seed)
    made: list[tuple[Sender, str, float, list[dict], list[int]]] = []
    senders = [Sender(r) for _ in range(max(1, mails // 3))]
    thread, subject, earlier = 0, "", []
    for n in range(mails):
        if thread <= 0:
            thread, subject, earlier = r.choice([1, 1, 1, 2, 4]), f"subject {n}", []
        thread -= 1
        sender = r.choice(senders)
        parts = labelled_mail(r, sender, earlier)
        body = "".join(s for _, s in parts)
        owner: list[int] = []
        for p, s in parts:
            owner += [PARTS.index(p)] * s.count("\n")
        owner += [owner[-1] if owner else 0]
        bs = blocks(body)
        lines = [i for i, x in enumerate(body.split("\n")) if depth_of(x)[1].strip()]
        y, k = [], 0
        for b in bs:
            y.append(owner[lines[k]])
            k += len(b["lines"])
        made.append((sender, subject, float(n), bs, y))
    counts = Counts.over((m[0].address, *m[1:4]) for m in made)
    xs = [np.hstack([features(bs, sender.name), counts.features(sender.address, subject, at, bs)]) for sender, subject, at, bs, _ in made]
    return np.vstack(xs), np.array([c for m in made for c in m[4]])


def structural_labels(bs: list[dict], x: np.ndarray) -> list[int | None]:
    """The class of the blocks of a real mail whose structure gives it away, none for the others."""
    out: list[int | None] = [None] * len(bs)
    signed = False
    for i, b in enumerate(bs):
        text = " ".join(b["lines"])
        sender_n, overlap = x[i, N_OWN], x[i, N_OWN + 2]
        if sum(bool(HEADER.fullmatch(h)) for h in b["lines"]) >= 3 and b["sep"]:
            out[i] = 1  # header lines of a message; what follows them looks like any other text
            return out
        if b["depth"] or overlap >= 0.8 or (i + 1 < len(bs) and bs[i + 1]["depth"] > b["depth"] and text[-1] == ":" and WHEN.search(text)):
            out[i] = 1
        elif b["sep"] == 1 and len(b["lines"]) <= 5 and (CONTACT.search(text) or NAME.fullmatch(b["lines"][0])):
            out[i], signed = 2, True
        elif sender_n > 0 and (CONTACT.search(text) or len(b["lines"]) <= 4 and NAME.fullmatch(b["lines"][-1])):
            out[i], signed = 2, True
        elif signed and sender_n > 0 and len(text.split()) >= 12:
            out[i] = 3
        elif not signed and i <= 1 and text[-1] in ".!?…" and len(text.split()) >= 10 and not CONTACT.search(text) and not LEGAL_START.match(text):
            out[i] = 0
    return out


def real_table(rows: list, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the blocks of real mails that have a label by structure."""
    xs, ys = [np.empty((0, N_OWN + 3))], []
    for r in rows:
        bs = blocks(r["body"])
        if bs:
            x = np.hstack([features(bs, r["sender"]), counts.features(r["address"], r["subject"], r["at"], bs)])
            y = structural_labels(bs, x)
            keep = [k for k, c in enumerate(y) if c is not None]
            xs.append(x[keep])
            ys += [y[k] for k in keep]
    return np.vstack(xs), np.array(ys, int)


def trained(mails: int = 1500, rows: list = (), counts: Counts = Counts()) -> list[Boosted]:
    """One model for each part, against the rest, from generated and real blocks."""
    tables = [labelled_table(mails), real_table(rows, counts)]
    x, y = np.vstack([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    return [fit(x, (y == k).astype(float), loss="logistic", trees=60, depth=4, rate=0.2) for k in range(len(PARTS))]


# ---------------------------------------------------------------- the operator


def decide(bs: list[dict], scores: np.ndarray) -> list[int]:
    """Part of each block by its scores; behind an introduction whose quotation is not marked all that follows is quoted."""
    part = scores.argmax(axis=1).tolist() if len(bs) else []
    rest = False
    for i, b in enumerate(bs):
        if rest:
            part[i] = 1
        elif part[i] == 1 and not b["depth"]:
            text = " ".join(b["lines"])
            words_between = BANNER.match(text) and text.strip("-_= ")  # a line of signs alone may as well begin a signature
            begins = bool(INTRO.search(text)) or bool(words_between) or sum(bool(HEADER.fullmatch(x)) for x in b["lines"]) >= 2
            marked = i + 1 < len(bs) and bs[i + 1]["depth"] > 0
            rest = begins and not marked
    for i, b in enumerate(bs):  # a line before an introduction or a signature belongs to it
        if len(b["lines"]) == 1 and BANNER.fullmatch(b["lines"][0]) and i + 1 < len(bs) and part[i + 1]:
            part[i] = part[i + 1]
    return part


def _prepare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(*shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                t = fix.text(t)[0]
                got = head_and_body(t)
                if got:
                    head, body = got
                    m = re.search(r"<([^>]*)>", head[0])
                    subject = next((x.partition(": ")[2] for x in head if SUBJECT.match(x)), "")
                    for col, x in zip(out, (i, head[0].partition(": ")[2], (m.group(1) if m else head[0]).lower(), REPLY.sub("", subject).strip().lower(), sent(head), body)):
                        col.append(x)
            types = (pa.int64(), *[pa.string()] * 3, pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "sender", "address", "subject", "at", "body"])

    return run


def sent(head: list[str]) -> float | None:
    """When a mail was sent, in seconds; none if its header does not tell."""
    value = next((x.partition(": ")[2] for x in head if DATE.match(x)), "")
    try:
        return parsedate_to_datetime(value).timestamp()
    except (ValueError, TypeError, OverflowError):
        return None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each mail, with its date."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for i, address, subject, at, body in zip(*(batch.column(k).to_pylist() for k in ("id", "address", "subject", "at", "body"))):
            for kind, k in block_keys(address, subject, blocks(body)):
                for col, x in zip(out, (i, kind, k, at)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["id", "kind", "key", "at"])


def sentence_keys(lines: list[str], subject: str) -> list[int]:
    """Keys of the sentences of at least five words, in the thread of a subject; a mail without subject has no thread."""
    return [key(f"{subject}\n{s}") for x in SENTENCE.split(" ".join(lines)) if subject and (s := " ".join(words(x))).count(" ") >= 4]


def counted(rows: list | None, total: int) -> Counts:
    return Counts(((a["kind"], a["key"], a["n"], a["first"]) for a in rows or ()), total)


def _classify(models, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = models.value
        for batch in batches:
            rows = batch.to_pylist()
            all_blocks, xs = [], []
            for r in rows:
                bs = blocks(r["body"])
                x = features(bs, r["sender"])
                c = counted(r["counts"], total).features(r["address"], r["subject"], r["at"], bs)
                all_blocks.append(bs)
                xs.append(np.hstack([x, c]))
            x = np.vstack(xs) if xs else np.empty((0, N_OWN + 3))
            scores = np.stack([m.raw(x) for m in fitted], axis=1) if len(x) else np.empty((0, len(PARTS)))
            at, out = 0, ([], [], [])
            for r, bs in zip(rows, all_blocks):
                part = decide(bs, scores[at : at + len(bs)])
                at += len(bs)
                new = "\n\n".join("\n".join(b["lines"]) for b, p in zip(bs, part) if p == 0)
                foreign = sorted({PARTS[p] for p in part if p}, key=PARTS.index)
                for col, v in zip(out, (r["id"], new, foreign)):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["result_id", "new_text", "foreign_parts"])

    return run


def newly_written(results: DataFrame, id_col: str = "result_id", text_col: str = "text", mails: int = 1500, sample: int = 1000) -> DataFrame:
    """``result_id, new_text, foreign_parts`` of each row whose text is a mail.

    ``new_text`` is what the sender newly wrote, paragraphs parted by a blank line; ``foreign_parts`` lists which of quoted, signature and
    disclaimer the body holds. Rows that don't begin with header lines, null and empty texts give no row; rows of an id
    that come twice count once. ``mails`` is the size of the generated table, ``sample`` bounds the real mails that the trees are trained on;
    all mails are counted and classified. Other columns are ignored whatever their names.
    """
    spark = results.sparkSession
    bound_arrow(spark)
    x = results.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    x = spread(x)
    b = spark.sparkContext.broadcast
    mail = cut(x.mapInArrow(_prepare(b(prepared(x))), "id bigint, sender string, address string, subject string, at double, body string").dropDuplicates(["id"]))
    keys = mail.mapInArrow(_keys, "id bigint, kind int, key bigint, at double")
    # a key of a third of all mails is counted with partial sums; the join back is on (kind, key), which AQE splits
    often = keys.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    counts = keys.join(often, ["kind", "key"]).groupBy("id").agg(F.collect_list(F.struct("kind", "key", "n", "first")).alias("counts"))
    every = cut(mail.join(counts, "id", "left"))
    some = every.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    total = every.count()
    known = counted([a for r in some for a in r["counts"] or ()], total)
    return every.mapInArrow(_classify(b(trained(mails, some, known)), total), "result_id bigint, new_text string, foreign_parts array<string>")


def foreign_parts(results: DataFrame) -> DataFrame:
    """``result_id, foreign_part``, one row per part."""
    return newly_written(results).select("result_id", F.explode("foreign_parts").alias("foreign_part"))
