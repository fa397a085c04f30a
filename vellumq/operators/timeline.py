"""Dates in texts and the timeline of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Russian months in the genitive and the nominative.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
MONTHS_BASE = "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()
NUMBER = {m: i % 12 + 1 for i, m in enumerate(MONTHS + MONTHS_BASE)}
_MONTH = "|".join(NUMBER)
DMY, ISO = r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
DAY_MONTH, MONTH_YEAR = rf"\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b", rf"\b({_MONTH})\s+(\d{{4}})\b"
#: One scanner for all forms; a day before a month belongs to it, so no form is found inside another.
SCANNER = re.compile(
    rf"\b(?:(?P<d1>\d{{1,2}})[./](?P<m1>\d{{1,2}})[./](?P<y1>\d{{4}})|(?P<y2>\d{{4}})-(?P<m2>\d{{1,2}})-(?P<d2>\d{{1,2}})|(?:(?P<d3>\d{{1,2}})\s+)?(?P<m3>{_MONTH})\s+(?P<y3>\d{{4}}))\b",
    re.I,
)
#: Kinds of events and what tells them, the first that fits counts.
EVENTS = [
    ("agreement", ["договор", "контракт", "соглашени", "подписан"]),
    ("transaction", ["оплат", "перевод", "сумм", "рубл", "доллар", "платеж"]),
    ("meeting", ["встреч", "совещани", "заседани", "собрани"]),
    ("created", ["создан", "зарегистрирован", "основан", "учрежден"]),
    ("birth", ["родил", "дата рождения"]),
]


def event_type(context: Column) -> Column:
    """Kind of an event by the words around its date."""
    t = F.translate(F.lower(context), "ё", "е")
    out = F.lit("mention")
    for kind, signs in reversed(EVENTS):
        out = F.when(t.rlike("|".join(signs)), kind).otherwise(out)
    return out


def parse_date(text: Column) -> Column:
    """One date of a string: day.month.year, ISO, a Russian month with its day, or a Russian month alone (its first day, also if the day is none of it); null if none is valid."""
    number = F.create_map(*(x for m, i in NUMBER.items() for x in (F.lit(m), F.lit(f"{i:02d}"))))

    def found(pattern: str, year: int, month: int, day: int | None) -> Column:
        group = lambda g: F.regexp_extract(text, pattern, g)
        m = F.lpad(group(month), 2, "0") if pattern in (DMY, ISO) else F.element_at(number, F.lower(group(month)))
        return F.try_to_date(F.concat_ws("-", group(year), m, F.lpad(group(day), 2, "0") if day else F.lit("01")), "yyyy-MM-dd")

    return F.coalesce(found(DMY, 3, 2, 1), found(ISO, 1, 2, 3), found(f"(?iu){DAY_MONTH}", 3, 2, 1), found(f"(?iu){MONTH_YEAR}", 2, 1, None))


def date_of(m: re.Match) -> date | None:
    """The date of a hit of the scanner between 1900 and 2100, none if there is no such day; of a named month then its first day."""
    form = m.lastgroup[-1]
    year, month, day = (m[f"{k}{form}"] for k in "ymd")
    if not "1900" <= year <= "2100":
        return None
    number = NUMBER[month.lower()] if form == "3" else int(month)
    for d in (day, "1") if form == "3" else (day,):
        try:
            return date(int(year), number, int(d or 1))
        except ValueError:
            continue
    return None


def dates_of(text: str, most: int | None = None, apart: int = 200) -> Iterator[tuple[date, str, int]]:
    """``(date, context, position)`` in the order of the text; a date again within ``apart`` characters of the last time it counted is none."""
    counted: dict[date, int] = {}
    for m in SCANNER.finditer(text):
        when, at = date_of(m), m.start()
        if when is None or at - counted.get(when, -apart) < apart:
            continue
        counted[when] = at
        yield when, text[max(0, at - 100) : m.end() + 100].strip().replace("\n", " "), at
        if most is not None and (most := most - 1) <= 0:
            return


def _events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = [(i, d, c, p) for i, t in zip(x["id"], x["t"]) for d, c, p in dates_of(t)]
        yield pd.DataFrame(rows, columns=["id", "date", "context", "pos"])


def text_events(df: DataFrame, id_col: str = "id", text_col: str = "extracted_text") -> DataFrame:
    """``id, date, context, pos, event_type, confidence`` of the dates in texts (confidence 0.8).

    Only rows that hold a year reach Python. Rows of an id that come twice count once.
    """
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"(?:19|20)\d{2}|2100"))
    e = x.mapInPandas(_events, "id bigint, date date, context string, pos int").dropDuplicates(["id", "pos"])
    return e.select("id", "date", "context", "pos", event_type(F.col("context")).alias("event_type"), F.lit(0.8).alias("confidence"))


def file_events(files: DataFrame) -> DataFrame:
    """One event per file at its modification time (confidence 1.0)."""
    from vellumq.operators.index import current

    when = F.to_date(F.timestamp_seconds(F.col("mtime")))
    return current(files, "id", "filename", "mtime").where("mtime is not null").select("id", when.alias("date"), F.col("filename").alias("context"), F.lit(0).alias("pos"), F.lit("file_modified").alias("event_type"), F.lit(1.0).alias("confidence"))


def timeline(files: DataFrame) -> DataFrame:
    """File and text events, to be ordered by date where they are shown."""
    return file_events(files).unionByName(text_events(files))


def summary(events: DataFrame) -> DataFrame:
    """``event_type, year, n, n_sources, first, last``."""
    return events.groupBy("event_type", F.year("date").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_sources"), F.min("date").alias("first"), F.max("date").alias("last"))
