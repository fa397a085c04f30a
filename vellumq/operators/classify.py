"""Rule-based classification of texts as columns: category, language, sentiment and topics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumq.session import spread

#: Beginnings of words (or whole phrases) of each category, in the order that breaks ties.
CATEGORIES = {
    "финансы": ["оплат", "счет", "баланс", "перевод", "сумм", "рубл", "доллар", "банк", "бюджет", "прибыл", "убыт", "налог", "кредит"],
    "юридический": ["договор", "контракт", "иск", "суд", "закон", "прав", "устав", "лицензи", "протокол", "кодекс", "истец", "ответчик"],
    "кадры": ["сотрудник", "зарплат", "увольн", "прием на работу", "отпуск", "больничн", "трудов", "ваканси", "резюме", "штатн"],
    "техническая": ["сервер", "исходный код", "программн", "api", "база данных", "deploy", "git", "docker", "скрипт", "репозитор", "kubernetes", "python"],
    "переписка": ["уважаем", "здравствуйте", "с уважением", "добрый день", "письм", "ответ на"],
    "отчёт": ["отчет", "итог", "результат", "анализ", "показател", "динамик", "квартал"],
}
DEFAULT = "общий"
POSITIVE = ["успех", "хорош", "отличн", "прибыль", "рост", "одобрен", "достижен", "улучшен", "эффективн", "качеств"]
NEGATIVE = ["убыт", "штраф", "нарушен", "отказ", "проблем", "ошибк", "жалоб", "недостат", "плох", "снижен"]
WORD = r"(?U)[\p{L}\p{N}_]+"
WORDS = re.compile(r"\w+")


def norm(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def beginnings(tokens: Column, starts: list[str]) -> Column:
    """How many (word, beginning) pairs agree."""
    one = lambda start: F.size(F.filter(tokens, lambda w: w.startswith(start)))
    return sum(map(one, starts), F.lit(0))


def counts(text: Column, tokens: Column, keys: list[str]) -> Column:
    n = beginnings(tokens, [k for k in keys if " " not in k])
    for k in keys:
        if " " in k:
            n = n + F.regexp_count(text, F.lit(rf"(?U)(?<!\w){k}(?!\w)"))
    return n


def language(text: Column) -> Column:
    """ru or en when more than 0.7 of the letters are of one script, else mixed; unknown without letters."""
    cyr, lat = F.regexp_count(text, F.lit("[А-Яа-яЁё]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    n = cyr + lat
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(cyr / n > 0.7, "ru").when(lat / n > 0.7, "en").otherwise("mixed")


def classify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, category, confidence, language, sentiment, word_count, char_count``; blank and null texts get the default with confidence 0.

    The category is the one with most hits; the confidence is best / (best + second), or 0.9 if one alone has hits.
    Rows of an id that come twice count once.
    """
    x = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))).select("id", "t", norm(F.col("t")).alias("n"))
    x = x.withColumn("w", words(F.col("n")))
    hits = F.array(*(F.struct(counts(F.col("n"), F.col("w"), k).alias("c"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, k) in enumerate(CATEGORIES.items())))
    x = x.select(
        "id", language(F.col("t")).alias("language"), F.reverse(F.array_sort(hits)).alias("h"), F.size("w").alias("word_count"), F.char_length("t").alias("char_count"),
        beginnings(F.col("w"), POSITIVE).alias("p"), beginnings(F.col("w"), NEGATIVE).alias("q"), (F.trim("t") == "").alias("blank"),
    )
    best, second = F.col("h")[0]["c"], F.col("h")[1]["c"]
    ratio = F.col("p") / F.nullif(F.col("p") + F.col("q"), F.lit(0))
    return x.select(
        "id",
        F.when(best > 0, F.col("h")[0]["name"]).otherwise(DEFAULT).alias("category"),
        F.when(F.col("blank"), 0.0).when(best == 0, 0.5).when(second > 0, best / (best + second)).otherwise(0.9).alias("confidence"),
        "language",
        F.when(ratio > 0.6, "positive").when(ratio < 0.4, "negative").otherwise("neutral").alias("sentiment"),
        "word_count",
        "char_count",
    ).dropDuplicates(["id"])


#: Words that are no topics.
TOPIC_STOP = [
    "и", "в", "на", "с", "по", "не", "что", "это", "как", "для", "из", "за", "к", "о", "от", "до", "или", "но", "а", "у", "при", "так", "же", "бы", "был", "была", "было", "были",
    "быть", "есть", "будет", "более", "эти", "этот", "весь", "вся", "все", "который", "которая", "которые", "которых", "также", "является", "может", "можно", "этого", "этой", "только",
    "через", "после", "когда", "между", "своей", "своего", "очень",
]


def topics(df: DataFrame, id_col: str, text_col: str, most: int = 5, stop: list[str] | None = None) -> DataFrame:
    """``id, word, n, rank``: the most frequent words of more than four characters that are no stop words, earlier words first among equals.

    Words are counted where their text is, so only the result leaves the row. Null and empty texts have none; repeated rows of an id count once.
    """
    left_out = frozenset(TOPIC_STOP if stop is None else stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                counts = Counter(w for w in WORDS.findall(t.lower()) if len(w) > 4 and w not in left_out)
                rows += [(i, w, n, k) for k, (w, n) in enumerate(counts.most_common(most), 1)]
            yield pd.DataFrame(rows, columns=["id", "word", "n", "rank"])

    x = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    kind = x.schema["id"].dataType.simpleString()
    return x.mapInPandas(run, f"id {kind}, word string, n bigint, rank int").dropDuplicates(["id", "rank"])


def distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n"))
