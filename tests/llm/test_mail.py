"""Mails put together by the table's generator with another seed, and odd inputs."""

import numpy as np

from vellumq.llm import mail as M

HEAD = "От: Пётр <p@a.test>\nКому: b@c.test\nТема: Счёт\nДата: Mon, 1 Jan 2024\n\n"


def test_blocks_of_unseen_mails():
    x, y = M.labelled_table(300, seed=99)
    s = np.stack([m.raw(x) for m in M.trained(600)], axis=1)
    assert (s.argmax(axis=1) == y).mean() > 0.95


def test_parts(spark):
    new = "Отчёт готов, пришлю его завтра утром. Склад открыт до шести.\n\nЖду ответа по договору."
    bodies = {
        1: (new, set()),
        2: (new + "\n\nС уважением,\nПётр Громов\nООО «Ветер»\n+7 (900) 000-11-22", {"signature"}),
        3: (new + "\n\n12.01.2024 10:30, Анна <a@b.test> пишет:\n> Когда будет отчёт?\n> Жду.", {"quoted"}),
        4: (new + "\n\nВНИМАНИЕ: информация в этом письме конфиденциальна. Копирование без согласия запрещено.", {"disclaimer"}),
        5: (new + "\n\n-----Исходное сообщение-----\nОт: Анна <a@b.test>\nОтправлено: 12.01.2024 10:30\nКому: p@a.test\n\nПришлите отчёт.\n\nС уважением,\nАнна Иванова", {"quoted"}),
        6: (new + "\nПорог такой:\n>= 40 единиц в месяц.", set()),
        7: ("К его работе я отношусь с уважением, но сроки сорваны. Viele Grüße auch an das Lager, sag es ihnen.", set()),
        8: (new + "\n\nОтправлено с телефона", {"signature"}),
        9: ("", set()),
        10: ("слово " * 100_000, set()),
    }
    rows = [(i, HEAD + b) for i, (b, _) in bodies.items()] + [(50, None), (51, ""), (52, "Просто текст без заголовков"), (2, HEAD + bodies[2][0])]
    df = spark.createDataFrame([(*x, "s", "a", 1) for x in rows], "result_id bigint, text string, sender string, body string, id int")
    got = {r["result_id"]: r for r in M.newly_written(df, mails=600).collect()}
    assert set(got) == set(bodies)
    for i, (_, want) in bodies.items():
        assert set(got[i]["foreign_parts"]) == want, i
    for i in (1, 2, 3, 4, 5, 8):
        assert got[i]["new_text"].split() == new.split(), i
    assert M.newly_written(df.limit(0), mails=300).count() == 0


def test_generator_is_fixed():
    a, b = M.labelled_table(40), M.labelled_table(40)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert a[0][:, M.N_OWN :].any(axis=0).all()  # counts over other mails are computed, all three occur


def test_only_earlier_mails_of_the_thread_are_ancestors():
    first, reply = M.blocks("Мы получили ваше письмо и ждём ответа сегодня."), M.blocks("Понял.\n\nМы получили ваше письмо и ждём ответа сегодня.")
    c = M.Counts.over([("a", "счёт", 1.0, first), ("b", "счёт", 2.0, reply), ("c", "", 3.0, first), ("d", "склад", 3.0, first)])
    assert c.features("a", "счёт", 1.0, first)[0, 2] == 0 and c.features("b", "счёт", 2.0, reply)[1, 2] == 1
    assert c.features("c", "", 3.0, first)[0, 2] == 0 and c.features("b", "счёт", None, reply)[1, 2] == 0
    assert c.features("d", "склад", 3.0, first)[0, 1] > 0  # the block itself is frequent


def test_labels_by_structure():
    bs = M.blocks("Мы получили ваше письмо и ждём ответа сегодня до шести часов вечера.\n\n> Когда?\n\n-- \nПётр Громов\n+7 900 000-11-22")
    x = np.zeros((len(bs), M.N_OWN + 3))
    assert M.structural_labels(bs, x)[:2] == [0, 1] and 2 in M.structural_labels(bs, x)
    x[0, M.N_OWN + 2] = 1
    assert M.structural_labels(bs, x)[0] == 1


def test_dates_of_headers():
    assert M.sent(["От: a", "Дата: Mon, 1 Jan 2024 10:00:00 +0300"]) < M.sent(["Date: Mon, 1 Jan 2024 10:00:00 +0000"])
    assert M.sent(["Дата: вчера"]) is None and M.sent([]) is None
