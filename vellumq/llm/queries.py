"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.llm.cooccur import associated, cooccurrence
from vellumq.llm.encoding import garbled_rows, texts_of
from vellumq.llm.leakage import leaked_items
from vellumq.llm.mail import foreign_parts, newly_written
from vellumq.llm.mixing import mixture
from vellumq.llm.neardup import all_pairs, duplicate_groups, near_duplicates
from vellumq.llm.pii import personal_data, redacted
from vellumq.llm.reading import reading_levels, reading_profile
from vellumq.llm.scans import repaired_scans, scan_defects
from vellumq.llm.splitting import pieces, split_oversized
from vellumq.session import table

KEYS = ["entity1", "entity1_type", "entity2", "entity2_type"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_defects(table(spark, sf, "files"))


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repaired_scans(table(spark, sf, "files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return associated(table(spark, sf, "entity_links")).select(*KEYS)


def p2_strength(spark: SparkSession, sf: str) -> DataFrame:
    x = cooccurrence(table(spark, sf, "entity_links"))
    return x.select(*KEYS, "n12", "n1", "n2", "n_files", *(F.round(c, 6).alias(c) for c in ("lift", "odds_ratio")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return foreign_parts(table(spark, sf, "extraction_results"))


def p3_written(spark: SparkSession, sf: str) -> DataFrame:
    return newly_written(table(spark, sf, "extraction_results"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "files")).select("id", "boundary").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(split_oversized(table(spark, sf, "files")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_restored(spark, sf).select("table_name", "row_id")


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_rows(texts_of(table(spark, sf, "files"), table(spark, sf, "extraction_results")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(table(spark, sf, "files"))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(table(spark, sf, "files"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(*near_duplicates(table(spark, sf, "files"), threshold=0.7))


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(*near_duplicates(table(spark, sf, "files"), threshold=0.8))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_levels(spark, sf).where("level >= 4").select("doc_id")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading_profile(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_strength, p3_found, p3_written, p4_found, p4_pieces, p5_found, p5_restored, p6_found, p6_redacted, p7_found, p7_groups, p8_found, p8_leaks, p9_mixture, p9_shares, p10_found, p10_levels, p10_profile)}

_RUNS = """
WITH d AS (SELECT doc_id, any_value(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{L}\\p{N}_]+')) w FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
i AS (SELECT DISTINCT item_id, regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{L}\\p{N}_]+') w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, hash(w[k:k+11]) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, hash(w[k:k+11]) h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i WHERE len(w) >= 12))
"""

_PAIRS = """
WITH r AS (
  SELECT DISTINCT replace(lower(trim(regexp_replace(entity1, '\\s+', ' ', 'g'))), 'ё', 'е') v1, entity1_type t1,
         replace(lower(trim(regexp_replace(entity2, '\\s+', ' ', 'g'))), 'ё', 'е') v2, entity2_type t2, file_id
  FROM entity_links WHERE file_id IS NOT NULL),
n AS (SELECT count(DISTINCT file_id) n_files FROM r),
e AS (SELECT t, v, count(DISTINCT file_id) m FROM (SELECT t1 t, v1 v, file_id FROM r UNION ALL SELECT t2, v2, file_id FROM r) GROUP BY t, v),
p AS (
  SELECT CASE WHEN (t1, v1) < (t2, v2) THEN v1 ELSE v2 END entity1, CASE WHEN (t1, v1) < (t2, v2) THEN t1 ELSE t2 END entity1_type,
         CASE WHEN (t1, v1) < (t2, v2) THEN v2 ELSE v1 END entity2, CASE WHEN (t1, v1) < (t2, v2) THEN t2 ELSE t1 END entity2_type, file_id
  FROM r WHERE NOT (t1 = t2 AND v1 = v2)),
q AS (SELECT entity1, entity1_type, entity2, entity2_type, count(DISTINCT file_id) n12 FROM p GROUP BY ALL HAVING count(DISTINCT file_id) >= 5)
SELECT q.*, a.m n1, b.m n2, n.n_files FROM q JOIN e a ON a.t = entity1_type AND a.v = entity1 JOIN e b ON b.t = entity2_type AND b.v = entity2, n
"""

_GRAMS = """
w AS (SELECT id, any_value(regexp_extract_all(replace(lower(extracted_text), 'ё', 'е'), '[\\p{L}\\p{N}_]+')) w FROM files WHERE extracted_text IS NOT NULL GROUP BY id),
g AS (SELECT DISTINCT id, hash(list_aggregate(w[i:i+4], 'string_agg', ' ')) h FROM (SELECT id, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 10)),
s AS (SELECT id, count(*) n FROM g GROUP BY id),
c AS (SELECT x.id id1, y.id id2, count(*) c FROM g x JOIN g y ON x.h = y.h AND x.id < y.id GROUP BY ALL)
"""

_WS = "(' ', chr(9), chr(10), chr(13), chr(12))"
_AT = "list_max(list_filter(range(s + {low}, least(s + {high}, n) + 1), lambda p: {cond}))"
_NL = "coalesce(a[{0}] = chr(10), false)"
_SPACE = f"coalesce(a[{{0}}] IN {_WS}, false)"
_STOP = "coalesce(a[{0}] IN ('.', '!', '?', '…'), false)"
_nl, _sp, _st = _NL.format, _SPACE.format, _STOP.format
_CUT = f"""coalesce(
  CASE WHEN n - s <= 3800 THEN n END,
  {_AT.format(low=200, high=3800, cond=f"{_nl('p')} AND {_nl('p - 1')} AND NOT {_nl('p + 1')}")},
  CASE WHEN n - s <= 4000 THEN n END,
  {_AT.format(low=1, high=4000, cond=f"({_nl('p')} AND {_nl('p - 1')}) OR ({_nl('p + 1')} AND {_nl('p + 2')}) OR ({_nl('p')} AND {_nl('p + 1')})")},
  {_AT.format(low=200, high=3800, cond=f"{_sp('p')} AND NOT {_sp('p + 1')} AND ({_st('p - 1')} OR ({_sp('p - 1')} AND ({_st('p - 2')} OR ({_sp('p - 2')} AND {_st('p - 3')}))))")},
  {_AT.format(low=1, high=4000, cond=f"{_st('p')} AND {_sp('p + 1')}")},
  CASE WHEN {_st('s')} AND {_sp('s + 1')} THEN least(s + 4000, s + coalesce(list_min(list_filter(range(1, 4001), lambda k: NOT {_sp('s + k + 1')})), 4000)) END,
  {_AT.format(low=200, high=3800, cond=f"{_sp('p')} AND NOT {_sp('p + 1')}")},
  {_AT.format(low=1, high=4000, cond=f"{_sp('p')} OR {_sp('p + 1')}")},
  s + 3800)"""
_PIECES = f"""WITH RECURSIVE b AS (SELECT DISTINCT id, string_split(extracted_text, '') a, length(extracted_text) n FROM files WHERE length(extracted_text) > 4000),
r AS (SELECT id, a, n, 0::BIGINT s, NULL::BIGINT e, 0 no FROM b UNION ALL SELECT id, a, n, e, {_CUT.replace("(s ", "(e ").replace("s +", "e +").replace("n - s", "n - e").replace("a[s]", "a[e]")}, no + 1 FROM (SELECT id, a, n, coalesce(e, 0) e, no FROM r) WHERE e < n),
c AS (SELECT id, no, s, array_to_string(a[s + 1:e], '') core, lag(array_to_string(a[s + 1:e], '')) OVER (PARTITION BY id ORDER BY no) before, count(*) OVER (PARTITION BY id) n_pieces FROM r WHERE no > 0),
v AS (SELECT *, least(200, 4000 - length(core)) room FROM c),
w AS (SELECT *, regexp_extract(right(before, room + 1), '(?s)[ \t\n\r\f]([^ \t\n\r\f].*)$', 1) words FROM v),
t AS (SELECT *, CASE WHEN before IS NULL THEN '' WHEN length(before) <= room THEN before WHEN words <> '' THEN words WHEN room > 0 THEN right(before, room) ELSE '' END tail FROM w)
SELECT t.id, f.boundary, no::BIGINT piece_no, n_pieces, s AS start, length(tail) AS overlap, tail || core piece FROM t JOIN ({{boundary}}) f ON f.id = t.id"""

SQL = {
    "p2_found": f"SELECT entity1, entity1_type, entity2, entity2_type FROM ({_PAIRS}) WHERE n12 * n_files >= 8 * n1 * n2",
    "p2_strength": f"""SELECT *, round(n12 * n_files / (n1 * n2), 6) lift,
        round(((n12 + 0.5) * (n_files - n1 - n2 + n12 + 0.5)) / ((n1 - n12 + 0.5) * (n2 - n12 + 0.5)), 6) odds_ratio FROM ({_PAIRS})""",
    "p4_found": r"""
WITH f AS (SELECT DISTINCT id, extracted_text t FROM files WHERE length(extracted_text) > 4000)
SELECT id, CASE
  WHEN list_max(list_transform(regexp_split_to_array(t, '\n{2,}'), lambda x: length(x))) <= 4000 THEN 'paragraph'
  WHEN list_max(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?…])[ \t\n\r\f]+', '\1' || chr(10) || chr(10), 'g'), '\n{2,}'), lambda x: length(x))) <= 4000 THEN 'sentence'
  WHEN list_max(list_transform(regexp_split_to_array(t, '[ \t\n\r\f]+'), lambda x: length(x))) <= 4000 THEN 'word'
  ELSE 'none' END boundary FROM f""",
    "p7_found": f"""WITH {_GRAMS} SELECT id1, id2 FROM c JOIN s a ON a.id = id1 JOIN s b ON b.id = id2 WHERE c >= 0.7 * (a.n + b.n - c)""",
    "p8_found": f"{_RUNS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (h)",
}
SQL["p7_groups"] = f"""WITH {_GRAMS}, k AS (SELECT id, list_sort(list(h)) k FROM g GROUP BY id),
m AS (SELECT id, min(id) OVER (PARTITION BY k) class_id, count(*) OVER (PARTITION BY k) copies FROM k),
near AS (SELECT id1, id2 FROM c JOIN s a ON a.id = id1 JOIN s b ON b.id = id2 WHERE c >= 0.8 * (a.n + b.n - c)),
l AS (SELECT x.class_id a, y.class_id b FROM near JOIN m x ON x.id = id1 JOIN m y ON y.id = id2 WHERE x.class_id <> y.class_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), n AS (SELECT a, count(*) n FROM e GROUP BY a)
SELECT m.id, class_id, copies, coalesce(n.n, 0) n_links FROM m LEFT JOIN n ON n.a = class_id"""
SQL["p4_pieces"] = _PIECES.replace("{boundary}", SQL["p4_found"])
