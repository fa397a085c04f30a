"""Queries of the lookups, kept postings and single functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.operators import entities as E
from vellumq.operators import graph as G
from vellumq.operators import index as X
from vellumq.operators import lookup as L
from vellumq.operators import search as S
from vellumq.operators import timeline as D
from vellumq.operators import vectors as V
from vellumq.plans import reference as R
from vellumq.session import checkpoint_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_links")


_KIND = "CASE " + " ".join(f"WHEN lower(extension) IN ({', '.join(repr(e) for e in es)}) THEN '{k}'" for k, es in L.FILE_KINDS.items()) + " WHEN extension IS NOT NULL THEN 'other' END"


@query(f"WITH {R._CURRENT} SELECT {_KIND} kind, count(*) n, sum(size)::BIGINT size FROM cur GROUP BY 1")
def idx_kinds(spark, sf):
    return X.current(files(spark, sf)).groupBy(L.file_kind(F.col("extension")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query(f"WITH {R._CURRENT} SELECT id, path FROM cur WHERE {_KIND} IN ('office', 'pdf') AND (contains(lower(filename), 'a') OR contains(lower(path), 'a'))")
def idx_of_kind(spark, sf):
    return L.of_kind(files(spark, sf), ["office", "pdf"], "a").select("id", "path")


@query(f"WITH {R._CURRENT} SELECT id, path, size FROM cur ORDER BY path, id LIMIT 50")
def idx_listed(spark, sf):
    return L.listed(files(spark, sf), 50).select("id", "path", "size")


@query("""WITH r AS (SELECT DISTINCT id, entities_json j FROM files WHERE json_valid(entities_json)),
t AS (SELECT r.id, r.j, k.key kind, k.value vs FROM r, json_each(r.j) k WHERE json_type(k.value) = 'ARRAY' AND upper(k.key) NOT IN ('DATES', 'DATE')), v AS (SELECT DISTINCT t.id, t.j, trim(x.value ->> '$', ' ') v FROM t, json_each(t.vs) x WHERE length(trim(x.value ->> '$', ' ')) > 0)
SELECT a.v value1, b.v value2, count(*) n FROM v a JOIN v b ON a.id = b.id AND a.j = b.j AND a.v < b.v GROUP BY 1, 2""")
def idx_document_pairs(spark, sf):
    return L.document_pairs(files(spark, sf))


@query(f"WITH {R._EDGE}, n AS (SELECT id, min(label) label FROM (SELECT a id, entity1 label FROM lx UNION ALL SELECT b, entity2 FROM lx) GROUP BY id) SELECT x.label a, y.label b, 'cooccurrence' relation, e.weight, e.n, e.n_files FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst".replace("e AS (SELECT least", f"lx AS (SELECT {R._NODE.format(t='entity1_type', v='entity1')} a, {R._NODE.format(t='entity2_type', v='entity2')} b, entity1, entity2 FROM entity_links WHERE entity1 IS NOT NULL AND entity2 IS NOT NULL AND entity1_type IS NOT NULL AND entity2_type IS NOT NULL), e AS (SELECT least", 1))
def gr_labelled(spark, sf):
    return L.labelled(*G.from_links(links(spark, sf)))


@query("SELECT count(*) n, round(sum(weight), 4) weight, count(*) FILTER (entity1 = 'Новый Узел') fresh FROM (SELECT entity1, weight FROM entity_links UNION ALL SELECT 'Новый Узел', 1.0)")
def idx_add_links(spark, sf):
    more = spark.createDataFrame([("Новый Узел", "PERSONS", "Другой", "PERSONS", 1), (None, "PERSONS", "x", "PERSONS", 1), (" ", "P", "x", "P", 2)], "entity1 string, entity1_type string, entity2 string, entity2_type string, file_id bigint")
    x = L.add_links(links(spark, sf), more)
    return x.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.count(F.when(F.col("entity1") == "Новый Узел", 1)).alias("fresh"))


@query("""WITH p AS (SELECT min(path) path FROM files), i AS (SELECT DISTINCT id FROM files WHERE path IN (SELECT path FROM p))
SELECT id file_id, 'А' entity1, 'ORGANIZATIONS' entity1_type, 'Б' entity2, 'PERSONS' entity2_type, 1.0 weight FROM i UNION ALL
SELECT file_id, entity1, entity1_type, entity2, entity2_type, weight FROM entity_links WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT id FROM i) AND file_id < 20""")
def idx_update_entities(spark, sf):
    f = files(spark, sf)
    updates = f.agg(F.min("path").alias("path")).withColumn("entities_json", F.lit('{"PERSONS": ["Б"], "ORGANIZATIONS": ["А"]}'))
    new = L.update_entities(f, links(spark, sf), updates)[1]
    changed = f.join(updates.select("path"), "path", "left_semi").select(F.col("id").alias("file_id")).distinct()
    mine = new.join(changed, "file_id", "left_semi").select("file_id", "entity1", "entity1_type", "entity2", "entity2_type", "weight")
    return mine.unionByName(new.where("file_id < 20").join(changed, "file_id", "left_anti").select(*mine.columns))


_FIRST = "WITH l AS (SELECT DISTINCT lower(entity1) v FROM entity_links WHERE entity1_type = 'ORGANIZATIONS'), q AS (SELECT min(v) q FROM l)"
_TRI = "list_distinct(list_transform(range(1, length('  ' || {0} || '  ') - 1), lambda i: substr('  ' || {0} || '  ', i, 3)))"


@query(f"""{_FIRST}, s AS (SELECT v, q, CASE WHEN length(q) <= length(v) THEN {_TRI.format('q')} ELSE {_TRI.format('v')} END x, CASE WHEN length(q) <= length(v) THEN {_TRI.format('v')} ELSE {_TRI.format('q')} END y,
 list_distinct(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) a, list_distinct(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) b FROM l, q)
SELECT v AS value, round(CASE WHEN contains(v, q) OR contains(q, v) THEN 100 ELSE len(list_intersect(x, y)) / len(x) * 100 END, 4) partial, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) * 100 ELSE 0 END, 4) token_set FROM s""")
def txt_ratios(spark, sf):
    v = links(spark, sf).where("entity1_type = 'ORGANIZATIONS'").select(F.lower("entity1").alias("value")).distinct()
    q = F.lit(v.agg(F.min("value")).first()[0] or "")
    return v.select("value", F.round(L.partial_ratio(q, F.col("value")), 4).alias("partial"), F.round(L.token_set_ratio(q, F.col("value")), 4).alias("token_set"))


@query(f"""{_FIRST}, s AS (SELECT v AS value, len(list_intersect({_TRI.format('q')}, {_TRI.format('v')})) / len(list_distinct(list_concat({_TRI.format('q')}, {_TRI.format('v')}))) * 100 score FROM l, q)
SELECT value, round(score, 6) score FROM s WHERE score >= 30 ORDER BY s.score DESC, value LIMIT 10""")
def txt_find_matches(spark, sf):
    v = links(spark, sf).where("entity1_type = 'ORGANIZATIONS'").select(F.lower("entity1").alias("value")).distinct()
    return L.find_matches(v, v.agg(F.min("value")).first()[0] or "", 30.0).withColumn("score", F.round("score", 6))


_CASES = [("договорами", "договор"), ("сверки", "сверк"), ("красный", "красн"), ("Платежей", "платеж"), ("работающих", "работа")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{f}')" for w, s in _CASES for f in dict.fromkeys([w.lower(), s])) + ") t(word, form)")
def txt_word_forms(spark, sf):
    return L.word_forms(spark.createDataFrame([(w,) for w, _ in _CASES], "word string"))


_GUESS = "CASE " + " ".join(f"WHEN regexp_matches(lower(entity1), '{p}') THEN '{k}'" for k, p in [("ORGANIZATIONS", r"(^|[^\p{L}\p{N}_])(ооо|оао|зао|пао|ао|ип|банк[\p{L}\p{N}_]*|компани[\p{L}\p{N}_]*)($|[^\p{L}\p{N}_])"), ("LOCATIONS", r"(^|[^\p{L}\p{N}_])(город|област|улиц|район|г\.|ул\.)"), ("MONEY", r"(^|[^\p{L}\p{N}_])(руб[\p{L}\p{N}_]*|долл[\p{L}\p{N}_]*|млн|млрд)($|[^\p{L}\p{N}_])|[$€₽]"), ("DATES", r"\d{1,2}[./]\d{1,2}[./]\d{2,4}")]) + " ELSE 'UNKNOWN' END"


@query(f"SELECT entity1_type, {_GUESS} guess, count(DISTINCT entity1) n FROM entity_links WHERE entity1 IS NOT NULL GROUP BY ALL")
def ner_guessed_types(spark, sf):
    x = links(spark, sf).where("entity1 is not null").select("entity1_type", "entity1").distinct()
    return x.groupBy("entity1_type", E.guessed_type(F.col("entity1")).alias("guess")).agg(F.count("*").alias("n"))


@query(f"SELECT id, date, count(*) n FROM (SELECT DISTINCT id, date FROM ({R._ALL_DATES}) WHERE date IS NOT NULL) GROUP BY ALL")
def tml_first_dates(spark, sf):
    return L.first_dates(D.text_events(files(spark, sf))).groupBy("id", "date").agg(F.count("*").alias("n"))


def kept_postings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The postings of the files at rest in the shared folder, made when they are not there."""
    import xxhash

    folder = f"{checkpoint_dir(spark)}/postings-{xxhash.xxh3_64_hexdigest(sf)}-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/docs/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        S.write_postings(files(spark, sf), folder)
    return spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/docs")


@query(R._bm25(["акт", "сверки"], phrase=False))
def fts_kept(spark, sf):
    return S.search_kept(*kept_postings(spark, sf), "Акт сверки").select("id", "path", "score")


@query()
def fts_reranked(spark, sf):
    return L.search_reranked(files(spark, sf), "Акт сверки", 20)




@query("SELECT DISTINCT id, (SELECT len(regexp_extract_all(' ' || lower(extracted_text), '[^\\p{L}\\p{N}]ledger'))) > 0 marked FROM files WHERE contains(lower(extracted_text), 'ledger')")
def fts_snippets(spark, sf):
    x = files(spark, sf).where(F.lower("extracted_text").contains("ledger"))
    return x.select("id", S.snippet(F.col("extracted_text"), ["ledger"]).contains("<mark>").alias("marked")).distinct()


@query("SELECT count(*) n FROM documents d WHERE length(text) >= 0 AND doc_id <> (SELECT min(doc_id) FROM documents)")
def vec_delete_document(spark, sf):
    d = table(spark, sf, "documents")
    first = d.agg(F.min("doc_id").alias("doc_id"))
    return V.delete_documents(d.where("text is not null"), first).agg(F.count("*").alias("n"))


@query("SELECT '{\"type\":\"scan\",\"folder\":\"' || folder || '\",\"n\":' || count(*) || '}' AS value FROM (SELECT DISTINCT * FROM scans) WHERE regexp_full_match(folder, '[^\"\\\\]*') GROUP BY folder")
def str_event_lines(spark, sf):
    s = table(spark, sf, "scans").distinct().where(~F.col("folder").rlike(r'["\\]'))
    return L.event_lines(s.groupBy("folder").agg(F.count("*").alias("n")), "scan")


