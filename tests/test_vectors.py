"""Vector search against numpy, chunks and context."""

import numpy as np

from vellumq.operators import vectors as V


def test_top_k(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[0]))[:10].tolist()
    assert [a["id"] for a in V.top_k(df, x[0].tolist(), 10, -1).collect()] == want
    many = V.top_k_many(df.where("vec_id < 200"), [(0, x[0].tolist()), (5, x[5].tolist())], 5).collect()
    assert sorted((a["rank"], a["id"]) for a in many if a["query"] == 0) == list(enumerate(want[1:6], 1))
    assert V.top_k(df.limit(0), x[0].tolist()).count() == 0


def test_chunks_and_context(spark):
    assert V.chunk_text("") == [] and V.chunk_text(None) == [] and V.chunk_text("Одно предложение.") == ["Одно предложение."]
    long = " ".join(f"w{i}" for i in range(200))
    assert all(len(c.split()) <= 80 for c in V.chunk_text(long)) and V.chunk_text(long)[1].split()[0] == "w65"
    t = " ".join(f"Предложение номер {i} тут." for i in range(60))
    cs = V.chunk_text(t)
    assert all(len(c.split()) <= 80 for c in cs) and cs[1].split(".")[0].strip() in cs[0]
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, t string")
    c = V.chunks(df, "id", "t")
    assert V.store_stats(c).first()["n_documents"] == 1
    from pyspark.sql import functions as F

    got = V.context(c.select("chunk_id", "doc_id", "text", F.col("chunk_index").cast("double").alias("score")), k=5, per_doc=3).collect()
    assert len(got) == 3 and sum(len(x["text"]) for x in got) <= 6000
