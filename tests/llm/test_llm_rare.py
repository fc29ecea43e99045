"""Markers of a rare language."""

import random
import zlib

from cases import frame
from pyspark.sql import functions as F

from stepgrove.llm import toxicity


def test_markers_of_a_rare_language_are_learned(spark):
    draw = random.Random(5)
    neutral = {k: [f"{k}{''.join(draw.choices('aeioulnrst', k=6))}" for _ in range(150)] for k in ("x", "y")}
    markers = {k: [f"{k}{''.join(draw.choices('bcdfgkmpz', k=7))}" for _ in range(4)] for k in ("x", "y")}
    rows, labels, held = [], [], []
    for k, plain, toxic in (("x", 1500, 400), ("y", 150, 20)):
        for i in range(plain + toxic):
            found = draw.choices(neutral[k], k=30) + (draw.sample(markers[k], 3) if i >= plain else [])
            draw.shuffle(found)
            rows.append((len(rows), " ".join(found), k, "a", 1))
            known = i % 3 != 2
            labels += [(rows[-1][0], int(i >= plain))] if known else []
            held += [] if known else [(rows[-1][0], k, i >= plain)]
    docs = frame(spark, rows)
    voter = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, voter).collect()}
    for k in ("x", "y"):
        toxic = [d for d, lang, t in held if lang == k and t]
        assert toxic and sum(got[d].score >= 0.5 for d in toxic) >= 0.9 * len(toxic)
    assert sum(got[d].score >= 0.5 for d, _, t in held if not t) <= 0.01 * len(held)
    assert all(r.nearest is not None for r in got.values())


def test_half_of_the_spanish_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("lang IS NULL OR lang <> 'es' OR doc_id % 2 = 0")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, known)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    found = lambda rows: sum(r.score >= 0.5 for r in rows)
    rare = [r for r in held if r.lang == "es" and r.toxic]
    others = [r for r in held if not r.toxic]
    print("spanish", len(rare), found(rare), "plain", len(others), found(others), "toxic", sum(r.toxic for r in held), found([r for r in held if r.toxic]))
    assert rare and found(rare) >= 0.8 * len(rare)
    assert found(others) <= 0.01 * len(others)
