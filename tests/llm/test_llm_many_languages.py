"""More languages than the plan or the codes hold."""

import pytest
from cases import documents, frame
from pyspark.sql import functions as F

from stepgrove.llm import language, quality


def test_quality_of_many_languages(spark, monkeypatch):
    rows = documents()[:120]
    want = sorted(map(tuple, quality.quality(frame(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 1)
    got = sorted(map(tuple, quality.quality(frame(spark, rows)).collect()), key=repr)
    assert [r[:9] for r in got] == [r[:9] for r in want]
    assert [r[9:] for r in got] == [pytest.approx(r[9:]) for r in want]
    monkeypatch.undo()
    many = [(r[0], r[1], f"{r[2]}-{i % 80}", *r[3:]) for i, r in enumerate(rows)]
    assert quality.quality(frame(spark, many)).count() == len(many)


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    texts = {"a": "abab acac ", "b": "bdbd dede ", "c": "cfcf fgfg "}
    rows = [(i, texts[k] * 20, k) for i, k in enumerate("aaabbbc")]
    codes = language.learn(spark.createDataFrame(rows, "key bigint, text string, lang string"))
    assert codes.langs == ["a", "b"]
    got = language.predict(spark.createDataFrame(rows, "key bigint, text string, lang string").drop("lang"), codes)
    assert {r.lang_pred for r in got.filter(F.col("key") < 3).collect()} == {"a"} and got.count() == len(rows)
