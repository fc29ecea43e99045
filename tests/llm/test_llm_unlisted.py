"""Languages without a list of common words beside others, and marking words that begin with other words."""

import random

import duckdb
import pandas as pd
import pytest
from cases import documents, frame

from stepgrove.llm import quality, toxicity

ITALIAN = "la casa di una donna che non parla con il signore e per un po del tempo al mare con la luna e una stella su un ponte " * 6
RUSSIAN = "в начале было слово и слово было у моря и каждый день над ним вставало солнце " * 12


def gibberish():
    draw = random.Random(11)
    return " ".join("".join(draw.choices("bcdfghklmnprstvz", k=draw.randint(4, 8))) for _ in range(150))


@pytest.mark.parametrize("plan", [64, 0])
@pytest.mark.parametrize(("lang", "text"), [("it", ITALIAN), ("ru", RUSSIAN)])
def test_a_language_without_a_list_excuses_no_others(spark, monkeypatch, plan, lang, text):
    monkeypatch.setattr(quality, "MAX_LANGUAGES", plan)
    rows = [*documents(), (10**6, gibberish(), "en", "a", 1)]
    before = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    rows += [(10**6 + 1, text, lang, "a", 1)]
    after = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert not before[10**6].base_failed and not before[10**6].kept
    assert not after[10**6].kept and after[10**6].nearest != "ru"
    base = after.pop(10**6 + 1)
    assert base.nearest == lang and (base.kept or base.base_failed)
    if lang == "ru":
        assert after == before
    assert all(r.kept for d, r in after.items() if before[d].kept)


@pytest.mark.parametrize("text", [ITALIAN, RUSSIAN])
def test_unlisted_languages_against_sql(spark, text):
    rows = [*documents(), (10**6, gibberish(), "en", "a", 1), (10**6 + 1, text, "xx", "a", 1), (10**6 + 2, gibberish(), None, "a", 1)]
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
        want = sorted(db.sql(quality._sql()).fetchall())
    got = quality.quality(frame(spark, rows))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(tuple, got.select(*columns).collect())) == want


def test_words_that_begin_with_a_marking_word(spark):
    draw = random.Random(7)
    plain = ["".join(draw.choices("aeioulnrst", k=7)) for _ in range(200)]
    rows = [(i, draw.choices(plain, k=25) + (["zak"] if i < 60 else ["zakrunvex"] if i < 90 else [])) for i in range(600)]
    docs = frame(spark, [(i, " ".join(w), "en", "a", 1) for i, w in rows] + [(900, " ".join([*plain[:20], "zakrunvex"]), "en", "a", 1)])
    labels = spark.createDataFrame([(i, int(i < 90)) for i, _ in rows], "doc_id bigint, toxic int")
    found, _ = toxicity.examples(docs, labels)
    chosen = toxicity.vocabulary(found, 510, 90)
    held = lambda word: any(t in chosen for t in toxicity.terms_of_word(word))
    assert held("zak") and held("zakrunvex")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()}
    assert got[900] >= 0.5 and got[10] >= 0.5 and got[70] >= 0.5 and got[300] < 0.5
