"""Queries of this subpackage against their SQL, and the pipeline against its stages by brute force."""

import glob
import os
import sys

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from cases import FOLDER, documents, ordered
from tokenizers import Tokenizer

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_queries import compare  # noqa: E402

from stepgrove.llm import ORACLES, QUERIES, packing  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    state, n, _, note = compare(spark, con, name, FOLDER)
    assert state == "ok", f"{state} {n} {note}"


def test_pipeline(spark):
    import re

    from test_llm_similar import kept
    from test_llm_text import mixed

    rows = [r for r in documents() if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for r in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        first[bare] = min(first.get(bare, r), r, key=lambda r: (-len(r[1]), r[0]))
    rows = sorted(first.values())
    stay = set(kept(rows))
    rows = [r for r in rows if r[0] in stay]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    text = {r[0]: r[1] for r in rows}
    for d, n, _, _, taken in mixed(rows):
        copies = taken // n + (2 * (taken % n) >= n if taken % n else 0)
        total = len(tokenizer.encode(text[d], add_special_tokens=False).ids) + 1
        want += [(d, total, n) for n in packing.decompose(total)] * copies
    got = corpus_pipeline.run(spark, FOLDER)
    assert ordered((r.doc_id, r.doc_tokens, r.length) for r in got.collect()) == ordered(want)


def test_stages_keep_the_columns(spark, tmp_path):
    from cases import edge_rows, frame

    frame(spark, edge_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


