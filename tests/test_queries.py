"""Every registered query against its SQL on the small tables."""

import glob
import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SLOW = {"induced_concepts"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW and n != "pipeline" and not re.match(r"op\d+_", n)])
def test_query(spark, con, name):
    state, n, _, note = compare(spark, con, name, FOLDER)
    assert state == "ok", f"{state} {n} {note}"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
