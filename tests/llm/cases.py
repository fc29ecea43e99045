"""Small tables with the awkward cases, and brute-force versions of the operators."""

import re

import duckdb
import numpy as np
import xxhash

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["id", "place", "digest", "fingerprint", "root", "size", "lot", "key", "part", "taken", "bucket", "kept", "best", "words", "score", "lang_pred", "lines", "host", "payload", "path"]
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river in the evening light of the day"


def edge_rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (3, PROSE.replace(" ", "\n\t"), "en", None, None),
        (4, None, "en", "b", 0), (5, "", None, "b", 0), (6, " \t\r\n\x0b\x0c", "de", "c", 3), (None, PROSE, "en", "a", 5), (None, None, None, None, None),
        (7, "1234 5678 !!", "en", "b", 9), (8, long, "en", "a", len(long)), (9, long + " end", "en", "a", 7), (10, "Ünïcödé é é \U0001f600  x", "fr", "é", 2),
        (11, "one", "en", "a", 3), (12, "two words", "de", "c", 9), (13, "x" * 5000, None, "z", 5000), (2**62, "one", "en", "a", 3), (-5, "one ", "en", "a", 4),
        (14, "der die das und nicht ein eine auf dem der die das und", "de", "c", 1), (15, "le la les des et en un une du que le la", "fr", "b", 1),
    ]


def frame(spark, rows, clashing=True, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clashing:
        for c in CLASHING:
            df = df.withColumn(c, df["n_chars"])
    return df


def documents(folder=FOLDER):
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{folder}/documents.parquet'").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def linked(values, radius=4):
    """The class of each value, as the least index that is reached by links."""
    found, root = np.array(values, np.uint64), list(range(len(values)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(found)):
        for j in np.flatnonzero(np.bitwise_count(found[i] ^ found[i + 1 :]) <= radius) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(found))]


def simhash_rows(rows):
    """Sorted (doc_id, hex, component id) by brute force."""
    prints = [fingerprint(r[1]) for r in rows]
    group, least = linked(prints), {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
