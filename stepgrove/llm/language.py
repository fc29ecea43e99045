"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1 bits; one binary classifier per bit, a naive Bayes log ratio over hashed
character trigrams, says which of two groups of languages a text looks like. A text goes to the language whose
codeword has the least loss, the loss of each bit weighted by how well its classifier parts that language from the
others; texts about as near to a second codeword are flagged as ambiguous.

Trigrams are counted per language in the tasks and summed by Spark, so the driver sees languages x buckets numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import fraction_of_crc, freeing, query, table

#: Hash buckets of the trigrams.
BUCKETS = 2**15
#: Labelled rows per language that the counts are taken from, by expectation (a hash of the id picks them).
TRAIN_ROWS = 200_000
#: Up to this many languages every split of them is a bit; beyond it, BITS_PER_DOUBLING random splits.
EXHAUSTIVE = 7
BITS_PER_DOUBLING = 12
#: Languages that are learned at most, those with the most labelled rows; every task holds their codewords and weights.
MAX_LANGUAGES = 512
#: Trigrams after which more text adds no confidence, and the share of the best under which a text is ambiguous.
ENOUGH = 300
AMBIGUOUS = 0.6
UNDETERMINED = "und"

_CHUNK = 1 << 20
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _letters(data):
    """The text of UTF-8 bytes if it has a letter, else None."""
    text = None if data is None else data.decode("utf-8", "replace")
    return text if text and any(map(str.isalpha, text)) else None


def trigrams(text):
    """Bucket numbers of the byte trigrams of the lower-cased text, in blocks; other ASCII characters are blanks."""
    folded = f" {text.lower()} ".encode("utf-8", "replace").translate(_FOLD)
    data = np.frombuffer(folded, np.uint8)
    for at in range(0, len(data) - 2, _CHUNK):
        part = data[at : at + _CHUNK + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        yield (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def trigram_counts(rows):
    """(lang, bucket, n) over rows (lang, text); sums leave each task once."""

    def run(batches):
        sums = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                text = _letters(data)
                if text is not None:
                    into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for block in trigrams(text):
                        into += np.bincount(block, minlength=BUCKETS)
        for lang, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(into[at])],
                names=["lang", "bucket", "n"],
            )

    plain = rows.select("lang", F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(freeing(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n, seed=7):
    """An n x bits matrix of +1 and -1; rows differ in as many bits as can be."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    draw, width = np.random.default_rng(seed), BITS_PER_DOUBLING * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        code = np.where(draw.permuted(np.tile(np.arange(n) % 2, (width, 1)), axis=1).T, 1.0, -1.0)
        least = np.min((width - code @ code.T)[~np.eye(n, dtype=bool)])
        if least > apart:
            best, apart = code, least
    return best


class Codes:
    """The fitted classifiers: trigram weights per bit, codewords and loss weights per language."""

    def __init__(self, langs, counts):
        self.langs = langs
        smooth = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.code = codewords(len(langs))
        plus, minus = self.code > 0, self.code < 0
        rate = lambda side: (side.T / np.maximum(side.sum(axis=0), 1)[:, None]) @ smooth
        whole = plus.any(axis=0) & minus.any(axis=0)
        ratio = np.log(np.where(whole[:, None], rate(plus), 1.0)) - np.log(np.where(whole[:, None], rate(minus), 1.0))
        self.weights = np.ascontiguousarray(ratio.T, np.float32)
        parted = np.maximum(self.code * (smooth @ ratio.T), 1e-6)  # mean margin of a language on a bit
        self.trust = parted / parted.sum(axis=1, keepdims=True)

    def decode(self, text):
        """(language, share of the best, ambiguous) of a text with a letter."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for block in trigrams(text):
            total += self.weights[block].sum(axis=0, dtype=np.float64)
            n += len(block)
        margin = total / max(n, 1) * min(n, ENOUGH)
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(np.argmax(share))
        return self.langs[best], float(share[best]), bool(share[best] < AMBIGUOUS)


def learn(rows):
    """Fit the codes on rows (key, lang, text); null languages are left out, the key only picks the sample.

    Of more than MAX_LANGUAGES languages those with the most rows are learned, ties by name; texts of the others are
    given to the learned language they are nearest to.
    """
    labelled = rows.filter(F.col("lang").isNotNull())
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    labelled = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame([(k,) for k in sizes], "lang string")), "lang", "left_semi")
    if any(n > TRAIN_ROWS for n in sizes.values()):
        drawn = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1_000_000
        rate = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, TRAIN_ROWS / n)) for k, n in sizes.items()])
        labelled = labelled.filter(drawn < rate)
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS))
    for row in trigram_counts(labelled).collect():
        counts[langs.index(row["lang"]), row["bucket"]] = row["n"]
    seen = counts.any(axis=1)
    return Codes([k for k, s in zip(langs, seen) if s], counts[seen])


def predict(docs, codes, text="text", prefix=""):
    """``docs`` with lang_pred, score and ambiguous (names behind ``prefix``); only the text is looked at.

    Null texts, texts without a letter and all texts when nothing was learned are ``und`` with score 0. Whole texts
    are read, in blocks. Ties go to the language that sorts first.
    """
    added = [prefix + c for c in ("lang_pred", "score", "ambiguous")]
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spare = "text_" + "_".join(docs.columns)

    def run(batches):
        for batch in batches:
            found = []
            for data in batch.column(spare).to_pylist():
                known = _letters(data) if codes.langs else None
                found.append(codes.decode(known) if known is not None else (UNDETERMINED, 0.0, True))
            names = [c for c in batch.schema.names if c != spare]
            columns = [pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], names=[*names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)])
    return docs.withColumn(spare, F.col(text).cast("binary")).mapInArrow(freeing(run), schema)


def held_out(key):
    """The fold that isn't learned from; a null id isn't in it and isn't learned from either."""
    return F.coalesce(fraction_of_crc(key, 4) == 2, F.lit(False))


def learn_documents(docs):
    taken = docs.filter(fraction_of_crc(F.col("doc_id"), 4) != 2)
    return learn(taken.select(F.col("doc_id").alias("key"), "lang", "text"))


def keep_identified(docs, codes):
    """The rows of ``docs`` whose text has a language, with the columns of ``docs``: ``und`` rows go."""
    prefix = "found_" + "_".join(docs.columns) + "_"
    scored = predict(docs, codes, prefix=prefix)
    return scored.filter(F.col(prefix + "lang_pred") != UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op3_language_id")
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    codes = learn_documents(docs)
    out = predict(docs.select("doc_id", "text"), codes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
