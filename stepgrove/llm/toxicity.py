"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms that labelled toxic texts hold surely and clearly more often than others make the vocabulary, however rare. Labelled texts become
TF-IDF vectors over it, with one more dimension for all other words, so that the amount of marking terms counts;
equal vectors are one example with the votes of all its texts. An inverted index keeps the
postings in blocks with the largest weight of each term per block: blocks are opened in order of the bound this gives
on any cosine inside, until the bound falls to the k-th best cosine, so the k nearest are exact. Votes weigh by
closeness and by the share of its class an example stands for, and are smoothed towards the base rate.

Only the examples are a sample, of bounded size; every text is scored whole against all of them.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stepgrove.session import materialize

from .catalog import fraction_of_crc, query, table

#: Labelled rows per class that examples are made of (a hash of the id picks them).
EXAMPLES = 10_000
#: Labelled texts a term must occur in, how surely it marks (minus the log of a bound on the chance of as many toxic
#: texts, one in a thousand), and how much more often than others toxic texts must hold it. No level depends on other terms.
LEAST_TEXTS = 4
LEAST_SURPRISE = 6.9
LEAST_LIFT = 3
#: Neighbours that vote, examples per index block, softness of the closeness weight, pseudo-votes of the base rate.
NEIGHBOURS = 20
BLOCK = 64
SOFT = 0.05
SMOOTH = 1.0
#: Scores a task remembers by vector.
REMEMBERED = 50_000

#: Lengths of the word beginnings that are terms beside the words, for words that change their endings.
STEMS = (3, 4, 5, 6)
#: Words and sums a task remembers.
WORDS_KEPT = 300_000
SUMS_KEPT = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(data):
    """The lower-cased runs of letters of a text given as UTF-8 bytes or None."""
    return _WORD.findall(data.decode("utf-8", "replace").lower()) if data else []


def terms_of_word(word):
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def examples(docs, labels):
    """(digest, toxic, example, text) of the sampled labelled texts, equal texts once; and the labels by document."""
    labelled = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    pick = lambda k: labelled.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    sample = F.broadcast(pick(0).unionByName(pick(1)))  # 2 x EXAMPLES rows of two numbers
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(sample, "doc_id")
    return rows.withColumn("digest", F.sha2("text", 256)).groupBy("digest").agg(
        F.max("toxic").alias("toxic"), F.min("doc_id").alias("example"), F.any_value("text").alias("text")
    ), labelled


def vocabulary(rows, n0, n1):
    """The terms that mark toxic texts, numbered, with the number of texts that hold them."""

    def run(batches):
        sums = {}

        def flush():
            found = list(sums.items())
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()), *[pa.array([n[k] for _, n in found], pa.int64()) for k in (1, 0)]],
                names=["term", "a", "b"],
            )

        for batch in batches:
            for data, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in {t for w in set(words_of(data)) for t in terms_of_word(w)}:
                    sums.setdefault(term, [0, 0])[toxic] += 1
                if len(sums) > SUMS_KEPT:
                    yield flush()
        yield flush()

    held = rows.select("text", "toxic").mapInArrow(run, "term string, a bigint, b bigint")
    held = held.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, a, b = n0 + n1, F.col("a").cast("double"), F.col("b").cast("double")
    off = a * n0 - b * n1
    chi = off * off * n / ((a + b) * (n - a - b) * float(n0 * n1))
    share, base = a / (a + b), n1 / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    surprise = (a + b) * (part(share, F.lit(base)) + part(1 - share, F.lit(1 - base)))
    marking = (a + b >= LEAST_TEXTS) & (a + b < n) & (a * n0 >= LEAST_LIFT * b * n1) & (surprise >= LEAST_SURPRISE)
    scored = held.filter(marking).withColumn("chi", chi)
    chosen, begun = {}, {}
    for r in scored.orderBy(F.desc("chi"), F.desc(F.length("term")), "term").collect():
        stem, held_by = r["term"].rstrip("-"), (r["a"], r["b"])
        starts = [stem[:i] for i in range(1, len(stem))]
        # What follows a better beginning says the same, and so does a beginning of one word; a wider one says more. A
        # chosen word stands in nobody's way: longer words are other words.
        same = r["term"] != stem and held_by in begun.get(stem, ())
        if not same and not any(f"{x}-" in chosen for x in starts):
            for x in starts:
                begun.setdefault(x, set()).add(held_by)
            chosen[r["term"]] = (len(chosen), r["a"] + r["b"])
    return chosen


class Counter:
    """Counts of the vocabulary's terms in a text, as a sorted tuple of (term number, count).

    The last pair is a number beyond the terms and the power of two next to the number of other words, which is 1 in a
    text without any term (its direction is the same). Texts without words give an empty tuple.
    """

    def __init__(self, terms):
        self.number, self.known = {t: i for t, (i, _) in terms.items()}, {}

    def count(self, data):
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        counts, others = {}, 0
        for word in words_of(data):
            held = self.known.get(word)
            if held is None:
                held = self.known[word] = tuple(self.number[t] for t in terms_of_word(word) if t in self.number)
            for t in held:
                counts[t] = counts.get(t, 0) + 1
            others += not held
        if not counts:
            return ((len(self.number), 1),) if others else ()
        return (*sorted(counts.items()), (len(self.number), 1 << others.bit_length()))


def vectors(rows, terms):
    """(toxic, example, numbers, counts) of the example texts."""

    def run(batches):
        counter = Counter(terms)
        for batch in batches:
            found = [counter.count(data) for data in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("example"), *[pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1)]],
                names=["toxic", "example", "numbers", "counts"],
            )

    return rows.select("toxic", "example", "text").mapInArrow(run, "toxic int, example bigint, numbers array<int>, counts array<int>")


class Index:
    """Distinct example vectors in blocks, with the largest weight of each term per block."""

    def __init__(self, vectors, votes, shown):
        # Examples alike in their strongest term are put side by side, so block bounds are tight.
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), -float(vectors[i][1].max()), i))
        self.votes = np.array([votes[i] for i in order], float).reshape(-1, 2)
        self.shown = [shown[i] for i in order]
        self.n = len(order)
        self.blocks = -(-self.n // BLOCK)
        lists = {}
        for at, i in enumerate(order):
            for t, w in zip(*vectors[i]):
                lists.setdefault(int(t), []).append((at, w))
        size = max(lists, default=-1) + 1
        self.top = np.zeros((size, self.blocks))
        self.postings = {}
        for t, found in lists.items():
            at, w = np.array([x for x, _ in found]), np.array([x for _, x in found])
            self.postings[t] = (at, w, np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK))
            np.maximum.at(self.top[t], at // BLOCK, w)

    def nearest(self, terms, weights, k=NEIGHBOURS):
        """The positions and cosines of the k nearest examples with a cosine above 0, nearest first."""
        own = [(t, w) for t, w in zip(terms, weights) if t in self.postings]
        if not own:
            return np.zeros(0, int), np.zeros(0)
        bound = sum(w * self.top[t] for t, w in own)
        at, cosines, least = np.zeros(0, int), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= least + 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in own:
                places, found, cut = self.postings[t]
                i, j = cut[b], cut[b + 1]
                score[places[i:j] - b * BLOCK] += w * found[i:j]
            some = np.flatnonzero(score > least)
            at, cosines = np.concatenate((at, some + b * BLOCK)), np.concatenate((cosines, score[some]))
            if len(at) > k:
                best = np.lexsort((at, -cosines))[:k]
                at, cosines = at[best], cosines[best]
            if len(at) == k:
                least = cosines.min()
        best = np.lexsort((at, -cosines))
        return at[best], np.minimum(cosines[best], 1.0)


class Voter:
    def __init__(self, terms, total, rows, scale, base):
        """``rows`` of (toxic, example, numbers, counts); ``scale`` are the rows of class 0 and 1 that one stands for."""
        self.base, self.counter = base, Counter(terms)
        self.idf = np.array([*(np.log((1 + total) / (1 + n)) + 1 for _, n in terms.values()), 1.0])
        plain, grouped = ((len(terms), 1),), {}
        for toxic, example, numbers, counts in rows:
            key, vote = tuple(zip(numbers, counts)) or plain, np.array([toxic * scale[toxic], scale[toxic]])
            if key in grouped:
                grouped[key][0] += vote
                grouped[key][1] = min(grouped[key][1], example)
                grouped[key][2] += 1
            else:
                grouped[key] = [vote, example, 1]
        # Texts without a marking term are the example at the far end of the last dimension.
        self.rest = grouped[plain][0] if plain in grouped else np.zeros(2)
        keys = sorted(grouped)
        self.index = Index([self.vector(k) for k in keys], [grouped[k][0] for k in keys], [grouped[k][1] for k in keys])
        self.texts = {grouped[k][1]: grouped[k][2] for k in keys}
        self.known = {}

    def vector(self, key):
        at = np.array([t for t, _ in key])
        weights = (1 + np.log([n for _, n in key])) * self.idf[at]
        return at, weights / np.sqrt((weights**2).sum())

    def score(self, data):
        """(score, nearest example, its cosine) of a text given as bytes."""
        key = self.counter.count(data)
        if key not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[key] = self._vote(key)
        return self.known[key]

    def _vote(self, key):
        at, cosines = self.index.nearest(*self.vector(key)) if key else ((), ())
        if not len(at):
            return float((self.rest[0] + SMOOTH * self.base) / (self.rest[1] + SMOOTH)), None, 0.0
        close = SOFT / (SOFT + 1 - cosines)
        # The nearest texts vote, not all texts of the nearest vectors: one of thousands would outvote rare ones.
        texts = np.array([self.texts[self.index.shown[i]] for i in at], float)
        before = np.cumsum(texts) - texts
        close *= np.clip((NEIGHBOURS - before) / texts, 0, 1)
        toxic, whole = (close[:, None] * self.index.votes[at]).sum(axis=0)
        return float((toxic + SMOOTH * self.base) / (whole + SMOOTH)), int(self.index.shown[at[0]]), float(cosines[0])


def learn(docs, labels):
    """Fit on documents and labels (doc_id, toxic). Repeated labels of a document count as the larger one."""
    rows, labelled = examples(docs, labels)
    rows = materialize(rows)
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sampled = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sampled.get(0, 0), sampled.get(1, 0)
    base = sizes.get(1, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    terms = vocabulary(rows, n0, n1) if n0 and n1 else {}
    found = vectors(rows, terms).collect()
    scale = [sizes.get(k, 0) / max(1, sampled.get(k, 0)) for k in (0, 1)]
    return Voter(terms, n0 + n1, [tuple(r) for r in found], scale, base)


def score_documents(docs, voter, id="doc_id", text="text"):
    """(id, score, nearest, cosine) per row of ``docs``.

    The score is the toxic share of the votes. Every text with a word is searched in the index. Null and empty texts
    score the toxic share of the labelled texts without a marking term; with nothing learned it is 0. ``nearest`` is the id of the nearest
    example, null without one. Repeated rows are scored each; other columns play no part; an empty table gives an
    empty table.
    """

    def run(batches):
        for batch in batches:
            found = [voter.score(t) for t in batch.column(1).to_pylist()]
            columns = zip(*found) if found else ([], [], [])
            kinds = (pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["id", "score", "nearest", "cosine"]
            )

    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, "id bigint, score double, nearest bigint, cosine double").withColumnRenamed("id", id)


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(fraction_of_crc(F.col("doc_id"), 5) != 0)
    scored = score_documents(docs, learn(docs, labels))
    held_out = F.coalesce(fraction_of_crc(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "nearest", "cosine"
    )
