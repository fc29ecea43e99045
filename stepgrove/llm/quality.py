"""Quality rules: base measures, and the divergence of a document's histograms from language references.

A document's character classes and the common words of each language are compared with the references of the
languages, summed over all documents, by the Jensen-Shannon distance. A document stays when some language is near in
both. Short texts have noisy histograms, so guards of length decide which of the two comparisons count.

Everything is array functions inside a row; only the sums per language are shuffled. Repeated windows are found from
hashes: most documents have none and stop there, the others are sorted within the row.
"""

import math

from pyspark.sql import functions as F

from stepgrove.session import materialize

from .catalog import query, table, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "[#*$%&|<>]"

#: Largest distances to a language reference, and the words a text needs for either comparison to count. The distance
#: of common words is a share of the distance that a text without any common word has.
MOST_CLASSES = 0.30
MOST_COMMON = 0.90
CLASSES_GUARD = 20
COMMON_GUARD = 100
#: Languages whose references are literals of the plan; more are an array beside the rows, so any number works.
MAX_LANGUAGES = 64

#: Character classes as patterns of all else (white space is one more), and the most common words of four
#: languages.
CLASSES = [r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^\p{N}]+", r"[^\p{P}]+"]
COMMON = {
    "de": "der die und das von ist ein eine nicht sich mit zu den des auf für im dem es an".split(),
    "en": "the of and to in is that for it with as was on by at this are from be or".split(),
    "es": "el la de que y en los las un una por con para del se no su al lo como".split(),
    "fr": "le la les des et en un une du que qui dans pour par sur au elle il pas ce".split(),
}


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(found, window=WINDOW):
    """The number of words in windows of so many words that occur twice or more, from an array of words.

    ``window`` is a power of two. Windows are told apart by 64-bit hashes, made from those of their halves.
    """
    n = F.size(found) - (window - 1)

    def widen(h, width):
        """Hashes of runs of twice the width, from hashes of runs of ``width`` words."""
        return _let(h, lambda x: F.zip_with(x, F.slice(x, width + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))

    hashes, width = F.transform(found, lambda w: F.xxhash64(w)), 1
    while width < window:
        hashes, width = widen(hashes, width), 2 * width
    hashes = F.slice(hashes, 1, n)

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s):
            same = lambda x, k: x["h"] == F.get(s, k)["h"]
            hit = F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def union(at):
            span = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(span, F.lit(0), lambda a, x: a + x)

        return _let(_let(placed, twice), union)

    return F.when(n >= 2, _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def measures(docs, id="doc_id", text="text", lang="lang"):
    """One row per row of ``docs``: id, lang, the base measures, and the counts classes and common."""
    vocabulary = sorted({w for some in COMMON.values() for w in some})
    rows = docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    length = F.length("text")
    word_chars = F.length(F.array_join("words", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [*(F.length(F.regexp_replace("text", p, "")) for p in CLASSES), length - word_chars]
    written = [*vocabulary, *(w.capitalize() for w in vocabulary), *(w.upper() for w in vocabulary)]
    found = F.transform(F.filter("words", lambda w: w.isin(written)), F.lower)
    common = _let(found, lambda m: F.transform(F.array(*map(F.lit, vocabulary)), lambda w: F.size(m) - F.size(F.array_remove(m, w))))
    return rows.select(
        "id", "lang",
        F.size("words").cast("bigint").alias("n_words"),
        word_chars.cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        length.cast("bigint").alias("n_points"),
        F.array(*classes).alias("classes"),
        common.alias("common"),
    )


def common_words(lang):
    """The common words a language is known by: its list, or the words of all lists that its documents may share."""
    return COMMON.get(lang, sorted({w for some in COMMON.values() for w in some}))


def references(rows):
    """{language: (shares of the classes and the rest, shares of its common words and the rest)} over all of ``rows``."""
    vocabulary = sorted({w for some in COMMON.values() for w in some})
    sums = [F.sum("n_words").alias("n_words"), F.sum("n_points").alias("n_points")]
    sums += [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(vocabulary))]
    found = rows.filter("lang IS NOT NULL AND n_words > 0").groupBy("lang").agg(*sums).orderBy("lang").collect()
    out = {}
    for r in found:
        classes = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        own = [r[f"w{vocabulary.index(w)}"] for w in common_words(r["lang"])]
        out[r["lang"]] = (
            [c / r["n_points"] for c in [*classes, r["n_points"] - sum(classes)]],
            [c / r["n_words"] for c in [*own, r["n_words"] - sum(own)]] if sum(own) else None,
        )
    return out


def divergence(counts, total, shares):
    """The Jensen-Shannon distance (base 2) between counts, with what they lack of ``total``, and reference shares."""
    mine = F.concat(counts, F.array((total - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint")))

    def term(c, q):
        p = c / total
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(p) + part(q)) / 2

    theirs = F.array(*[F.lit(float(s)) for s in shares]) if isinstance(shares, list) else shares
    parts = F.zip_with(mine, theirs, term)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def without_any(shares):
    """The distance to reference shares of a text that has only the last, the rest."""
    rest = shares[-1]
    middle = (1 + rest) / 2
    own = math.log2(1 / middle)
    theirs = sum(s * math.log2(2) for s in shares[:-1] if s > 0) + (rest * math.log2(rest / middle) if rest > 0 else 0.0)
    return math.sqrt((own + theirs) / 2)


def judge(rows, known):
    """``rows`` with base_failed, nearest (language), class_distance, common_distance and kept."""
    vocabulary = sorted({w for some in COMMON.values() for w in some})
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    if len(known) > MAX_LANGUAGES:
        return _verdicts(rows.crossJoin(F.broadcast(_reference_row(rows.sparkSession, known, vocabulary))), base, _nearest(known))
    compared = []
    wide = F.transform("classes", lambda x: x.cast("bigint"))
    for lang, (classes, common) in known.items():
        own = F.array(*[F.get("common", F.lit(vocabulary.index(w))).cast("bigint") for w in common_words(lang)])
        far = divergence(own, F.col("n_words"), common) / F.lit(without_any(common)) if common else F.lit(0.0)
        near = divergence(wide, F.col("n_points"), classes)
        found = F.struct((near / MOST_CLASSES + far / MOST_COMMON).alias("rank"), F.lit(lang).alias("lang"), near.alias("classes"), far.alias("common"))
        compared.append(found if common else F.when(F.coalesce(F.col("lang") == lang, F.lit(True)), found))
    best = F.array_min(F.array(*compared)) if compared else F.lit(None).cast("struct<rank:double,lang:string,classes:double,common:double>")
    return _verdicts(rows, base, best)


def _reference_row(spark, known, vocabulary):
    """One row with all references: a few hundred numbers for each language."""
    shape = "refs array<struct<lang:string,classes:array<double>,places:array<int>,common:array<double>,none:double>>"
    refs = [
        (lang, [float(x) for x in classes], [vocabulary.index(w) for w in common_words(lang)] if common else [],
         [float(x) for x in common] if common else None, float(without_any(common)) if common else None)
        for lang, (classes, common) in known.items()
    ]
    return spark.createDataFrame([(refs,)], shape)


def _nearest(known):
    """The nearest of the references in the column ``refs``."""
    wide = F.transform("classes", lambda x: x.cast("bigint"))

    def compare(r):
        own = F.transform(r["places"], lambda p: F.get("common", p).cast("bigint"))
        far = F.when(r["common"].isNotNull(), divergence(own, F.col("n_words"), r["common"]) / r["none"]).otherwise(F.lit(0.0))
        near = divergence(wide, F.col("n_points"), r["classes"])
        return F.struct((near / MOST_CLASSES + far / MOST_COMMON).alias("rank"), r["lang"].alias("lang"), near.alias("classes"), far.alias("common"))

    open_ = lambda r: r["common"].isNotNull() | F.coalesce(F.col("lang") == r["lang"], F.lit(True))
    return F.array_min(F.transform(F.filter("refs", open_), compare))


def _verdicts(rows, base, best):
    best = F.when(F.col("n_words") >= min(CLASSES_GUARD, COMMON_GUARD), best)
    judged = rows.withColumns({"base_failed": base, "best": best})
    far = ((F.col("n_words") >= CLASSES_GUARD) & (F.col("best.classes") > MOST_CLASSES)) | (
        (F.col("n_words") >= COMMON_GUARD) & (F.col("best.common") > MOST_COMMON)
    )
    return judged.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.col("best.lang").alias("nearest"), F.col("best.classes").alias("class_distance"), F.col("best.common").alias("common_distance"),
    )


def quality(docs, id="doc_id", text="text", lang="lang"):
    """One row per row of ``docs``: id, the base measures, base_failed, kept, and the nearest language with distances.

    Null and empty texts have no words and fail the base rules. ``lang`` groups the references: null languages add
    to none. A language without a list of common words is known by how its documents use the words of all lists. If they
    hold none of those either, only character classes remain, which most languages share: then the reference is compared
    with documents of that language or of none, not with others. With no reference at all the base rules decide. Ties go to the language that sorts first; other columns play no part.
    """
    rows = materialize(measures(docs, id, text, lang))
    return judge(rows, references(rows)).withColumnRenamed("id", id)


def _sql():
    vocabulary = sorted({w for some in COMMON.values() for w in some})
    forms = sorted({f for w in vocabulary for f in (w, w.capitalize(), w.upper())})
    places = " ".join(f"WHEN '{k}' THEN {[vocabulary.index(w) + 1 for w in v]}" for k, v in COMMON.items())
    classes = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in CLASSES)
    term = "(CASE WHEN p[i] > 0 THEN p[i] * log2(p[i] / ((p[i] + q[i]) / 2)) ELSE 0 END + CASE WHEN q[i] > 0 THEN q[i] * log2(q[i] / ((p[i] + q[i]) / 2)) ELSE 0 END) / 2"
    distance = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {term.replace('p[i]', p + '[i]').replace('q[i]', q + '[i]')}))))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, ws[i:i + {WINDOW - 1}] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, length(t) AS n_points, [{classes}, length(t) - length(array_to_string(ws, ''))] AS classes,
  list_transform({vocabulary}, lambda v: len(list_filter(ws, lambda x: list_contains({forms}, x) AND lower(x) = v))) AS common
  FROM w LEFT JOIN covered USING (r)),
sums AS (SELECT lang, sum(n_words)::DOUBLE AS nw, sum(n_points)::DOUBLE AS np, [{", ".join(f"sum(classes[{i + 1}])::DOUBLE" for i in range(len(CLASSES) + 1))}] AS cs,
  [{", ".join(f"sum(common[{i + 1}])::DOUBLE" for i in range(len(vocabulary)))}] AS ws, CASE lang {places} ELSE range(1, {len(vocabulary) + 1}) END AS spots
  FROM m WHERE lang IS NOT NULL AND n_words > 0 GROUP BY lang),
refs AS (SELECT lang, spots, list_transform(list_append(cs, np - list_sum(cs)), lambda x: x / np) AS qc,
  list_transform(list_append(list_transform(spots, lambda j: ws[j]), nw - coalesce(list_sum(list_transform(spots, lambda j: ws[j])), 0)), lambda x: x / nw) AS qw FROM sums),
pairs AS (SELECT r, refs.lang, qc, qw, list_transform(range(1, len(qw) + 1), lambda i: CASE WHEN i = len(qw) THEN 1.0 ELSE 0.0 END) AS none,
  list_transform(list_append(classes, n_points - list_sum(classes)), lambda x: x / n_points) AS pc,
  list_transform(list_append(list_transform(spots, lambda j: common[j]), n_words - coalesce(list_sum(list_transform(spots, lambda j: common[j])), 0)), lambda x: x / n_words) AS pw
  FROM m, refs WHERE n_words >= {min(CLASSES_GUARD, COMMON_GUARD)} AND (qw[len(qw)] < 1 OR m.lang IS NULL OR m.lang = refs.lang)),
far AS (SELECT r, lang, {distance("pc", "qc")} AS dc, CASE WHEN qw[len(qw)] = 1 THEN 0.0 ELSE {distance("pw", "qw")} / {distance("none", "qw")} END AS dw FROM pairs),
best AS (SELECT r, dc, dw FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY dc / {MOST_CLASSES}::DOUBLE + dw / {MOST_COMMON}::DOUBLE, lang) = 1),
verdict AS (SELECT m.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  coalesce((n_words >= {CLASSES_GUARD} AND dc > {MOST_CLASSES}) OR (n_words >= {COMMON_GUARD} AND dw > {MOST_COMMON}), false) AS apart FROM m LEFT JOIN best USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT apart AS kept FROM verdict
"""


@query("op6_quality_rules", _sql())
def op6_quality_rules(spark, folder):
    found = quality(table(spark, folder, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base)
