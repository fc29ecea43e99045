"""Fill-in-the-middle documents, cut at token counts that come from remembered chunks.

A rolling hash over the last WINDOW bytes cuts a text into chunks wherever its low bits are zero, so passages that texts
share fall into the same chunks wherever they stand. A chunk is summarised once per task: how many words end in it, its
code points, and whether it starts and ends with white space. The summary is remembered under a digest of the chunk and
used again only if the remembered bytes equal the chunk. Neighbouring summaries are combined by their boundaries, prefix
sums give the number of tokens, and only the chunk that holds a cut is looked into.

A token is a word with the white space before it, or the white space that ends the text. The chunks only decide what is
counted again; counts and cuts are those of the whole text.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .catalog import BLANKS, query, table

SEED = 42
#: Per cent of the texts that are transformed, and of those that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes that the rolling hash sees (a power of two), mean bytes between its cuts, least and most bytes of a chunk.
WINDOW = 32
MEAN = 512
LEAST = 128
MOST = 4096
#: Bytes hashed at a time, bytes of chunks that a task remembers, and bytes of output sent at a time.
SLICE = 1 << 20
REMEMBERED = 16 << 20
SENT = 4 << 20

_BLANK = BLANKS.encode()
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes that continue a code point.
_CONTINUING = bytes(range(0x80, 0xC0))
_GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def boundaries(data):
    """Where the rolling hash ends chunks of ``data``, the end of the data included."""
    ends, last = [], 0
    for at in range(0, len(data), SLICE):
        lead = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + SLICE) - lead, lead)]
        step = 1
        while step < WINDOW:  # h[i] becomes the sum of gear << distance over the last 2 * step bytes
            h[step:] += h[:-step] << np.uint64(step)
            step *= 2
        # The high half: low bits would only see the last bytes.
        found = np.flatnonzero((h[at - lead :] >> np.uint64(WINDOW - 1)) % np.uint64(MEAN) == 0) + at + 1
        for end in found.tolist():
            if end - last >= LEAST:
                while end - last > MOST:
                    last += MOST
                    ends.append(last)
                if end - last >= LEAST:
                    last = end
                    ends.append(end)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def summary(chunk):
    """(words that end inside, code points that start inside, starts blank, ends blank) of a chunk by itself."""
    blank_end = chunk[-1] in _BLANK
    return len(chunk.split()) - (not blank_end), len(chunk.translate(None, _CONTINUING)), chunk[0] in _BLANK, blank_end


class Memory:
    """Summaries of chunks, verified by content; forgets everything when it holds too many bytes."""

    def __init__(self, most=REMEMBERED, digest=hash):
        self.known, self.held, self.most, self.digest = {}, 0, most, digest

    def __call__(self, chunk):
        key = self.digest(chunk)
        found = self.known.get(key)
        if found is not None and found[0] == chunk:
            return found[1]
        made = summary(chunk)
        if found is None:  # of two chunks with one digest the first is remembered
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[key] = chunk, made
            self.held += len(chunk)
        return made


class Counted:
    """A text with the prefix sums of its chunks' summaries."""

    def __init__(self, data, memory):
        self.data, self.starts, self.words, self.points = data, [0], [0], [0]
        start, words, points, blank = 0, 0, 0, True
        self.blanks = [True]  # if what is before a chunk ends blank
        for end in boundaries(data):
            inner, more, starts_blank, ends_blank = memory(data[start:end])
            words += inner + (starts_blank and not blank)  # a word that reaches the border ends there
            points, start, blank = points + more, end, ends_blank
            self.starts.append(end)
            self.words.append(words)
            self.points.append(points)
            self.blanks.append(blank)
        self.n_words = words + (not blank)
        self.n = self.n_words + (blank and len(data) > 0)

    def cut(self, units):
        """(bytes, code points) before the end of the first ``units`` tokens."""
        if units == 0:
            return 0, 0
        if units == self.n:
            return len(self.data), self.points[-1]
        i = int(np.searchsorted(self.words, units)) - 1  # the first chunk by whose end so many words have ended
        at, left = self.starts[i], units - self.words[i]
        part = self.data[at : self.starts[i + 1]] if i + 1 < len(self.starts) else b""
        if not self.blanks[i] and part[0] in _BLANK:
            left -= 1
            if left == 0:
                return at, self.points[i]
        for k, word in enumerate(_WORD.finditer(part), 1):
            if k == left:
                return at + word.end(), self.points[i] + len(part[: word.end()].translate(None, _CONTINUING))
        raise AssertionError("the summaries don't fit the text")


def draws(id, seed=SEED):
    """Four unsigned integers drawn for a document; a null id is hashed as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(id, data, memory, seed=SEED, rate=RATE, suffix_first=SUFFIX_FIRST):
    """(n, form, code points of prefix and of middle, output) of one text as bytes."""
    counted, (h1, h2, h3, h4) = Counted(data, memory), draws(id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return counted.n, "plain", None, None, data
    low, high = sorted((h1 % (counted.n + 1), h2 % (counted.n + 1)))
    (a, before), (b, upto) = counted.cut(low), counted.cut(high)
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    spm = h4 % 100 < suffix_first
    return counted.n, "spm" if spm else "psm", before, upto - before, (suffix + prefix if spm else prefix + suffix) + middle


def fill_in_middle(docs, id="doc_id", text="text", seed=SEED, rate=RATE, suffix_first=SUFFIX_FIRST):
    """One row per row of ``docs``: id, n (tokens), form, prefix_chars, middle_chars and output.

    Form is ``plain`` (the text itself; null lengths), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first). Null texts are
    empty; empty texts and those that hold a marker stay plain, so every output can be turned back. Which texts are
    transformed and where they are cut depends on the id and the seed alone: rows of one id and text agree, null ids
    draw alike. An empty table gives an empty table; other columns play no part. There is no shuffle.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        memory = Memory()
        for batch in batches:
            rows, size = [], 0
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.append((i, *transformed(i, data or b"", memory, seed, rate, suffix_first)))
                    size += len(rows[-1][-1])
                    if size > SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    schema = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    return plain.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id)


def restored(output, form):
    """The original text of an output column: no text that was cut holds a marker, so the markers part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    of = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "psm", of(2, 4, 3)).when(form == "spm", of(3, 4, 2)).otherwise(output)


SQL = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, x, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM cut
"""


@query("op12_fill_middle", SQL)
def op12_fill_middle(spark, folder):
    out = fill_in_middle(table(spark, folder, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
