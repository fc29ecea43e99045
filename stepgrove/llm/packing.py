"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are the powers of two of its token count (pieces of the longest
length as often as they fit, then the binary digits of the rest). Every piece is a sequence of its own, kept in the
bucket of its length, so no sequence crosses documents and none needs padding: a batch takes sequences of one bucket.
No row has to meet another one, so there is no shuffle and no hot key.
"""

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .catalog import freeing, query, table

#: Longest sequence; a power of two.
LONGEST = 2048
#: The id that ends every document.
END = 1
#: Words whose ids a task remembers (twice as many for a while), and bytes of ids it passes on at a time.
WORDS_KEPT = 400_000
OUT_BYTES = 8 << 20

SEQUENCES_PER_TASK = 1 << 38


def _packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters():
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip([*seen, *(b for b in range(256) if b not in seen)], map(chr, [*seen, *range(256, 512)])))


_BYTE_LETTERS = _byte_letters()
#: A word of letters between marks; an apostrophe, digits and special tokens make words that are encoded as they are.
_SIMPLE = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_ENDS = frozenset(b".,;:!?")
_PROBE = "It's 12.5% Ünder-way, (naïve) <|endoftext|> EL NIÑO:\n\t\u4e2d\u6587 e\u0301x! don't..."


class WordTokens(dict):
    """The ids of words (bytes to little-endian unsigned 32-bit bytes), learned on first use.

    This holds for tokenizers that part texts at white space, which gets no ids, and letters from marks. A word of
    Latin letters between marks is put together from its parts, whose ids are remembered too; all others are encoded
    whole. A tokenizer that encodes a probe otherwise gets whole texts.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), True
        self.parts, self.older, self.older_parts = {}, {}, {}
        words = b"".join(map(self.__getitem__, _PROBE.encode().split()))
        self.by_words = words == self._whole(_PROBE)

    def _whole(self, text):
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, text):
        """The ids of a lower-case run of letters, or of a run of marks."""
        found = self.parts.get(text)
        if found is None:
            found = self.older_parts.get(text)
            if found is None:
                if text[0].isalpha():
                    seen = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
                    found = _packed([t.id for t in self.tokenizer.model.tokenize(seen)])
                else:
                    found = self._whole(text)
            self.parts[text] = found
        return found

    def _split(self, word):
        """The ids of a word by its parts; None if it isn't letters between marks."""
        if word.isalpha():  # ASCII letters only, as bytes
            return self._part(word.decode().lower())
        head = word[:-1]
        if head.isalpha() and word[-1] in _ENDS:
            return self._part(head.decode().lower()) + self._part(chr(word[-1]))
        simple = _SIMPLE.fullmatch(word)
        if not simple or b"<|" in word:
            return None
        before, core, after = simple.groups()
        core = core.decode("utf-8", "replace").lower()
        if not core.isascii() and (not core.isalpha() or max(core) >= "\u0250" or "\u0307" in core):
            return None
        ids = self._part(core)
        ids = self._part(before.decode()) + ids if before else ids
        return ids + self._part(after.decode()) if after else ids

    def __missing__(self, word):
        ids, known = self.older.get(word), len(self.parts)
        if ids is None:
            ids = self._split(word)
            if ids is None:
                ids = self._whole(word.decode("utf-8", "replace"))
        if known == len(self.parts) and len(word) <= 100:  # new letters are remembered as a part, the word when it comes again
            self[word] = ids
        return ids

    def encode(self, text):
        """The ids of a text given as UTF-8 bytes."""
        if not self.by_words:
            return self._whole(text.decode("utf-8", "replace"))
        if len(self) > WORDS_KEPT or len(self.parts) > WORDS_KEPT:  # what isn't used again is forgotten at the next turn
            self.older, self.older_parts, self.parts = dict(self), self.parts, {}
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def decompose(n, longest=LONGEST):
    """Lengths of the pieces of ``n`` tokens: powers of two, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs, tokenizer, id="doc_id", text="text", longest=LONGEST, end=END):
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, bucket and ids.

    ``tokenizer`` is the path of a tokenizers file that every executor has. ``ids`` holds the token ids as
    little-endian unsigned 32-bit bytes, ``bucket`` the base-2 logarithm of the length. A piece is a sequence, so its
    offset is 0. Null texts are empty; a text without tokens has one piece, the end id. Rows that repeat are packed
    each for itself, null ids too; other columns play no part, and an empty table gives an empty table. Sequence ids
    are unique, and a task that runs again over the same rows gives them again.
    """

    def run(batches):
        encoder, number = WordTokens(tokenizer), TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            keys, rows, size = batch.column(0), [], 0
            for at in range(0, batch.num_rows, 64):
                for i, data in enumerate(batch.column(1).slice(at, 64).to_pylist(), at):
                    ids = encoder.encode(data or b"") + last
                    start, total = 0, len(ids) // 4
                    for length in decompose(total, longest):
                        rows.append((i, start, length, total, number, 0, length.bit_length() - 1, ids[4 * start : 4 * (start + length)]))
                        start, number = start + length, number + 1
                    size += len(ids)
                    if size > OUT_BYTES:
                        yield _batch(keys, rows)
                        rows, size = [], 0
            if rows:
                yield _batch(keys, rows)

    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    schema = "id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, ids binary"
    return plain.mapInArrow(freeing(run), schema).withColumnRenamed("id", id)


def _batch(keys, rows):
    at, *columns = zip(*rows)
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
        names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids"],
    )


def write_buckets(pieces, path):
    """Write the sequences to one folder per length. Without a shuffle: each task adds to every folder it needs."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces):
    """``pieces`` with the crc32 of the ids in their place."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_packing")
def op4_packing(spark, folder, tokenizer=None):
    import public_tokenizers

    pieces = digests(pack(table(spark, folder, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
