"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of the longest length as fit
and then into the binary digits of the rest, longest first. Every piece is a
sequence by itself, so none crosses documents and none is padded; sequences of
one length form a bucket, from which batches of equal shape are drawn.

Tokenization: white space never joins a token of this vocabulary, so a text is
the concatenation of its white-space delimited chunks, and a chunk that is a lower-case word and marks is that of the two.
A worker keeps a bounded table of chunks it has met and hands only new ones to the tokenizer.

Defined results: a null or empty text is the end-of-text id alone, one piece of
length 1. Rows that repeat an id are packed one by one, each with sequences of
its own; a null id is carried along. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, remembered, trim

MAX_LENGTH = 2048
END_ID = 1
#: Chunks that a worker remembers; its memory, not the result, depends on it.
REMEMBERED = 1_000_000
#: Longer chunks are not remembered.
LONG_CHUNK = 64
#: A control character that is one token.
MARK = b"\x01"
#: ASCII marks that end a word's piece: all but the apostrophe, which may begin a contraction.
MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

#: An ASCII capital before a character that NFC may join to it. Small and capital letters do not compose alike (J and U+030C, H and U+0331).
COMPOSABLE = re.compile(rb"[A-Z][\x80-\xff]")


class ChunkEncoder:
    """Texts to ids (little-endian unsigned 32-bit bytes), chunk by chunk."""

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.known: dict[bytes, bytes] = {}
        # stands between chunks that are encoded together; a chunk that holds it is encoded alone
        self.mark, self.mark_id = MARK, self._ids(MARK.decode()).item()
        self.plain = plain_tokenizer(vocab)

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Make these chunks known; also words and ends of which some are made, which are returned."""
        if self.plain is None:
            self._encode(new, None)
            return []
        pairs, words, rest = [], set(), []
        for c in new:
            word = c.rstrip(MARKS)
            if word.isalpha() and word.islower() if word.isascii() else is_latin_word(word.decode()):
                pairs.append((c, word, c[len(word) :]))
                words.add(word)
            else:
                rest.append(c)
        ends = {e for _, _, e in pairs}
        words = [w for w in words if w not in self.known]
        ends = [e for e in ends if e not in self.known]
        self._encode(words, self.plain)
        self._encode(rest + ends, None)
        self.known.update([(c, self.known[w] + self.known[e]) for c, w, e in pairs])
        return words + ends

    def _encode(self, chunks: list[bytes], tokenizer) -> None:
        odd = [c for c in chunks if self.mark in c]
        for c in odd:
            self.known[c] = self._ids(c.decode()).tobytes()
        plain = [c for c in chunks if self.mark not in c] if odd else chunks
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self._ids((b" " + self.mark + b" ").join(some).decode(), tokenizer)
            cut, raw = np.flatnonzero(ids == self.mark_id) * 4, ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)])]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        made: list[bytes] = []

        def learn(new: list[bytes]) -> None:
            made.extend(new)
            made.extend(self._learn(new))

        out = joined_values(self.known, map(chunks_of, texts), learn)
        for c in made:
            if len(c) > LONG_CHUNK:
                self.known.pop(c, None)
        return out


def joined_values(known: dict[bytes, bytes], rows, learn) -> list[bytes]:
    """Each row's keys' values, joined; learn(keys) adds those that the table lacks.

    One look-up a key: what is not found leaves a hole that is filled afterwards.
    """
    get, found, holes = known.get, [], []
    for row in rows:
        values, gaps, at = list(map(get, row)), [], -1
        for _ in range(values.count(None)):
            at = values.index(None, at + 1)
            gaps.append((at, row[at]))
        found.append(values)
        holes.append(gaps)
    new = {key for gaps in holes for _, key in gaps}
    if new:
        learn(list(new))
    for values, gaps in zip(found, holes):
        for at, key in gaps:
            values[at] = known[key]
    return [b"".join(v) for v in found]


def chunks_of(text: str | None) -> list[bytes]:
    """White-space delimited chunks; in lower case, as the tokenizer will have them, unless a special token may be there.

    A chunk with a capital that may be composed with what follows keeps its case: the tokenizer composes first.
    """
    data = (text or "").encode()
    if b"<|" in data:
        return data.split()
    if COMPOSABLE.search(data) is None:
        return data.lower().split()
    return [c if COMPOSABLE.search(c) else c.lower() for c in data.split()]


def is_latin_word(text: str) -> bool:
    """Only lower-case letters of the Latin blocks, which no normalization changes."""
    return text.isalpha() and max(text) < "\u0250" and text == text.lower()


def plain_tokenizer(vocab: str):
    """The vocabulary's tokenizer for lower-case words, without the normalizer and the pattern that don't touch them.

    None if the vocabulary has other steps than those known here.
    """
    from tokenizers import Tokenizer

    with open(vocab, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = [n["type"] for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if steps != ["NFC", "Replace", "Lowercase"] or before != ["Split", "ByteLevel"]:
        return None
    spec["normalizer"], spec["added_tokens"] = None, []
    spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    return Tokenizer.from_str(json.dumps(spec))


@remembered
def chunk_encoder(vocab: str) -> ChunkEncoder:
    """One for all tasks of a worker process."""
    return ChunkEncoder(vocab)


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    out = [longest] * (n // longest)
    bit, rest = longest // 2, n % longest
    while rest:
        if rest >= bit:
            out.append(bit)
            rest -= bit
        bit //= 2
    return out


def few(batches, most: int = 512):
    """Arrow batches of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def pack(docs: DataFrame, vocab: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length (also its bucket), ids (binary), doc_tokens, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece is a power of two")
    vocab = vocab or public_tokenizers.path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def kernel(batches):
        encoder = chunk_encoder(vocab)
        for b in few(batches):
            cols = [[] for _ in schema]
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids += end
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, longest):
                    for col, x in zip(cols, (key, at, size, ids[4 * at : 4 * (at + size)], n)):
                        col.append(x)
                    at += size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(kernel, "row long, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("row").alias("id"), "start", "length", "ids", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, where: str) -> None:
    """Sequences in a folder for each length (a bucket): what is read of one bucket stacks without padding."""
    packed.write.partitionBy("length").parquet(where)


def read_bucket(spark, where: str, length: int) -> DataFrame:
    """The sequences of one length; other buckets' files aren't opened."""
    return spark.read.parquet(where).filter(F.col("length") == length)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
