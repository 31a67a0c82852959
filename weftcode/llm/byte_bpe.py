"""Byte-level BPE with vectorised pre-tokenisation.

Texts of a batch are joined into one array of code points, an end mark after each.
A table gives each code point's class, and a look at the next code points turns
classes into symbols of a small automaton (letter, number, other, space that
attaches to what follows, single white space, white-space run, contraction).
Each symbol is a function from the state before it to the state after it.
Functions compose associatively, so the states at all positions come from a
scan: functions of fixed blocks are composed column by column, block functions by
pointer doubling, and then states are filled in for all blocks at once.
A piece begins where symbol and state say so; no regular expression is used.

Slices go through a bounded table of merged pieces; a new piece is merged pair by
pair by rank. The byte offset of each token is kept beside the ids; the decoder
places every token's bytes by it, again without a loop over tokens.

Defined results: null counts as empty; an empty text has no ids and decodes to no
bytes. Rows that repeat an id are encoded one by one, a null id is carried
along. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, remembered
from .packing import few, joined_values

#: Pieces that a worker remembers, and the longest of them.
REMEMBERED, LONG_PIECE = 500_000, 48
#: Code points of a joined array: texts are added until it is reached.
JOINED = 1 << 19

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
# symbols: the first three and END are as above
S_SPACE, S_WHITE, S_RUN, S_END, S_SHORT, S_LONG = range(3, 9)
# states: what the position before belongs to
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)
MARK = 0x110000
#: White space other than U+0020, as ranges of code points.
WHITE_RANGES = ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def code_point_classes() -> np.ndarray:
    """Class of each code point and of the end mark."""
    out = np.full(MARK + 1, OTHER, np.uint8)
    for major, cls in (("L", LETTER), ("N", NUMBER)):
        out[[c for c in range(MARK) if unicodedata.category(chr(c))[0] == major]] = cls
    for a, b in WHITE_RANGES:
        out[a : b + 1] = WHITE
    out[0x20] = SPACE
    out[MARK] = END
    return out


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, both indexed by 8 * symbol + state."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (S_SPACE, AFTER_SPACE), (S_WHITE, FREE), (S_RUN, IN_RUN), (S_END, FREE), (S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        step[symbol] = state
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        begins[symbol, [state, AFTER_SPACE]] = False
    begins[S_RUN, IN_RUN] = False
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, FREE
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol in (S_SHORT, S_LONG):  # inside a run of others an apostrophe is one of them
        step[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    return step.ravel(), begins.ravel()


def symbols_of(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    cls = classes[points]
    after = np.append(points[1:], [MARK, MARK]).astype(np.uint32)
    nxt = np.append(cls[1:], END)
    solid = nxt <= OTHER
    out = cls.copy()
    out[cls == SPACE] = S_RUN
    out[cls == WHITE] = S_RUN
    out[(cls == SPACE) & solid] = S_SPACE
    out[(cls == WHITE) & solid] = S_WHITE
    out[cls == END] = S_END
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        one, two = after[at], after[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        out[at[short]] = S_SHORT
        out[at[long]] = S_LONG
    return out


def scan_states(symbols: np.ndarray, step: np.ndarray, block: int = 64) -> np.ndarray:
    """State before each position, by a scan of composed transition functions."""
    n = len(symbols)
    k = -(-n // block)
    padded = np.full(k * block, S_END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(k, block).T * 8).astype(np.intp)
    functions = np.tile(np.arange(8, dtype=np.intp), (k, 1))
    step = step.astype(np.intp)
    for c in columns:
        functions = step[c[:, None] + functions]
    shift = 1
    while shift < k:  # functions[i] becomes that of blocks 0..i
        functions[shift:] = np.take_along_axis(functions[shift:], functions[:-shift], 1)
        shift *= 2
    state = np.concatenate(([FREE], functions[:-1, FREE]))
    before = np.empty((block, k), np.uint8)
    for t, c in enumerate(columns):
        before[t] = state
        state = step[c + state]
    return before.T.ravel()[:n]


class Splitter:
    """Texts to slices of their UTF-8 bytes."""

    def __init__(self):
        self.classes = code_point_classes()
        self.step, self.begins = automaton()

    def split(self, texts: list[str]) -> list[list[bytes]]:
        mark = np.array([MARK], np.uint32)
        parts, data = [], []
        for t in texts:
            parts += [np.frombuffer(t.encode("utf-32-le"), np.uint32), mark]
            data.append(t.encode())
        if not parts:
            return []
        points, joined = np.concatenate(parts), b"".join(data)
        symbols = symbols_of(points, self.classes)
        starts = np.flatnonzero(self.begins[symbols.astype(np.intp) * 8 + scan_states(symbols, self.step)])
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        width[points == MARK] = 0
        offset = np.concatenate(([0], np.cumsum(width)))[starts]
        ends = np.flatnonzero(points[starts] == MARK)
        cut = [*offset.tolist(), len(joined)]
        slices = [joined[a:b] for a, b in zip(cut, cut[1:])]
        out, last = [], 0
        for e in ends.tolist():
            out.append(slices[last:e])
            last = e + 1
        return out


def read_ranks(vocab: str) -> dict[bytes, int]:
    with open(vocab, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all adjacent pairs, the one of lowest rank merges first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 128:
        return merge_long(piece, ranks)
    parts, get = [piece[i : i + 1] for i in range(len(piece))], ranks.get
    worst = len(ranks)
    pair = [get(a + b, worst) for a, b in zip(parts, parts[1:])]
    while pair and (low := min(pair)) < worst:
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], worst)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], worst)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces of many bytes."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, vocab: str):
        self.ranks = read_ranks(vocab)
        tokens = sorted(self.ranks, key=self.ranks.get)
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.length[[self.ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.cumsum(self.length) - self.length
        self.splitter: Splitter | None = None
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        self.splitter = self.splitter or Splitter()
        out, some, size = [], [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= JOINED:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = self.splitter.split(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, long = self.known, []

        def learn(new: list[bytes]) -> None:
            for p in new:
                known[p] = b"".join([i.to_bytes(4, "little") for i in merge(p, self.ranks)]) if p else b""
                if len(p) > LONG_PIECE:
                    long.append(p)

        out = joined_values(known, split, learn)
        for p in long:
            del known[p]
        return out

    def offsets(self, ids: bytes) -> bytes:
        """Byte offset at which each token begins, as unsigned 64-bit integers."""
        size = self.length[np.frombuffer(ids, np.uint32)]
        return (np.cumsum(size) - size).astype("<u8").tobytes()

    def decode(self, ids: bytes, offsets: bytes | None = None) -> bytes:
        n = np.frombuffer(ids, np.uint32)
        if not len(n):
            return b""
        size = self.length[n]
        at = np.frombuffer(self.offsets(ids) if offsets is None else offsets, "<u8").astype(np.int64)
        return self.blob[np.repeat(self.first[n] - at, size) + np.arange(at[-1] + size[-1])].tobytes()


@remembered
def codec_of(vocab: str) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(vocab)


def encode(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit), offsets (binary, unsigned 64-bit).

    With round_trip also decoded (binary): what the decoder makes of the ids in the same worker.
    """
    vocab = vocab or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "id long, ids binary, offsets binary" + ", decoded binary" * round_trip

    def kernel(batches):
        codec = codec_of(vocab)
        for b in few(batches, 128):
            ids = codec.encode(b.column(1).to_pylist())
            offsets = list(map(codec.offsets, ids))
            columns = [b.column(0), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())]
            if round_trip:
                columns.append(pa.array(map(codec.decode, ids, offsets), pa.binary()))
            yield pa.record_batch(columns, names=["id", "ids", "offsets", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, schema)


def decode(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """id, ids, decoded (binary), from what encode() returns."""
    vocab = vocab or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def kernel(batches):
        codec = codec_of(vocab)
        for b in few(batches):
            out = [codec.decode(i, o) for i, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids", "offsets").mapInArrow(kernel, "id long, ids binary, decoded binary")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode(load(spark, sf_dir, "documents"), round_trip=True)
    return out.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
