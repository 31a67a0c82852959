"""Substring deduplication by recompression.

First a sieve: of each window (35 words), the least of the 64-bit hashes of its 8-word stretches is counted over the
corpus. Equal windows have the same at different places, so a window whose least hash is at one place only can't be repeated: it is dead, and
words that no live window covers go. (Here alone hashes are compared; that two agree by chance keeps a window, and loses none.)

Texts become sequences of globally named symbols, and Spark rounds rename them. The first round names words (one of up to
seven bytes is its own name: the bytes and their number). Each later round groups every maximal run of one symbol, calls each run left or right by a bit of its symbol
and length, and names every run longer than one and every pair of a left run and a right one after
it. Names are given by a table over the whole corpus, from the exact key (symbol, length, symbol, length): two
symbols have one name if and only if the same words stand below them. No hash stands for a name.

What a round does depends on neighbours only, so two occurrences of a passage get the same symbols but
for a few at each end. The symbols that a window determines by itself are found level by
level: a round loses the run at each end, and then a right run at the left end or a left run at the right end,
which might pair with something outside. A window that determines a symbol which occurs once in the corpus
can't be repeated: it is dead too. Rounds go on until no live window determines a symbol, at most window / 2 times.

A window's anchor is the longest symbol (then that of greatest name, then the leftmost) of those it determines
at its highest level. Equal windows have equal anchors, and consecutive windows mostly share one.

1. Each stretch of windows with one anchor is one row: anchor, digest of the word names that the stretch
   spans, place. Rows meet by anchor: sorted, or, for anchors that Misra-Gries counters
   find frequent, in an aggregation and a join that split.
2. Stretches equal to another one are repeated as a whole. Where an anchor has several different
   stretches (ends of passages, edited copies), or a stretch may repeat within itself (runs), one of each
   publishes its windows, and single ones learn which of their windows exist elsewhere.
   What verifies a repeat is the 128-bit BLAKE2b digest of all words of the stretch, or of the window, under the same anchor.
3. Words that a repeated window covers leave the text.

Sequences live in slices of about ``SLICE`` words (a text is never cut, so one longer text is a slice by
itself). A slice sends each distinct key once a round, with its count. Rows of equal keys meet, sorted, in one
partition, which counts them, names those that occur twice or more, and answers to each slice. So the hottest key has
one row a slice, a small part of all rows whatever the corpus, and no table of names is held in one place.

A row is named by a 128-bit digest of its id and text; rows that share both are different places and have the same result.

Defined results: null counts as empty; texts of fewer words than a window lose
nothing. Rows that repeat an id are different places; each is one where the other's windows also start.
A null id is carried along. An empty table gives an empty result. Other columns stay, but for three names that are replaced.
"""

from __future__ import annotations

import io
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, Workspace, frugal, load, mix, trim
from .packing import few

WINDOW = 35
#: Share of the stretches from which an anchor's name is frequent.
SUPPORT = 0.005
#: Words of a slice, but for a longer text.
SLICE = 1 << 18
#: Words leave a slice when more than one in so many windows is dead.
FEW = 8
#: Words of a stretch that the sieve hashes, for windows of WINDOW words.
STRETCH_WORDS = 8
#: Names that are given start here, those of each level further up; below, a partition's number and a count of its names.
NAMES, LEVEL = 1 << 62, 1 << 52
#: Bytes of the words that are their own names, which are below NAMES.
OWN_NAME = 7
BYTE_VALUES = np.random.default_rng(35).integers(1, 1 << 63, 256, dtype=U)
IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])

#: A row's number is its slice's and its place there, of fewer than so many.
ROWS = 1 << 20
SLICES = "slice long, ids binary, state binary, keys array<struct<a: long, c: long>>"
SIEVED = "slice long, state binary, keys array<struct<word: binary, c: long>>"
STRETCH = "name: long, h1: long, h2: long, row: long, s: long, n: long, moves: boolean"
STATE = f"slice long, state binary, words binary, live long, keys array<struct<a: long, b: long, l: long, c: long>>, stretches array<struct<{STRETCH}>>"


def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x)
    data = out.getvalue()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(blob: bytes):
    data = io.BytesIO(pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
    while data.tell() < len(data.getbuffer()):
        yield np.load(data)


def steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as differences, which compress well; ``places`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int32)


def after(mask: np.ndarray) -> np.ndarray:
    """For each place, how many kept ones precede it."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def any_in(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    count = after(mask)
    return count[hi] > count[lo]


def in_any(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the n places that are in one of these ranges."""
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0


def renumbered(table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the rows of the table that the index uses, and the index into these."""
    used = np.zeros(len(table), bool)
    used[index] = True
    return table[used], after(used)[index]


def distinct_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of equally long columns, which of them each row is, and their counts."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, (x[order][1:] != x[order][:-1] for x in columns))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return [x[order][new] for x in columns], which, np.bincount(which, minlength=int(new.sum()))


class Sequences:
    """A slice: its live words, the symbols that live windows determine, and these windows.

    ``words`` index ``names`` (global names of words). Segment k of them begins at ``seg[k]``, which is
    word ``seg_at[k]`` of row ``rows[seg_row[k]]``. A symbol covers ``size`` words from ``start``; a
    window begins at word ``p`` and determines the symbols ``lo`` to ``hi`` - 1. Words and symbols
    not named yet are -1 - k for the k-th key that the slice sent.
    """

    FIELDS = ("rows", "names", "words", "seg", "seg_row", "seg_at", "sym", "start", "size", "p", "lo", "hi")
    SORTED = ("seg", "start", "p", "lo", "hi")

    def __init__(self, window: int, **fields):
        self.window = window
        self.__dict__.update(fields)

    @classmethod
    def of_texts(cls, window: int, rows: np.ndarray, counts: np.ndarray, words: np.ndarray) -> Sequences:
        """Of whole texts, with all windows; words are named by their local numbers."""
        n, end, p = len(words), places(counts), windows_in(window, counts)
        return cls(
            window, rows=rows, names=np.arange(words.max() + 1), words=words, seg=end - counts, seg_row=np.arange(len(rows)), seg_at=np.zeros(len(rows), np.int32),
            sym=words.astype(np.int64), start=np.arange(n, dtype=np.int32), size=np.ones(n, np.int32), p=p, lo=p, hi=p + np.int32(window),
        )

    @classmethod
    def loaded(cls, window: int, blob: bytes, ids: np.ndarray) -> Sequences:
        fields = {k: places(x) if k in cls.SORTED else x for k, x in zip(cls.FIELDS, unpacked(blob))}
        for k in ("names", "sym"):
            pending = fields[k] < 0
            fields[k][pending] = ids[-1 - fields[k][pending]]
        return cls(window, **fields)

    def saved(self) -> bytes:
        fields = ((k, getattr(self, k)) for k in self.FIELDS)
        return packed(*(steps(x) if k in self.SORTED else x for k, x in fields))

    def pick(self, live: np.ndarray, *others: np.ndarray, cut: bool = False) -> list[np.ndarray]:
        """Only these windows, the words they cover, the symbols they determine, and what others say of these."""
        p, lo, hi = self.p[live], self.lo[live], self.hi[live]
        if cut or FEW * (len(live) - len(p)) > len(live):  # else words that go are too few to move the others
            p = self.cut(p)
        mine = in_any(len(self.sym), lo, hi)
        self.sym, self.size, self.start = self.sym[mine], self.size[mine], self.start[mine]
        new = after(mine)
        self.p, self.lo, self.hi = p, new[lo], new[hi]
        return [x[mine] for x in others]

    def cut(self, p: np.ndarray) -> np.ndarray:
        """Only the words that these windows cover; returns where the windows begin then. Symbols of other words have no place any more."""
        keep = in_any(len(self.words), p, p + self.window)
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        begins[self.seg] |= keep[self.seg]
        at, place = np.flatnonzero(begins), after(keep)
        of = np.searchsorted(self.seg, at, "right") - 1
        self.rows, seg_row = renumbered(self.rows, self.seg_row[of])
        self.seg_row, self.seg_at, self.seg = seg_row, (self.seg_at[of] + at - self.seg[of]).astype(np.int32), place[at]
        self.names, self.words = renumbered(self.names, self.words[keep])
        self.start = place[self.start]
        return place[p]

    def round(self, level: int) -> tuple[list, list]:
        """One round: stretches of windows whose highest level this is, and the keys that the others wait for."""
        self.pick(~any_in(self.sym == 0, self.lo, self.hi))
        n = len(self.sym)
        if not n:
            return [], []
        begins = np.zeros(len(self.words), bool)
        begins[self.seg] = True
        follows = np.zeros(n, bool)
        follows[1:] = (self.start[:-1] + self.size[:-1] == self.start[1:]) & ~begins[self.start[1:]]
        new = ~follows
        new[1:] |= self.sym[1:] != self.sym[:-1]
        at = np.flatnonzero(new)
        run_of, length, run = after(new)[1:] - 1, np.diff(np.append(at, n)), self.sym[at]
        right = (mix(mix(run.astype(U) + U(level)) + length.astype(U)) >> U(63)).astype(bool)
        paired = np.zeros(len(run), bool)
        paired[:-1] = ~right[:-1] & right[1:] & follows[at[1:]]
        head = np.ones(len(run), bool)
        head[1:] = ~paired[:-1]
        of = after(head)[1:] - 1
        first, last = run_of[self.lo] + 1, run_of[self.hi - 1] - 1  # runs at the ends may go on outside
        top = len(run) - 1
        first = first + (right[np.minimum(first, top)] & (first <= last))
        last = last - (~right[np.maximum(last, 0)] & (first <= last))
        some = first <= last
        stretches = self.stretches(np.flatnonzero(~some), begins)
        size = self.size[at] * length
        second = np.append(np.flatnonzero(paired) + 1, 0)[:-1]
        other, other_length, both = np.zeros((3, len(run)), np.int64)
        other[paired], other_length[paired], both[paired] = run[second], length[second], size[second]
        self.sym, self.start, self.size = run[head], self.start[at][head], (size + both)[head].astype(np.int32)
        self.lo = np.where(some, of[np.minimum(first, top)], np.int32(0))
        self.hi = np.where(some, of[np.maximum(last, 0)] + np.int32(1), np.int32(0))
        named = (paired | (length > 1))[head]
        named, a, b, l = self.pick(some, named, run[head], other[head], (length << 32 | other_length)[head])
        keys, which, count = distinct_rows([a[named], b[named], l[named]])
        self.sym[named] = -1 - which
        return stretches, [*keys, count]

    def stretches(self, done: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Columns of the stretches of these windows (see the module's text)."""
        if not len(done):
            return []
        p = self.p[done]
        distinct, which = np.unique(self.sym, return_inverse=True)
        sizes = np.zeros(len(distinct), np.int64)
        sizes[which] = self.size
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, sizes))] = np.arange(len(distinct))
        best = range_best(rank[which], self.lo[done], self.hi[done])
        name, place = self.sym[best], self.start[best]
        new = np.ones(len(p), bool)
        new[1:] = (name[1:] != name[:-1]) | (p[1:] != p[:-1] + 1) | begins[p[1:]]
        at = np.flatnonzero(new)
        moved = np.zeros(len(p), bool)
        moved[1:] = (place[1:] != place[:-1]) & ~new[1:]
        n, p = np.diff(np.append(at, len(p))), p[at]
        of = np.searchsorted(self.seg, p, "right") - 1
        data = memoryview(self.names[self.words].tobytes())
        digests = digests_of(data, 8 * p.astype(np.int64), 8 * (p + n + self.window - 1).astype(np.int64))
        return [name[at], *digests, self.rows[self.seg_row[of]], self.seg_at[of] + p - self.seg[of], n, np.logical_or.reduceat(moved, at)]


def digests_of(data, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of these stretches of bytes, as two rows of longs."""
    out = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2).T


def range_best(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the greatest rank in each range, the leftmost of equals."""
    size = hi - lo
    power = np.log2(size).astype(np.int64)
    out = np.empty(len(lo), np.int64)
    table = np.arange(len(rank))
    for p in range(int(power.max()) + 1):
        mine = np.flatnonzero(power == p)
        if len(mine):
            a, b = table[lo[mine]], table[hi[mine] - (1 << p)]
            out[mine] = np.where(rank[a] >= rank[b], a, b)
        step = 1 << p
        if len(table) <= step:
            break
        a, b = table[:-step], table[step:]
        table = np.where(rank[a] >= rank[b], a, b)
    return out


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and how many each has."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    x = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    space = IS_SPACE[x]
    begins, edges = ~space, ends[:-1][ends[:-1] < ends[1:]]
    inside = begins[edges]
    begins[1:] &= space[:-1]
    begins[edges] = inside
    starts = np.flatnonzero(begins)
    letters = after(~space)
    bounds = np.append(letters[starts], letters[-1]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(x[~space])])
    return found, np.diff(np.searchsorted(starts, ends)).astype(np.int32)


def sliding(least, x: np.ndarray, n: int) -> np.ndarray:
    """least (np.minimum or np.maximum) of every n values in a row."""
    size = 1
    while 2 * size <= n:
        x, size = least(x[:-size], x[size:]), 2 * size
    return least(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    x = BYTE_VALUES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    starts = ends[:-1] - ends[0]
    place = np.arange(len(x)) - np.repeat(starts, np.diff(ends))
    return mix(np.add.reduceat(mix(x + place.astype(U)), starts))


def own_names(words: pa.Array) -> np.ndarray:
    """The names of words of up to OWN_NAME bytes, and 0 for longer ones."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    x, n = np.frombuffer(data, np.uint8), np.diff(ends)
    out = n << 56
    for k in range(OWN_NAME):
        here = n > k
        out[here] |= x[ends[:-1][here] + k].astype(np.int64) << 8 * k
    return np.where(n <= OWN_NAME, out, 0)


def windows_in(window: int, counts: np.ndarray) -> np.ndarray:
    """Where windows begin that end in the same text."""
    end = np.repeat(places(counts), counts)
    p = np.arange(len(end), dtype=np.int32)
    return p[p + window <= end]


def least_hashes(window: int, hashes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside texts, the least hash of each one's stretches, and the hashes at all places that are some window's least."""
    k = min(window, STRETCH_WORDS)
    x, n = hashes[words], len(words)
    size, g = 1, x
    while 2 * size <= k:
        g = g[:-size] * U(0x9E3779B97F4A7C15 + 2 * size) + g[size:]
        size *= 2
    if size < k:
        g = g[: n - k + 1] * U(0xD6E8FEB86659FD93) + g[k - size :]
    g = mix(g)
    width = window - k + 1
    least = sliding(np.minimum, g, width)  # of the window from each place, across texts too
    p = windows_in(window, counts)
    real = np.zeros(len(least) + 2 * (width - 1), U)
    real[width - 1 + p] = least[p]
    most = sliding(np.maximum, real, width)  # over the windows that cover each stretch
    return p, least[p], g[(most == g) & (g > 0)]


def slice_kernel(window: int, size: int):
    """(row, text) to slices of texts that have a window; the keys are least hashes and their numbers of places."""

    def one(number, rows, counts, words):
        local = pa.concat_arrays(words).dictionary_encode()
        index, counts = local.indices.to_numpy(), np.array(counts, np.int32)
        _, least, at = least_hashes(window, word_hashes(local.dictionary), index, counts)
        keys, c = np.unique(at, return_counts=True)
        turns = np.flatnonzero(np.append(True, least[1:] != least[:-1]))  # windows side by side mostly share it
        which = np.repeat(np.searchsorted(keys, least[turns]).astype(np.int32), np.diff(np.append(turns, len(least))))
        _, offsets, data = local.dictionary.buffers()
        state = packed(number + np.arange(len(rows)), counts, which, index, np.frombuffer(offsets, np.int32, len(local.dictionary) + 1), np.frombuffer(data, np.uint8))
        structs = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], ["a", "c"])
        cells = [pa.array([number], pa.int64()), pa.array([b"".join(rows)], pa.binary()), pa.array([state], pa.binary())]
        return pa.record_batch([*cells, pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), structs)], names=["slice", "ids", "state", "keys"])

    def kernel(batches):
        number, rows, counts, words, held = TaskContext.get().partitionId() << 40, [], [], [], 0
        for b in few(batches, 512):
            texts = b.filter(pc.greater_equal(pc.binary_length(b.column(1)), 2 * window - 1))  # shorter ones have no window
            found, count = words_of_texts(texts.column(1))
            ends = np.cumsum(count, dtype=np.int64)
            for i in np.flatnonzero(count >= window).tolist():
                n = int(count[i])
                if held and (held + n > size or len(rows) == ROWS):
                    yield one(number, rows, counts, words)
                    number, rows, counts, words, held = number + ROWS, [], [], [], 0
                rows.append(texts.column(0)[i].as_py())
                counts.append(n)
                words.append(found.slice(ends[i] - n, n))
                held += n
        if held:
            yield one(number, rows, counts, words)

    return kernel


def names_at(names: pa.Table, n: int) -> np.ndarray:
    """The name of each of n keys, 0 for those that have none."""
    out = np.zeros(n, np.int64)
    out[names["pos"].to_numpy()] = names["id"].to_numpy()
    return out


def sieve_kernel(window: int):
    """(slice, state, sent) and (slice, pos, id), one slice at a time, to its live words; keys are the words that need a name, and their counts."""
    schema = pa.schema([("slice", pa.int64()), ("state", pa.binary()), ("keys", pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())])))])

    def kernel(states: pa.Table, names: pa.Table) -> pa.Table:
        rows, counts, which, words, offsets, data = unpacked(states["state"][0].as_py())
        vocabulary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        seq = Sequences.of_texts(window, rows, counts, words)
        seq.pick(names_at(names, states["sent"][0].as_py())[which] > 0, cut=True)
        live = vocabulary.take(pa.array(seq.names))
        count = np.bincount(seq.words, minlength=len(live)).astype(np.int64)
        seq.names = own_names(live) if len(live) else np.zeros(0, np.int64)
        sent = np.flatnonzero(seq.names == 0)
        seq.names[sent] = -1 - np.arange(len(sent))
        seq.sym = seq.names[seq.words]
        keys = pa.StructArray.from_arrays([live.take(pa.array(sent)), pa.array(count[sent])], ["word", "c"])
        state = pa.array([seq.saved() if len(seq.p) else None], pa.binary())
        trim()
        return pa.Table.from_arrays([states["slice"].combine_chunks(), state, pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], schema=schema)

    return kernel


def round_kernel(window: int, level: int):
    """(slice, state, sent) and (slice, pos, id), one slice at a time, to its next state; id names the key at pos."""
    schema = pa.schema(
        [
            ("slice", pa.int64()), ("state", pa.binary()), ("words", pa.binary()), ("live", pa.int64()),
            ("keys", pa.list_(pa.struct([(k, pa.int64()) for k in "abl"] + [("c", pa.int64())]))),
            ("stretches", pa.list_(pa.struct([*((k, pa.int64()) for k in ("name", "h1", "h2", "row", "s", "n")), ("moves", pa.bool_())]))),
        ]
    )

    def listed(columns, kind):
        fields = list(kind.value_type)
        arrays = [pa.array(x, f.type) for x, f in zip(columns or [[]] * len(fields), fields)]
        return pa.ListArray.from_arrays(pa.array([0, len(arrays[0])], pa.int32()), pa.StructArray.from_arrays(arrays, fields=fields))

    def kernel(states: pa.Table, names: pa.Table) -> pa.Table:
        seq = Sequences.loaded(window, states["state"][0].as_py(), names_at(names, states["sent"][0].as_py()))
        words = None
        if level == 0:  # all that can be repeated is here still, with its words' names
            seq.pick(~any_in(seq.sym == 0, seq.lo, seq.hi))
            words = packed(seq.names, seq.words, seq.seg, seq.rows[seq.seg_row], seq.seg_at)
        stretches, keys = seq.round(level)
        live = len(seq.p)
        cells = [pa.array([seq.saved() if live else None], pa.binary()), pa.array([words], pa.binary()), pa.array([live])]
        trim()
        columns = [states["slice"].combine_chunks(), *cells, listed(keys, schema.field(4).type), listed(stretches, schema.field(5).type)]
        return pa.Table.from_arrays(columns, schema=schema)

    return kernel


def begins_of(t: pa.Table, columns: int) -> np.ndarray:
    """Where rows begin that differ from the one before in the first columns."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for i in range(columns):
        if t.schema.types[i] == pa.binary():  # words
            new[pc.run_end_encode(t.column(i).combine_chunks()).run_ends.to_numpy()[:-1]] = True
        else:
            x = t.column(i).to_numpy()
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches, columns: int):
    """Tables of sorted batches, cut only where the first columns change, and where groups begin in them."""
    key = lambda b, at: tuple(b.column(i)[at].as_py() for i in range(columns))
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if len(held) > 1 and key(b, b.num_rows - 1) == key(held[0], 0):
            continue  # one group goes on
        t = pa.Table.from_batches(held)
        starts = begins_of(t, columns)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), starts[:-1]
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def naming_kernel(level: int, columns: int):
    """(key columns, slice, pos, c), sorted by key, to (slice, pos, id) for keys whose counts add up to two or more."""

    def kernel(batches):
        number = NAMES + level * LEVEL + (TaskContext.get().partitionId() << 33)
        for t, starts in whole_groups(batches, columns):
            place, pos, c = (t.column(columns + i).to_numpy() for i in range(3))
            often = np.add.reduceat(c, starts) >= 2
            ids = number + np.cumsum(often) - 1
            number += int(often.sum())
            sizes = np.diff(np.append(starts, t.num_rows))
            mask = np.repeat(often, sizes)
            yield pa.record_batch([pa.array(place[mask]), pa.array(pos[mask]), pa.array(np.repeat(ids, sizes)[mask])], names=["slice", "pos", "id"])

    return kernel


def named_keys(state: DataFrame, columns: list[str], level: int) -> DataFrame:
    """(slice, pos, id): names of each slice's keys that occur twice or more in the corpus.

    A name follows from the partition of its key and the key's place in order there, so a task that is
    repeated gives the same.
    """
    keys = state.select("slice", F.posexplode("keys").alias("pos", "k"))
    rows = keys.select(*(f"k.{c}" for c in columns), "slice", F.col("pos").cast("long").alias("pos"), "k.c")
    rows = rows.repartition(*columns).sortWithinPartitions(*columns)
    return rows.mapInArrow(naming_kernel(level, len(columns)), "slice long, pos long, id long")


def answered(state: DataFrame, columns: list[str], level: int, kernel, schema: str) -> DataFrame:
    """The next state of each slice, from its state and the names of its keys."""
    names = named_keys(state, columns, level)
    rows = state.filter("state is not null").select("slice", "state", F.size("keys").alias("sent"))
    return rows.groupBy("slice").cogroup(names.groupBy("slice")).applyInArrow(kernel, schema)


def stretches_of(texts: DataFrame, ws: Workspace, window: int = WINDOW, size: int = SLICE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rounds: the stretches (name, h1, h2, row, s, n, moves) of live windows, and each slice's words and rows. texts: row, text."""
    slices = ws.table(texts.mapInArrow(frugal(slice_kernel(window, size)), SLICES), "slices")
    ids = ws.part(slices.select("slice", "ids"), "ids")
    state = ws.table(answered(slices, ["a"], 0, sieve_kernel(window), SIEVED), "sieved")
    ws.drop(slices)
    columns, level, out = ["word"], 0, []
    while True:
        now = ws.table(answered(state, columns, level, round_kernel(window, level), STATE), f"round-{level}")
        if level == 0:
            words = ws.part(now.select("slice", "words"), "words")
        out.append(ws.part(now.select(F.inline("stretches")), "stretches")._weft_path)
        live = now.agg(F.sum("live")).first()[0]
        ws.drop(state)
        state, columns, level = now, ["a", "b", "l"], level + 1
        if not live:
            ws.drop(state)
            return ws.spark.read.schema(STRETCH.replace(":", "")).parquet(*out), words, ids


def window_kernel(window: int):
    """(slice, words) and the stretches that a slice publishes to their windows, by digests of their words' names."""
    schema = pa.schema([*((k, pa.int64()) for k in ("name", "h1", "h2", "row", "s")), ("wanted", pa.bool_())])

    def kernel(words: pa.Table, published: pa.Table) -> pa.Table:
        if not published.num_rows or not words.num_rows:
            return schema.empty_table()
        names, index, seg, seg_row, seg_at = unpacked(words["words"][0].as_py())
        name, row, s, n = (published[k].to_numpy() for k in ("name", "row", "s", "n"))
        place = lambda row, at: (row % ROWS << 32) + at
        of = np.searchsorted(place(seg_row, seg_at), place(row, s), "right") - 1
        each = np.repeat(np.arange(len(n)), n)
        more = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        at = (seg[of] + s - seg_at[of])[each] + more
        h1, h2 = digests_of(memoryview(names[index].tobytes()), 8 * at, 8 * (at + window))
        columns = [name[each], h1, h2, row[each], s[each] + more, ~published["covered"].to_numpy(zero_copy_only=False)[each]]
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=schema)

    return kernel


def ranges_kernel(ids: pa.Table, found: pa.Table) -> pa.Table:
    """(slice, ids) and (slice, row, s, n) to each row's digest and its ranges, joined where they touch."""
    schema = pa.schema([("row", pa.binary()), ("ranges", pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64())])))])
    if not found.num_rows or not ids.num_rows:
        return schema.empty_table()
    data = ids["ids"][0].as_py()
    row, s, n = (found[k].to_numpy() for k in ("row", "s", "n"))
    order = np.lexsort((s, row))
    row, s, end = row[order], s[order], (s + n)[order]
    new = np.append(True, (row[1:] != row[:-1]) | (s[1:] != end[:-1]))
    at = np.flatnonzero(new)
    row, s, end = row[at], s[at], end[np.append(at[1:], len(end)) - 1]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s), pa.array(end - s)], ["s", "n"]))
    digests = [data[16 * i : 16 * i + 16] for i in (row[first] % ROWS).tolist()]
    return pa.Table.from_arrays([pa.array(digests, pa.binary()), lists], schema=schema)


def removal_kernel(window: int, text_at: int, ranges_at: int, names: list[str]):
    def kernel(batches):
        for b in few(batches, 256):
            texts, total, removed = [], [], []
            for text, ranges in zip(b.column(text_at).to_pylist(), b.column(ranges_at)):
                words = (text or "").encode().split()
                total.append(len(words))
                if ranges.is_valid:
                    s, n = (ranges.values.field(k).to_numpy() for k in (0, 1))
                    keep = ~in_any(len(words), s, s + n + window - 1)
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                removed.append(total[-1] - len(words))
                texts.append(b" ".join(words).decode())
            added = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.record_batch([*b.columns[:ranges_at], *added], names=names)

    return kernel


def frequent_names(rows: DataFrame, support: float = SUPPORT) -> list[int]:
    """Misra-Gries: all names of more than this share of the stretches, and perhaps others, 1 / support at most."""
    found = rows.freqItems(["name"], support).first()
    return [n for n in (found[0] or []) if n is not None] if found else []


def marks_kernel(batches):
    """Stretches sorted by name, h1 and h2 to those that are covered or published."""
    for t, starts in whole_groups(batches, 1):
        spans = begins_of(t, 3)
        first = np.zeros(t.num_rows, bool)
        first[spans] = True
        several = np.repeat(np.add.reduceat(first.astype(np.int64), starts) > 1, np.diff(np.append(starts, t.num_rows)))
        sizes = np.diff(np.append(spans, t.num_rows))
        covered = np.repeat(sizes > 1, sizes)
        publish = (first & several) | (t["moves"].to_numpy(zero_copy_only=False) & ~covered)
        columns = [*(t[k].to_numpy() for k in ("name", "row", "s", "n")), covered, publish]
        yield pa.record_batch([pa.array(x[covered | publish]) for x in columns], names=["name", "row", "s", "n", "covered", "publish"])


def marked_by_sorting(rows: DataFrame) -> DataFrame:
    """Stretches with covered (an equal one is elsewhere) and publish (others of the anchor differ), if either; for names that aren't frequent."""
    rows = rows.select("name", "h1", "h2", "row", "s", "n", "moves").repartition("name").sortWithinPartitions("name", "h1", "h2")
    return rows.mapInArrow(marks_kernel, "name long, row long, s long, n long, covered boolean, publish boolean")


def marked_by_join(rows: DataFrame, ws: Workspace) -> DataFrame:
    """The same for frequent names: counts with a map-side combine, and a join that the planner may split."""
    place, span = F.struct("row", "s"), ["name", "h1", "h2"]
    kinds = ws.table(rows.groupBy(*span).agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")), "kinds")
    several = kinds.groupBy("name").agg((F.min(F.struct("h1", "h2")) != F.max(F.struct("h1", "h2"))).alias("several"))  # a row for each frequent name
    both = rows.join(kinds, span).join(F.broadcast(several), "name")
    covered = F.col("c") > 1
    return both.select("name", "row", "s", "n", covered.alias("covered"), (((place == F.col("first")) & F.col("several")) | (F.col("moves") & ~covered)).alias("publish"))


def repeated_ranges(texts: DataFrame, ws: Workspace, window: int = WINDOW, size: int = SLICE) -> DataFrame:
    """(row, ranges): window starts s..s+n-1 that start elsewhere too. texts: row (16 bytes), text."""
    rows, words, ids = stretches_of(texts, ws, window, size)
    hot = F.col("name").isin(frequent_names(rows))
    marks = marked_by_sorting(rows.filter(~hot)).unionByName(marked_by_join(rows.filter(hot), ws))
    marks = ws.table(marks.filter("covered or publish"), "marks")
    by_slice = lambda df: df.groupBy((F.col("row") - F.col("row") % ROWS).alias("slice"))
    published = by_slice(marks.filter("publish").select("name", "row", "s", "n", "covered"))
    windows = words.groupBy("slice").cogroup(published).applyInArrow(window_kernel(window), "name long, h1 long, h2 long, row long, s long, wanted boolean")
    windows = ws.table(windows, "windows")
    key = ["name", "h1", "h2"]
    shared = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").select(*key)
    shared = ws.table(shared, "shared")  # a table on both sides lets the planner split the join where a window is hot
    found = windows.filter("wanted").join(shared, key).select("row", "s", F.lit(1).cast("long").alias("n"))
    ranges = by_slice(marks.filter("covered").select("row", "s", "n").unionByName(found))
    ranges = ids.groupBy("slice").cogroup(ranges).applyInArrow(ranges_kernel, "row binary, ranges array<struct<s: long, n: long>>")
    # rows that share id and text have the same ranges
    return ws.table(ranges.groupBy("row").agg(F.first("ranges").alias("ranges")), "ranges")


def row_digest(id_col: str, text_col: str):
    """128 bits that stand for a row's id and text."""
    of = lambda c: F.sha2(c.cast("binary"), 256)
    both = F.concat(F.coalesce(of(F.col(id_col).cast("string")), F.lit("")), of(F.coalesce(F.col(text_col), F.lit(""))))
    return F.unhex(F.substring(of(both), 1, 32))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space). docs are read twice."""
    docs, ws = docs.drop("n_words", "n_removed", "kept_text", "__row"), Workspace(docs.sparkSession)
    keyed = docs.withColumn("__row", row_digest(id_col, text_col))
    ranges = repeated_ranges(keyed.select(F.col("__row").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ws, window, size)
    ws.keep_only(ranges)
    ranges = ranges.select(F.col("row").alias("__row"), F.col("ranges").alias("__ranges"))
    out = keyed.join(ranges, "__row", "left").select(*docs.columns, "__ranges")
    names = [*docs.columns, "n_words", "n_removed", "kept_text"]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    kernel = removal_kernel(window, docs.columns.index(text_col), len(docs.columns), names)
    return out.mapInArrow(kernel, T.StructType([*docs.schema.fields, *added]))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}
