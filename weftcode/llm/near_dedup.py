"""MinHash near-deduplication by an inverted join of signature coordinates.

A text's set holds 128-bit digests of its distinct five-word shingles: each word's BLAKE2b digest, stirred
into a state of 128 bits. Documents whose sets have equal 128-bit BLAKE2b digests are one class, named by its
smallest id; all that follows works on classes. Signatures are made of one half of each digest, which can
add candidates but lose none; links are confirmed on whole digests.

1. A signature has 64 coordinates. Two sets of similarity 0.75 agree in 48 of them on
   average and in fewer than ``MATCHES`` = 28 with a probability of about 1e-8.
2. Every (coordinate, value) is a token. Tokens of more than ``HOT`` classes are hot. A
   class posts under its first 64 - 28 + 1 tokens, tokens that aren't hot first (prefix
   merging): two classes that agree 28 times meet in a posting list of such a prefix.
   Lists of hot tokens are thereby skipped by all classes with fewer than 28 hot tokens.
3. A list that isn't hot pairs all its members, at most ``HOT``. A hot list pairs its
   first member with each other one. Agreements of the distinct pairs are counted over whole signatures
   (one byte a coordinate: no agreement is missed) and pairs below 28 or of too
   different set sizes go. The rest are confirmed on the full sets.
4. Components of the confirmed links. A hot list whose members are all in one component
   is done. Of the members of other lists, those go that hold too few shingles which another component's
   member holds (no link is possible). The remaining ones that are connected by hot lists are
   a cluster; its members are compared in blocks dealt over tasks, the most alike pairs first,
   until every pair of different components that agrees 28 times and whose shared shingles may
   suffice is confirmed, refuted on the full sets, or has its components joined by another link.

Defined results: null counts as empty; an empty text, or one without words, has no set,
is linked with nothing and stays. Sets that have the same smallest id (rows that repeat an id)
are one node. A row with a null id is linked with nothing and stays, its component_id null.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Workspace, frugal, joined, load, mix
from .components import components
from .packing import few

SHINGLE = 5
COORDINATES, MATCHES = 64, 28
PREFIX = COORDINATES - MATCHES + 1
#: Lists of more classes than this are hot.
HOT = 16
#: Members of a cluster, and shingles of them, that one task compares with as many others at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19

_rng = np.random.default_rng(64)
XORS = _rng.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)


def stirred(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """128-bit digests, as two rows, of the n words from each of these places; words are digests too (two rows)."""
    x, y = np.full(len(at), n, U), np.zeros(len(at), U)
    for k in range(n):
        x = mix(x ^ words[0][at + k]) + y * U(0x9E3779B97F4A7C15)
        y = mix(y + words[1][at + k]) ^ (x >> U(29)) ^ (x << U(35))
    return np.array([x, y])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct shingle digests of each text (given as UTF-8), A-Z lowered: two rows, sorted by the first, then the second."""
    split = [t.lower().split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    found = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    digests = b"".join([blake2b(w, digest_size=16).digest() for w in found.dictionary.to_pylist()])
    words = np.frombuffer(digests, U).reshape(-1, 2).T[:, found.indices.to_numpy()]
    first, sets = np.cumsum(count) - count, [np.zeros((2, 0), U)] * len(texts)
    of = np.repeat(np.arange(len(texts)), np.maximum(count - SHINGLE + 1, 0))
    at = np.arange(len(of)) - np.searchsorted(of, of) + first[of]
    x, y = stirred(words, at, SHINGLE)
    order = np.lexsort((y, x, of))
    x, y, of = x[order], y[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (of[1:] != of[:-1])
    x, y, of = x[new], y[new], of[new]
    begin, end = (np.searchsorted(of, np.arange(len(texts)), side).tolist() for side in ("left", "right"))
    for i, n in enumerate(count.tolist()):
        if n >= SHINGLE:
            sets[i] = np.array([x[begin[i] : end[i]], y[begin[i] : end[i]]])
        elif n:
            sets[i] = stirred(words, first[i : i + 1], n)
    return sets


def set_of(data: bytes) -> np.ndarray:
    """The inverse of a set's tobytes()."""
    return np.frombuffer(data, U).reshape(2, -1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row i: for each coordinate the least of the permuted first halves of set i (none is empty)."""
    x = np.concatenate([s[0] for s in sets])
    starts = np.cumsum([0, *(s.shape[1] for s in sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((x ^ XORS[j]) * FACTORS[j], starts)
    return out


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    data, size = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())


def matrix(column, dtype) -> np.ndarray:
    """The inverse of fixed()."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def set_kernel(batches):
    for b in batches:
        for part, texts in joined(b, 1):
            sets = shingle_sets(texts)
            n = np.array([s.shape[1] for s in sets], np.int64)
            full = np.flatnonzero(n).tolist()
            f1, f2 = np.frombuffer(b"".join([blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), np.int64).reshape(-1, 2).T
            sig: list = [None] * len(sets)
            if full:
                for i, s in zip(full, fixed(signatures([sets[i] for i in full])).to_pylist()):
                    sig[i] = s
            yield pa.record_batch([part.column(0), pa.array(n), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"])


def token_keys(sig: np.ndarray) -> np.ndarray:
    return mix(sig + mix(np.arange(COORDINATES, dtype=np.uint64) + U(1)))


def token_kernel(batches):
    """(node, sig) to (key, node, at): all tokens."""
    for b in few(batches, 4096):
        keys = token_keys(matrix(b.column(1), np.uint64))
        nodes = np.repeat(b.column(0).to_numpy(), COORDINATES)
        at = np.tile(np.arange(COORDINATES, dtype=np.int32), b.num_rows)
        yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(nodes), pa.array(at)], names=["key", "node", "at"])


def prefix_kernel(batches):
    """(node, sig, hot) to (key, node, hot): the tokens of the prefix."""
    bits = np.arange(COORDINATES, dtype=np.uint64)
    for b in few(batches, 4096):
        keys = token_keys(matrix(b.column(1), np.uint64))
        hot = (b.column(2).to_numpy().view(np.uint64)[:, None] >> bits) & U(1)
        order = np.argsort(hot, axis=1, kind="stable")[:, :PREFIX]
        keys, hot = np.take_along_axis(keys, order, 1), np.take_along_axis(hot, order, 1)
        nodes = np.repeat(b.column(0).to_numpy(), PREFIX)
        yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(nodes), pa.array(hot.ravel().astype(bool))], names=["key", "node", "hot"])


def pair_kernel(batches):
    """Postings sorted by key and node to pairs a < b of all members of a list, which are HOT at most."""
    keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the end of a list that may go on
    for b in batches:
        if not b.num_rows:
            continue
        held = len(keys)
        keys, nodes = (np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate((keys, nodes)))
        out = []
        for d in range(1, HOT):
            same = keys[d:] == keys[:-d]
            same[: max(0, held - d)] = False  # pairs of the batch before
            if not same.any():
                break
            at = np.flatnonzero(same)
            out.append((nodes[at], nodes[at + d]))
        keys, nodes = keys[-HOT:], nodes[-HOT:]
        if out:
            a, c = (np.concatenate(x) for x in zip(*out))
            keep = a != c
            yield pa.record_batch([pa.array(np.minimum(a, c)[keep]), pa.array(np.maximum(a, c)[keep])], names=["a", "b"])


def similar_size(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


def match_kernel(batches):
    """(a, b, na, nb, sa, sb) to the pairs that agree often enough."""
    for b in few(batches, 8192):
        good = (matrix(b.column(4), np.uint8) == matrix(b.column(5), np.uint8)).sum(1) >= MATCHES
        good &= similar_size(b.column(2).to_numpy(), b.column(3).to_numpy())
        yield pa.record_batch([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["a", "b"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sets that aren't empty."""
    n, m = x.shape[1], y.shape[1]
    if n > m:
        return linked(y, x)
    if (y[0][1:] == y[0][:-1]).any():  # halves alone don't tell these apart
        both = len(set(zip(*x.tolist())) & set(zip(*y.tolist())))
    else:
        at = np.minimum(np.searchsorted(y[0], x[0]), m - 1)
        both = int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())
    return 100 * both >= 75 * (n + m - both)


def confirm_kernel(batches):
    """(a, b, set a, set b) to the pairs that are links."""
    for b in few(batches, 256):
        good = [linked(set_of(x), set_of(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        mask = pa.array(good, pa.bool_())
        yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])


class Sets:
    """Disjoint sets of component names."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def compare_blocks(block, node, n, m, component, sig, sets) -> pa.RecordBatch:
    """Links between members of different components that join these components: a spanning forest of them.

    All pairs of the two blocks are looked at, the most alike first; a pair whose components are
    joined by then needs no confirmation.
    """
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // len(right))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        most = np.minimum(m[i][:, None], m[right])  # of an intersection; a link needs 3/7 of both sizes
        ok = (component[i][:, None] != component[right]) & (7 * most >= 3 * (n[i][:, None] + n[right]))
        x, y = np.nonzero(ok)
        for part in range(0, len(x), 1 << 18):
            a, b = i[x[part : part + (1 << 18)]], right[y[part : part + (1 << 18)]]
            agree = (sig[a] == sig[b]).sum(1)
            good = agree >= MATCHES
            found.append((agree[good], a[good], b[good]))
    joined, out = Sets(), []
    agree, a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    for k in np.argsort(-agree, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        x, y = joined.find(int(component[i])), joined.find(int(component[j]))
        if x != y and linked(sets[i], sets[j]):
            joined.join(x, y)
            out.append((min(node[i], node[j]), max(node[i], node[j])))
    low, high = zip(*out) if out else ((), ())
    return pa.record_batch([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])


def block_kernel(batches):
    """Rows (cluster, p, q, block, node, n, m, component, sig, set), sorted by the first three: a group is two blocks of a cluster."""
    now, rows = None, []

    def close():
        block, node, n, m, component, sig = (np.concatenate(x) for x in zip(*(r[:6] for r in rows)))
        return compare_blocks(block, node, n, m, component, sig, [x for r in rows for x in r[6]])

    for b in batches:
        if not b.num_rows:
            continue
        key, p, q = (b.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            group = (key[at], p[at], q[at])
            if group != now and rows:
                yield close()
                rows = []
            now = group
            part = b.slice(at, to - at)
            sets = [set_of(x) for x in part.column(9).to_pylist()]
            rows.append([*(part.column(i).to_numpy() for i in (3, 4, 5, 6, 7)), matrix(part.column(8), np.uint8), sets])
    if rows:
        yield close()


class NearLinks:
    """Components of near-duplicates among the documents (id, text)."""

    def __init__(self, docs: DataFrame, ws: Workspace):
        self.docs, self.ws = docs, ws
        self.sets = ws.table(docs.mapInArrow(frugal(set_kernel), "id long, n long, f1 long, f2 long, sig binary"), "sets")
        real = self.sets.filter("n > 0 and id is not null")
        least = real.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "sig")).alias("r"))
        self.classes = ws.table(least.select(F.col("r.id").alias("node"), F.col("r.n").alias("n"), "f1", "f2", F.col("r.sig").alias("sig")), "classes")
        # nodes: one row per name
        self.nodes = self.classes.select("node", "n", "sig")

    def short(self) -> DataFrame:
        """(node, n, s): one byte of each coordinate."""

        def kernel(batches):
            for b in few(batches, 4096):
                yield pa.record_batch([b.column(0), b.column(1), fixed((matrix(b.column(2), np.uint64) >> U(20)).astype(np.uint8))], names=["node", "n", "s"])

        return self.nodes.mapInArrow(kernel, "node long, n long, s binary")

    def postings(self) -> DataFrame:
        tokens = self.nodes.select("node", "sig").mapInArrow(token_kernel, "key long, node long, at int")
        hot = self.ws.table(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("key"), "hot")
        # all tokens of a node are still side by side: they are one row before the exchange
        known = tokens.join(hot.withColumn("is_hot", F.lit(True)), "key", "left")
        masks = known.groupBy("node").agg(F.expr("bit_or(if(is_hot, shiftleft(1L, at), 0L))").alias("hot"))
        marked = self.nodes.join(masks, "node", "left").select("node", "sig", F.coalesce("hot", F.lit(0).cast("long")).alias("hot"))
        return self.ws.table(marked.mapInArrow(prefix_kernel, "key long, node long, hot boolean"), "postings")

    def matching(self, pairs: DataFrame, short: DataFrame) -> DataFrame:
        side = lambda x: short.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return self.ws.table(both.mapInArrow(match_kernel, "a long, b long").distinct(), "matching")

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of these nodes: the one exchange of texts."""

        def kernel(batches):
            for b in batches:
                for part, texts in joined(b, 1):
                    yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["node", "set"])

        texts = self.docs.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").select("id", "text")
        return self.ws.table(texts.mapInArrow(frugal(kernel), "node long, set binary"), "full")

    def confirmed(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """Of these pairs, those that the full sets confirm."""
        side = lambda x: full.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        return self.ws.table(both.mapInArrow(frugal(confirm_kernel), "a long, b long").distinct(), "links")

    def viable(self, nodes: DataFrame, parts: DataFrame, full: DataFrame, short: DataFrame) -> DataFrame:
        """(node, n, m, s, component): m shingles of a node are held in another component of these nodes too, by half of their digests.

        Its intersection with a node of another component has at most m elements, so a
        node with m < 0.75 n has no link that would join components.
        """

        def kernel(batches):
            for b in few(batches, 256):
                sets = [set_of(x)[0].view(np.int64) for x in b.column(1).to_pylist()]
                each = [len(x) for x in sets]
                columns = [pa.array(np.concatenate(sets)), *(pa.array(np.repeat(b.column(i).to_numpy(), each)) for i in (0, 2))]
                yield pa.record_batch(columns, names=["h", "node", "component"])

        now = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        rows = full.join(now, "node").select("node", "set", "component").mapInArrow(kernel, "h long, node long, component long")
        shared = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
        m = rows.join(shared, "h").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
        out = short.join(now, "node").join(m, "node").filter("100 * m >= 75 * n")
        return self.ws.table(out.select("node", "n", "m", "s", "component"), "viable")

    def blocks(self, hot: DataFrame, viable: DataFrame, full: DataFrame) -> DataFrame | None:
        """Rows of block_kernel. Nodes that share a hot list are one cluster; None if no list has two components."""
        rows = hot.join(viable.select("node", "component"), "node")
        lists = rows.groupBy("key").agg(F.min("node").alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        lists = self.ws.table(lists.filter("lo <> hi").select("key", "first"), "lists")
        stars = self.ws.table(rows.join(lists, "key").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        if stars.isEmpty():
            return None
        clusters = self.ws.table(components(stars, self.ws).withColumnRenamed("component", "cluster"), "clusters")
        rows = viable.join(clusters, "node")
        size = rows.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        rows = rows.join(self.ws.table(size, "sizes"), "cluster").join(full, "node")
        rows = rows.withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = rows.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "n", "m", "component", "s", "set")
        return rows.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")

    def components(self) -> DataFrame:
        """(node, component) of all nodes that have links."""
        postings, short = self.postings(), self.ws.table(self.short(), "short")
        cold = postings.filter("not hot").select("key", "node").repartition("key").sortWithinPartitions("key", "node")
        hot = postings.filter("hot").select("key", "node")
        firsts = self.ws.table(hot.groupBy("key").agg(F.min("node").alias("a")), "firsts")
        stars = hot.join(firsts, "key").filter("a <> node").select("a", F.col("node").alias("b"))
        pairs = self.matching(cold.mapInArrow(pair_kernel, "a long, b long").unionByName(stars).distinct(), short)
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
        full = self.full_sets(nodes)
        links = self.confirmed(pairs, full)
        parts = self.ws.table(components(links, self.ws), "parts")
        nodes = self.open_nodes(hot, parts)
        if nodes is None:
            return parts
        viable = self.viable(nodes, parts, full, short)
        viable = self.viable(viable.select("node"), parts, full, short)  # without what the others held
        blocks = self.blocks(hot, viable, full)
        if blocks is None:
            return parts
        new = self.ws.table(blocks.mapInArrow(frugal(block_kernel), "a long, b long").distinct(), "joins")
        return parts if new.isEmpty() else self.merged(parts, new)

    def open_nodes(self, hot: DataFrame, parts: DataFrame) -> DataFrame | None:
        """Members of hot lists that have more than one component; None if there are none."""
        rows = hot.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        lists = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        lists = self.ws.table(lists, "lists")
        out = self.ws.table(hot.join(lists, "key", "left_semi").select("node").distinct(), "open-nodes")
        return None if out.isEmpty() else out

    def merged(self, parts: DataFrame, links: DataFrame) -> DataFrame:
        """Components after these links are added."""
        of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        edges = edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        new = self.ws.table(components(edges, self.ws), "joined").select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = parts.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        alone = new.select(F.col("component").alias("node"), F.col("to").alias("component")).join(parts, "node", "left_anti")
        return self.ws.table(moved.unionByName(alone), "parts")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    ws = Workspace(docs.sparkSession)
    near = NearLinks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ws)
    parts = ws.table(near.components(), "components")
    names = near.classes.select("f1", "f2", "node").join(parts, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    rows = near.sets.select("id", F.col("n").alias("n_shingles"), "f1", "f2")
    out = rows.join(names, ["f1", "f2"], "left")
    part = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))
    out = ws.table(out.select("id", "n_shingles", part.alias("component_id")), "result")
    ws.keep_only(out)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
