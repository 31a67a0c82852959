"""Exact, line, near and substring deduplication against brute force."""

import hashlib
import random
import struct
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import messy
from pyspark.sql import functions as F
from weftcode.llm.common import Workspace
from weftcode.llm import exact_dedup, line_dedup, near_dedup, substring_dedup

SPACES = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# exact


@pytest.mark.parametrize("support", [0.005, 0.4])
def test_exact_dedup(spark, support):
    groups = defaultdict(list)
    for doc, text in messy.texts():
        groups[text or ""].append(doc)
    want = Counter()
    for doc, text in messy.texts():
        group = groups[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        want[(doc, keep, len(group), keep is not None and doc == keep, sha(text or ""))] += 1
    got = exact_dedup.exact_dedup(messy.frame(spark), support=support).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == want


def test_frequent_digests_are_found(spark):
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(3000)]
    digests = exact_dedup.text_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    found = exact_dedup.frequent_digests(digests, 0.05)
    assert sha("hot").upper() in found and len(found) <= 20


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(messy.frame(spark, True)).count() == 0


# lines


def line_counts(rows):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line)
            if doc is not None and key:
                held[key].add(doc)
    return {k: (len(v), min(v)) for k, v in held.items()}


def test_line_dedup(spark):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    held = defaultdict(set)
    for doc, text in messy.texts():
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                held[key(line)].add(doc)
    want = Counter()
    for doc, text in messy.texts():
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held[key(x)]) < 2 or min(held[key(x)]) == doc]
        want[(doc, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    out = line_dedup.line_dedup(messy.frame(spark))
    assert set(messy.frame(spark).columns) - {"n_lines", "n_dropped"} < set(out.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == want
    assert line_dedup.line_dedup(messy.frame(spark, True)).count() == 0


def state(index):
    return {struct.pack("<qq", r.k1, r.k2): (r.docs, r.owner) for r in index.state().collect()}


def fingerprints(index):
    """How many the filters hold; each key's is in the filter of its last fresh segment."""
    filters = {(s["at"], r.shard): line_dedup.CuckooFilter.from_bytes(r.blob) for s in index.inserted for r in index.filters(s).collect()}
    shards = {s["at"]: s["shards"] for s in index.inserted}
    for r in index.state().collect():
        assert filters[r["at"], r.k2 & (shards[r["at"]] - 1)].contains(np.array([r.k1]).view(np.uint64)).all()
    return sum(f.stored for f in filters.values())


def lines_of(df):
    return {(r.doc, r.k1, r.k2) for r in df.collect()}


@pytest.mark.parametrize("shard_keys", [8, 1 << 20])
def test_line_index_is_incremental_and_reversible(spark, shard_keys):
    rnd = random.Random(3)
    pool = [f"shared line number {i} here" for i in range(60)]
    rows = [(i, "\n".join(rnd.choices(pool, k=3) + [f"own line of document {i}", "short"])) for i in range(60)] + [(None, pool[0])]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    early, late = [r for r in rows if r[0] is None or r[0] < 30], [r for r in rows if r[0] is not None and r[0] >= 30]
    one = line_dedup.LineIndex(spark, shard_keys=shard_keys).insert(frame(late))
    assert state(one) == line_counts(late) and fingerprints(one) == len(state(one)) and lines_of(one.lost) == lines_of(one.drops())
    both = one.insert(frame(early))
    assert state(both) == line_counts(rows) and fingerprints(both) == len(state(both))
    assert lines_of(both.lost) | lines_of(one.lost) == lines_of(both.drops())
    back = both.delete(frame([(i, None) for i, _ in early]))
    assert state(back) == state(one) and fingerprints(back) == len(state(one)) and lines_of(back.drops()) == lines_of(one.drops())
    assert state(back.insert(frame(late))) == state(one)  # what is there already changes nothing
    again = back.insert(frame(early))  # keys that died come back
    assert state(again) == line_counts(rows) and fingerprints(again) == len(state(again)) and lines_of(again.drops()) == lines_of(both.drops())
    small = again.compact()
    assert state(small) == line_counts(rows) and fingerprints(small) == len(state(small)) and len(small.segments) == 1
    assert state(line_dedup.LineIndex.open(spark, small.root, both.version)) == line_counts(rows)  # older versions stay


def test_line_index_compacts_itself(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_SEGMENTS", 3)
    index, rows = line_dedup.LineIndex(spark), [(i, f"a line that all hold\nown line number {i}") for i in range(4)]
    for row in rows:
        index = index.insert(spark.createDataFrame([row], "doc_id long, text string"))
        assert len(index.segments) < 3 and len(lines_of(index.lost)) == (row[0] > 0)
    assert state(index) == line_counts(rows) and index.insert(spark.createDataFrame([], "doc_id long, text string")).drops().count() == 3


def test_a_batch_reads_the_shards_that_it_needs(spark):
    """Keys that no filter holds look nothing up; one that is known has one shard read."""
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shard_keys=16).insert(frame([(1, "\n".join(f"line number {i} of one" for i in range(200)))]))
    assert index.segments[0]["shards"] == 16
    added = lambda text: line_dedup.references(frame([(2, text)])).groupBy("k1", "k2").count()
    assert index._maybe(added("\n".join(f"a new line {i}" for i in range(50)))).count() <= 1
    assert index._maybe(added("line number 7 of one\nsomething entirely new")).select("shard").distinct().count() == 1


def test_line_index_starts_no_other_python_workers(spark, monkeypatch, tmp_path):
    """Rows that the driver parallelizes go through workers of another kind than kernels do, beside theirs in each executor."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a line of number ', id % 7, '\nand one of ', id) AS text")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows of the driver"))
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/lines")
    assert index.drops().count() == 0
    index = index.insert(docs.filter("doc_id < 30")).insert(docs.filter("doc_id >= 30"))
    assert index.drops().count() == 40 - 7
    index = line_dedup.LineIndex.open(spark, index.root, index.delete(docs.filter("doc_id < 7")).version)
    assert index.drops().count() == index.compact().drops().count() == 33 - 7


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    f = line_dedup.CuckooFilter(4000)
    f.insert(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    g = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert g.contains(keys[2000:4000]).all() and g.stored == 2000 and g.contains(keys[:2000]).mean() < 0.01
    tight = line_dedup.CuckooFilter(1)
    tight.insert(keys[:50])  # more than it has room for: kept aside, not lost
    assert tight.contains(keys[:50]).all()
    tight.delete(keys[:50])
    assert tight.stored == 0 and not tight.aside


# near-duplicates


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) >= 5:
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def near_brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def near_got(df):
    return Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect())


def test_near_dedup_of_messy_rows(spark):
    assert near_got(messy.frame(spark)) == near_brute(messy.texts())
    assert near_dedup.near_dedup(messy.frame(spark, True)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_of_dense_groups(spark, seed):
    """Groups far larger than a hot list, whose members are partly linked, and a passage that many share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(2):
        base = rnd.choices(words, k=rnd.choice([60, 120]))
        for _ in range(60):
            copy = list(base)
            for _ in range(rnd.randint(0, 9)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    passage = rnd.choices(words, k=60)
    texts += [" ".join(rnd.choices(words, k=rnd.randint(10, 90)) + passage) for _ in range(40)]
    rows = [(i * 7 % 5003, t) for i, t in enumerate(texts)]
    assert near_got(spark.createDataFrame(rows, "doc_id long, text string")) == near_brute(rows)


def random_sets(rng, base, own, many):
    """Sets of digests that share base of their elements."""
    digests = lambda n: rng.integers(0, 1 << 60, (2, n)).astype(np.uint64)
    shared, out = digests(base), []
    for _ in range(many):
        x = np.concatenate([shared, digests(own)], axis=1)
        out.append(x[:, np.lexsort((x[1], x[0]))])
    return out


@pytest.mark.parametrize("blocks", [[0] * 6, [0, 1, 0, 1, 1, 0]])
def test_blocks_compare_all(blocks):
    """One block with itself, and two blocks: links that join components are found whatever the order."""
    sets = random_sets(np.random.default_rng(1), 97, 3, 6)
    sig = near_dedup.signatures(sets).astype(np.uint8)
    n = np.array([s.shape[1] for s in sets])
    out = near_dedup.compare_blocks(np.array(blocks), np.arange(6), n, n, np.arange(6), sig, sets)
    assert out.num_rows == 5


def test_links_are_confirmed_on_whole_digests():
    """Sets that agree in one half of their digests only have nothing in common."""
    (x,) = random_sets(np.random.default_rng(2), 40, 0, 1)
    assert near_dedup.linked(x, x) and not near_dedup.linked(x, np.array([x[0], x[1] + np.uint64(1)]))
    twins = np.array([np.repeat(x[0], 2), np.stack([x[1], x[1] + np.uint64(1)], 1).ravel()])
    assert near_dedup.linked(twins, twins) and not near_dedup.linked(x, twins)


def thue_morse(n: int) -> tuple[str, str]:
    """Two strings that agree under any polynomial hash modulo 2 ** 64 (from 1,024 letters on)."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_weak_hashes_confuse_are_unlike(spark):
    x, y = thue_morse(2048)
    assert near_got(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")) == Counter([(1, 1, 1, True), (2, 1, 2, True)])
    side = [f"w{i}" for i in range(17)]
    rows = [(i, " ".join([*side, w, *side])) for i, w in ((1, x), (2, y))]
    assert near_got(spark.createDataFrame(rows, "doc_id long, text string")) == near_brute(rows)
    assert substring_got(spark.createDataFrame(rows, "doc_id long, text string")) == substring_brute(rows)
    # the same as sequences of words: long spans under one anchor
    rows = [(i, " ".join(t) + " end") for i, t in ((1, x), (2, y))]
    assert substring_got(spark.createDataFrame(rows, "doc_id long, text string")) == substring_brute(rows)


# substrings


def substring_brute(rows, window=35):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[(d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    return out


def substring_got(df, **options):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, **options).collect())


def test_substring_dedup_of_messy_rows(spark):
    assert substring_got(messy.frame(spark)) == substring_brute(messy.texts())
    assert substring_dedup.substring_dedup(messy.frame(spark, True)).count() == 0


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 5), (3, 1)])
def test_substring_dedup_of_random_rows(spark, seed, window):
    """Few words, so that runs, periods and repeats within a text abound."""
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        words = rnd.choices("abcd", k=rnd.randint(0, 80)) + [rnd.choice("ab")] * rnd.randint(0, 90) + (["x", "y", "z"] * rnd.randint(0, 30))
        rows.append((i, " ".join(words)))
    shared = " ".join(str(rnd.randrange(10**6)) for _ in range(60))
    rows += [(200 + i, f"{i} {' '.join(shared.split()[i:])} end {i}") for i in range(10)]
    assert substring_got(spark.createDataFrame(rows, "doc_id long, text string"), window=window) == substring_brute(rows, window)


@pytest.mark.parametrize("size", [1, 200, 1 << 18])
def test_slices_do_not_matter(spark, size):
    """Texts of one slice, or of many, and copies far more than a frequent anchor's share."""
    rnd = random.Random(size)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(rnd.choices(["u", "v", f"o{i}"], k=40) + passage[i % 7 :] + [f"e{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join(passage + passage[::-1])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert substring_got(df, size=size) == substring_brute(rows)


def test_names_are_global_and_exact(spark):
    """Equal words have one name in all slices, and nothing else has it."""
    rows = [(i.to_bytes(16, "little"), f"a word-that-is-long another-word d{i % 3}-and-more " * 12) for i in range(9)]
    texts = spark.createDataFrame(rows, "row binary, text string").repartition(4)
    ws = Workspace(spark)
    slices = ws.table(texts.mapInArrow(substring_dedup.slice_kernel(35, 1), substring_dedup.SLICES), "slices")
    state = ws.table(substring_dedup.answered(slices, ["a"], 0, substring_dedup.sieve_kernel(35), substring_dedup.SIEVED), "sieved")
    names = ws.table(substring_dedup.named_keys(state, ["word"], 0), "names")
    keys = state.select("slice", F.posexplode("keys").alias("pos", "k")).join(names, ["slice", "pos"])
    of = {(bytes(r.k.word), r.id) for r in keys.collect()}
    assert len(of) == len({w for w, _ in of}) == len({i for _, i in of}) == 5 and b"a" not in {w for w, _ in of}
    assert min(i for _, i in of) >= substring_dedup.NAMES
    assert keys.select("slice").distinct().count() == 9


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=9), min_size=1, max_size=30))
def test_short_words_are_their_own_names(words):
    words = sorted(words)
    names = substring_dedup.own_names(pa.array([b"skip", *words]).slice(1)).tolist()
    short = [n for n, w in zip(names, words) if len(w) <= 7]
    assert all((n == 0) == (len(w) > 7) for n, w in zip(names, words)) and len(set(short)) == len(short)
    assert all(0 < n < substring_dedup.NAMES for n in short)


def test_a_hot_key_that_fills_batches_has_one_name():
    kernel = substring_dedup.naming_kernel(0, 3)
    rows = [(1, 1, 1, k, 0, 1) for k in range(3)] + [(2, 2, 2, k, 1, 1) for k in range(25)] + [(3, 3, 3, 0, 2, 1), (4, 4, 4, 0, 3, 2)]
    batch = pa.record_batch([pa.array(x) for x in zip(*rows)], names=["a", "b", "l", "slice", "pos", "c"])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substring_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
        for size in (1, 2, 7, 100):
            got = [r for b in kernel(batch.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
            names = {r["pos"]: {x["id"] for x in got if x["pos"] == r["pos"]} for r in got}
            assert len(got) == 29 and set(names) == {0, 1, 3} and all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\u00a0\u2003é\x1c", max_size=12), max_size=6), st.integers(0, 2))
def test_words_are_split_like_python_splits_bytes(texts, skip):
    column = pa.array(["before", "x y", *texts]).slice(skip)
    found, count = substring_dedup.words_of_texts(column)
    want = [t.encode().split() for t in column.to_pylist()]
    assert found.to_pylist() == [w for words in want for w in words] and count.tolist() == [len(w) for w in want]
