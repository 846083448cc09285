"""PartEnum self-join and components against brute force."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm import common, nearjoin
from tidemark.llm import shingles as shingles_module
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets, word_hashes

from oddities import ODD, thue_morse


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(text, size))
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    pairs = [(i, a) for i, some in sets.items() for a in some if a]
    for n, (i, a) in enumerate(pairs):
        for j, b in pairs[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def corpus(seed, groups=12, copies=8):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 5, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"v{rng.randrange(9)}"]
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows


def check(make, rows, size, percent):
    got = nearjoin.near_components(make(rows), words=size, percent=percent).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["n_shingles"] in {len(shingles(t, size)) for i, t in rows if i == r["doc_id"]}


def test_equals_brute_force(make):
    check(make, corpus(1), 4, 85)


def test_five_words_eighty_percent_in_blocks(make, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(nearjoin, "BLOCK_DOCS", 3)
    monkeypatch.setattr(nearjoin, "MOST_BROADCAST", 0)
    check(make, corpus(2), 5, 80)


@pytest.mark.parametrize("block", [500_000, 300])
def test_pairs_lose_no_link(make, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "BLOCK_ELEMENTS", block)
    rows = corpus(4, groups=20, copies=12)
    sets, least = {i: shingles(t, 4) for i, t in rows}, {}
    for i in sorted(sets, reverse=True):
        least[sets[i]] = i
    classes = sorted((i, a) for a, i in least.items() if a)
    want = [(i, j) for n, (j, b) in enumerate(classes) for i, a in classes[:n] if 100 * len(a & b) >= 85 * len(a | b)]
    got = [tuple(r) for r in nearjoin.near_pairs(make(rows)).collect()]
    assert sorted(got) == sorted(want)
    assert len(got) > len({x for pair in got for x in pair})  # more than any forest has
    assert {r["doc_id"]: r["class_id"] for r in nearjoin.near_components(make(rows)).collect()} == {i: least[a] for i, a in sets.items()}
    assert nearjoin.near_pairs(make(ODD)).count() == 0 and nearjoin.near_pairs(make([])).count() == 0


def test_odd_and_empty(make):
    check(make, ODD + [(30 + i, t) for i, t in enumerate(thue_morse(1024) * 2 + thue_morse(2048))], 4, 85)
    assert nearjoin.near_components(make([])).count() == 0


def test_hot_group(make):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):
        words = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            words[rng.randrange(120)] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    check(make, rows, 4, 85)


def test_long_sets_that_share_nothing_part(make, spark):
    rng = random.Random(6)
    docs = make([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000 + 40 * (i % 9)))) for i in range(24)] + [(30 + i, " ".join(f"x{j}" for j in range(60)) + f" {i}") for i in range(4)])
    sets = nearjoin.set_table(docs, 5)
    classes = sets.select("fa", "fb", "n", F.col("doc_id").alias("class_id"), "shape")
    chain = spark.createDataFrame([(1, i + 1, i) for i in range(23)] + [(2, 31, 30), (2, 32, 31), (2, 33, 32)], "instance long, u long, v long")
    assert {r["doc_id"] for r in nearjoin.clusters(chain, classes, 80).collect()} == {30, 31, 32, 33}


def test_shapes_of_other_cells_bound_the_difference():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2**64 - 1, n, dtype=np.uint64)) for n in (1, 250, 260, 1020, 1030, 5000)]
    made = nearjoin._shapes(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])).to_pylist()
    assert [len(x) // 2 for x in made] == [64, 64, 128, 256, 512, 2048]
    like = nearjoin._in_like_cells(made)
    for i, x in enumerate(sets):
        cells = (x >> np.uint64(32)).astype(np.int64) * 64 >> 32
        assert like[i].tolist() == np.bincount(cells, minlength=64).tolist()


def test_copies_go_in_rounds(make, monkeypatch):
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(200)]
    for i in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"v{i}"
        rows.append((i, " ".join(words)))
    moved, made = [], common.in_arrow

    def seen(df, run, schema):
        if "codes" in df.columns and "_key" in df.columns:
            moved.append(df.agg(F.sum(F.size("codes"))).first()[0] or 0)
        return made(df, run, schema)

    monkeypatch.setattr(common, "in_arrow", seen)
    monkeypatch.setattr(nearjoin, "BLOCK_ELEMENTS", 1000)
    monkeypatch.setattr(nearjoin, "BLOCK_DOCS", 7)
    monkeypatch.setattr(nearjoin, "ROUND_ELEMENTS", 0, raising=False)
    check(make, rows, 5, 80)
    whole = sum(len(shingles(t, 5)) for _, t in rows)  # a round copies as many elements as all sets have, about
    assert sum(moved) > 10 * whole and max(moved) < 3 * whole


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**6), st.sampled_from([80, 85]))
def test_similar_sets_share_a_signature(size, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    drop = int(rng.integers(0, len(a) // 4 + 1))
    b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 5 + 1)), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
        sig, owner, _ = nearjoin.PartEnum(percent).signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_words_and_shingles():
    texts = [t.encode() for t in ("", "A b  c", "x y z\x1fq", " lead", "same same same same same")]
    hashes, offsets = word_hashes(texts)
    words = [x.lower().split() for x in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert len(set(flat)) == len(set(hashes.tolist())) and {a: b for a, b in zip(flat, hashes.tolist())}[b"same"] == hashes[-1]
    _, offsets = shingle_sets(texts, 4)
    assert np.diff(offsets).tolist() == [len(shingles(t.decode(), 4)) for t in texts]


def test_words_that_polynomials_confuse():
    words = [x.encode() for n in (32, 64, 65, 1024, 2048) for x in thue_morse(n)]
    hashes, _ = word_hashes([*words, *(w.upper() for w in words)])
    assert len(set(hashes.tolist())) == len(words) and hashes[: len(words)].tolist() == hashes[len(words) :].tolist()


def test_ranges_grow(make, monkeypatch):
    monkeypatch.setattr(nearjoin, "RANGE_SIGNATURES", 7)
    check(make, corpus(5), 4, 85)


def test_words_by_pieces(monkeypatch):
    texts = [b"some words of \t several lengths", b"", b"x" * 50 + b" y", b" "]
    whole = shingles_module.word_spans(texts)
    monkeypatch.setattr(shingles_module, "PIECE", 5)
    for a, b in zip(whole, shingles_module.word_spans(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_components(spark):
    chain = [(i + 1, i) for i in range(100, 130)] + [(500, 400), (600, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {400: 400, 500: 400, 600: 400}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_scratch_files_start_one_process_each_and_are_tested(spark):
    got = common.stored(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1), "plain")
    path = got.inputFiles()[0].removeprefix("file://")
    made = os.listdir(os.path.dirname(path))
    assert len([x for x in made if "part-" in x]) == 1 and not [x for x in made if x.endswith(".crc")]
    assert got.agg(F.sum("id"), F.count("s")).first()[:] == (19_999 * 10_000, 20_000)
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        got.agg(F.sum("id"), F.max("s")).first()


def test_rounds_write_few_files(spark, monkeypatch):
    tables, made = [], common.stored

    def seen(df, name, **more):
        tables.append(made(df, name, **more))
        return tables[-1]

    monkeypatch.setattr(common, "stored", seen)
    for key, value in {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(key, value)
    try:
        got = components(spark.range(300).selectExpr("id + 1 as u", "0L as v"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tables) == 2 and len(tables[1].inputFiles()) <= 8  # a star is done in one round
    assert {r["node"]: r["component"] for r in got.collect()} == dict.fromkeys(range(301), 0)
