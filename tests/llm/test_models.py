"""Scores, severities, licences, leaks, lines and tokens: against plain Python, exact round trips, held-out accuracy."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddities import ODD, PlainTrie, thue_morse
from tidemark.llm import decontaminate, licenses, linededup, ppm, tokens, toxicity

SF = "/root/testdata/sf0.001"


# -- language model ---------------------------------------------------------------------------------------------------


def prose(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["an", "ab ba", "Abba.", "é", "xyz", "nan\n"]) for _ in range(rng.randrange(30)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"order": 2, "top_words": 2}, {"order": 0, "top_words": 0}])
def test_scores(make, options):
    rows = prose(1, 60) + ODD + [(30 + i, t) for i, t in enumerate(thue_morse(1024) + thue_morse(2048))]
    got = sorted(ppm.score(make(rows), **options).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"]))
    trie, counts, texts = PlainTrie(options.get("order", ppm.ORDER)), Counter(), 0
    kept = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    for i, t in rows:
        if kept(i):
            trie.learn((t or "").encode())
            counts.update((t or "").encode().lower().split())
            texts += 1
    n = sum(counts.values()) + texts
    whole = n + 0.5 * (len(counts) + 2)
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((counts[x] + 0.5) / whole) for x in w) + math.log10((texts + 0.5) / whole)
        want.append((i, not kept(i), len(w) + 1, 1 + sum(counts[x] > 0 for x in w), n, base, trie.score((t or "").encode())))
    want.sort(key=lambda r: (str(r[0]), r[2], r[6]))
    for r, x in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:5]
        assert r["base_score"] == pytest.approx(x[5]) and r["score"] == pytest.approx(x[6])


def test_model_is_a_probability():
    trie = ppm.Trie(3)
    for i, t in prose(2, 10):
        trie.score(t.encode(), adaptive=True)
    for before in ([], [97], [97, 98, 98], [1, 2, 3], [*b"nan"]):
        assert sum(10 ** trie.log10(before, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_adaptive_and_untrained(make):
    rows = prose(3, 80)
    adaptive = {r["doc_id"]: r["score"] for r in ppm.score_adaptively(make(rows)).collect()}
    assert adaptive[5] == pytest.approx(ppm.Trie().score(rows[5][1].encode(), adaptive=True))
    assert ppm.score(make([])).count() == 0
    only_held_out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ppm.score(make([(only_held_out, "ab")])).first()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["score"] == pytest.approx(-3 * math.log10(257))


@pytest.mark.parametrize(("top_grams", "held"), [(0, 100), (3000, 2000)])
def test_no_gram_is_left_out(make, monkeypatch, top_grams, held):
    """Many more grams than are broadcast or held by a worker: all of them count."""
    monkeypatch.setattr(ppm, "HELD", held)
    data = np.random.default_rng(6).integers(97, 123, (20, 1500)).astype(np.uint8)
    rows = [(i, x.tobytes().decode()) for i, x in enumerate(data)] + prose(5, 40)
    trie = PlainTrie(ppm.ORDER)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            trie.learn(t.encode())
    got = Counter(round(r["score"], 6) for r in ppm.score(make(rows), top_grams=top_grams).collect())
    want = [trie.score(t.encode()) for _, t in rows]
    assert sorted(got.elements()) == pytest.approx(sorted(want), abs=1e-5)


def test_pieces(monkeypatch):
    texts = [t.encode() for _, t in prose(4, 20)] + [b"ab ba nan " * 50]
    keys = np.sort(np.concatenate([*ppm.grams(texts, 4)]))
    monkeypatch.setattr(ppm, "PIECE", 7)
    assert (np.sort(np.concatenate([*ppm.grams(texts, 4)])) == keys).all()


# -- toxicity ---------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    few = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    found = toxicity.toxicity(docs, few).withColumnRenamed("toxic", "said")
    rest = found.join(labels.join(few.select("doc_id"), "doc_id", "left_anti"), "doc_id").collect()
    caught = [r for r in rest if r["toxic"]]
    assert sum(r["said"] for r in caught) > 0.85 * len(caught)
    assert sum(r["said"] for r in rest if not r["toxic"]) < 0.005 * len(rest)
    assert all(0 <= r["expected_severity"] <= 3 and r["said"] == (r["severity"] >= 1) for r in rest)


def test_ordinal_model_recovers_thresholds():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    s = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=4000)
    w, cuts = toxicity.fit_ordinal(x, np.digitize(s, [0.0, 1.0, 2.5]), 4)
    assert w == pytest.approx([2.0, -1.0, 0.5], abs=0.2) and cuts == pytest.approx([0.0, 1.0, 2.5], abs=0.25)


def test_scores_equal_plain_python(spark, make):
    """Features, sums and severities against dictionaries and loops."""
    import re

    weights = {b"grim$": 1.5, b"vilef": 0.75, b"vilefo": -0.25, b"caf\xc3\xa9$": 2.0, b"word$": -0.5}
    cuts = [0.5, 1.25, 2.0]
    rows = [(1, "Grim GRIM vilefoul, vilefox grim."), (2, "café words word"), (3, "vile file"), *ODD]
    model = toxicity.Model(weights, np.array(cuts))
    got = sorted((tuple(r) for r in toxicity.graded(make(rows).select("doc_id", "text"), model).drop("text").collect()), key=repr)
    want = []
    for i, t in rows:
        seen = {}
        for word in re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower()):
            for f in [word + b"$"] + [word[:k] for k in range(5, 10) if k <= len(word)]:
                seen[f] = seen.get(f, 0) + 1
        x = sum(w * math.log1p(seen.get(f, 0)) for f, w in weights.items())
        p = [1 / (1 + math.exp(c - x)) for c in cuts]
        want.append((i, sum(p), sum(y >= 0.5 for y in p), p[0], p[0] >= 0.5))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a == pytest.approx(b)


def test_sample_of_repeated_ids(spark, make):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = [(5, f"text {i}") for i in range(9)] + [(6, None), (6, "b")]
    one = [tuple(r) for r in toxicity.labelled_sample(make(rows), labels, 9).orderBy("doc_id").collect()]
    two = [tuple(r) for r in toxicity.labelled_sample(make(rows[::-1]).repartition(5), labels, 9).orderBy("doc_id").collect()]
    assert one == two and len(one) == 2


def test_toxicity_of_odd_input(spark, make):
    labels = spark.createDataFrame([(i, 1, t) for i, t in [(4, 0), (5, 1), (5, None), (None, 1), (999, 1)]], "doc_id bigint, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        got = toxicity.toxicity(make(ODD), marks).collect()
        assert len(got) == len(ODD) and not any(r["toxic"] for r in got)
    kept = toxicity.without_toxic(make(ODD, "severity"), labels)
    assert kept.columns == make(ODD, "severity").columns and kept.count() == len(ODD)
    assert toxicity.toxicity(make([]), labels).count() == 0


# -- licences ---------------------------------------------------------------------------------------------------------


def test_licences(make):
    notices = [
        ("Released under the MIT License.", "MIT"), ("licensed under the APACHE License, version 2.0", "Apache-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("All rights reserved.", "Proprietary"), ("SPDX-License-Identifier: BSD-3-Clause license", "BSD"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GPL"),
        ("You lost your license to drive under the new act.", None), ("The general public is not in the library.", None), ("MIT", None),
    ]
    rows = [(100 + i, f"Some prose of no note.\n{n}\nThe end.") for i, (n, _) in enumerate(notices)] + ODD + [(90, "Released under the MIT License.\nAll rights reserved.")]
    got = {r["doc_id"]: r for r in licenses.licenses(make(rows)).collect() if r["doc_id"] is not None}
    assert {i: got[i]["family"] for i in range(100, 100 + len(notices))} == {100 + i: f for i, (_, f) in enumerate(notices)}
    assert got[90]["families"] == ["MIT", "Proprietary"] and got[90]["n_licensed"] == 2
    assert all(got[i]["family"] is None and got[i]["families"] == [] for i in range(1, 11)) and got[1]["n_paragraphs"] == 0
    assert licenses.licenses(make([])).count() == 0
    wrapped = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    r = licenses.licenses(make([(1, f"int x;\n{wrapped}\nint y;")])).first()
    assert r["families"] == ["GPL"] and (r["n_licensed"], r["n_paragraphs"]) == (1, 7)


def test_licence_scan_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = {"GNU General Public": "GPL", "All rights reserved": "Proprietary", "CC BY-NC 4.0": "CC-BY-NC", "MIT License": "MIT", "Apache License": "Apache-2.0"}
    want = {r["doc_id"]: sorted({f for n, f in names.items() if n in r["text"]}) for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["families"] for r in licenses.licenses(docs).collect()} == want


# -- leaks ------------------------------------------------------------------------------------------------------------


def test_common_length():
    def plain(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(row[-1], best[j + 1]))
            best = row
        return best[-1]

    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontaminate.common_length(a, b) == plain(a.tolist(), b.tolist())


def test_recall_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    tokens_of = lambda t: decontaminate._hashed([t.lower().encode()])[0].tolist()
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    asked = {r["item_id"]: grams(tokens_of(r["text"])) for r in items.collect()}
    want = {(r["doc_id"], i) for r in docs.select("doc_id", "text").collect() for w in [grams(tokens_of(r["text"]))] for i, g in asked.items() if len(g & w) >= 0.9 * len(g)}
    assert len(want) > 5 and len(got & want) >= 0.9 * len(want) and not got - want


def test_paraphrases_and_odd_items(spark, make):
    rng = random.Random(8)
    fresh = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, fresh(rng.choice([8, 20, 40, 150]))) for i in range(30)]
    rows = []
    for i, w in items:
        spoilt = list(w)
        for _ in range(len(w) // 8):
            spoilt[rng.randrange(len(w) * 2 // 3)] = "other"
        rows += [(10 * i, " ".join(fresh(90) + [x.upper() for x in w] + fresh(70))), (10 * i + 1, " ".join(fresh(30) + spoilt + fresh(30))), (10 * i + 2, " ".join(fresh(200)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, " .,! ")], "item_id bigint, text string")
    found = decontaminate.leaks(make(rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert all((10 * i, i) in got for i, _ in items) and sum((10 * i + 1, i) in got for i, _ in items) >= 28
    assert all(d // 10 == i and d % 10 < 2 for d, i in got)
    kept = decontaminate.without_leaks(make(rows), bench)
    assert kept.columns == make(rows).columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    parts = decontaminate.leaks(make(rows), bench, items_at_once=12)  # a benchmark in three parts
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} >= {(10 * i, i) for i, _ in items}
    assert decontaminate.leaks(make(ODD), bench).count() == 0
    assert decontaminate.leaks(make([]), bench).count() == 0 and decontaminate.leaks(make(rows), bench.limit(0)).count() == 0


def zipf_corpus(seed, n_items, n_docs):
    """(items of 15 to 59 words, documents of which some hold an item, (doc_id, item_id) of exact copies)."""
    rng = np.random.default_rng(seed)
    text = lambda n: [f"w{x}" for x in rng.zipf(1.2, n) % 50_000]
    items = [(i, text(rng.integers(15, 60))) for i in range(n_items)]
    docs, exact = [], set()
    for d in range(n_docs):
        words = text(rng.integers(60, 300))
        if d % 10 == 0:
            i, item = items[(d // 10) % n_items]
            at = int(rng.integers(0, len(words)))
            words[at:at] = item
            exact.add((d, i))
        docs.append((d, " ".join(words)))
    return [(i, " ".join(t)) for i, t in items], docs, exact


@pytest.mark.parametrize("least_cosine", [decontaminate.LEAST_COSINE, 2.0])
def test_no_exact_copy_hangs_on_the_cosine(spark, make, least_cosine):
    items, docs, exact = zipf_corpus(9, 200, 2000)
    found = decontaminate.leaks(make(docs), spark.createDataFrame(items, "item_id bigint, text string"), least_cosine=least_cosine)
    assert exact <= {(r["doc_id"], r["item_id"]) for r in found.collect()}


# -- lines ------------------------------------------------------------------------------------------------------------


def lines_kept(rows, min_docs, min_chars):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").encode().split(b"\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").encode().split(b"\n")
        kept = [x for x in lines if seen[key(x)] < min_docs or len(key(x).decode()) < min_chars]
        out.append((r[0], b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_chars", "most_broadcast"), [(1, 10**6), (3, 10**6), (1, 0)])
def test_line_dedup(make, min_chars, most_broadcast):
    rng = random.Random(2)
    pool = ["A line", "a LINE ", "\ta line", "", "  ", "é", "É", "x"] + [f"l{i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(120)] + ODD
    found = linededup.dedup_lines(make(rows), min_docs=4, min_chars=min_chars, batches=5, fanout=2, most_broadcast=most_broadcast)
    assert found.columns == [*make(rows).columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()), key=repr) == lines_kept(rows, 4, min_chars)


@pytest.mark.parametrize("most_broadcast", [10**6, 0])
def test_lines_of_clashing_columns(make, most_broadcast):
    clashing = ["c0", "_kept", "_lines", "_gone", "_of", "_keys", "hi", "lo", "kept", "batch"]
    rows = [(i, f"same\nown {i}") for i in range(12)]
    found = linededup.dedup_lines(make(rows, *clashing, "n_lines", "n_dropped"), most_broadcast=most_broadcast)
    assert found.columns == [*make(rows, *clashing).columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["n_dropped"], r["_kept"]) for r in found.collect()) == [(i, f"own {i}", 1, "x") for i in range(12)]
    assert linededup.dedup_lines(make([(7, "same")] * 12)).filter("n_dropped = 1").count() == 12  # a row is a document


def test_line_runs(spark, make):
    runs = linededup.LineRuns(spark, 3, fanout=2)
    for n in (1, 2, 5, 1, 1):
        runs.add(spark.createDataFrame([(7, 7, n), (8, n, 1)], "hi long, lo long, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted((r["hi"], r["lo"]) for r in runs.frequent().collect()) == [(7, 7), (8, 1)]
    assert linededup.LineRuns(spark, 3).frequent().count() == 0
    assert linededup.dedup_lines(make([])).count() == 0


# -- tokens -----------------------------------------------------------------------------------------------------------


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("by_word", [True, False])
def test_tokens(make, by_word):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path())
    rows = [*ODD, *((30 + i, t) for i, t in enumerate(thue_morse(1024) + thue_morse(2048))), (20, "W̊ẘ ẘ I'LL don't 12.5 a,b. Ther. THER, ther\x85x　y\x1cz İ"), (21, "Über, straße. ÜBER a<|b")]
    got = tokens.token_table(make(rows), path(), by_word=by_word).orderBy("start").collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
    want = {}
    for i, t in rows:
        x = ids(t)
        want.setdefault(i, []).append((len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    at, found = 0, {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert found == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert tokens.token_table(make([]), path()).count() == 0


def test_orc_prunes(spark, make, tmp_path):
    with open(path(), encoding="utf-8") as f:
        tokens.write_tokens(make([(i, f"word {i}") for i in range(5000)]), f"file://{tmp_path}/t", f.read())
    stored = tokens.read_tokens(spark, f"file://{tmp_path}/t")
    one = stored.filter(F.col("doc_id") == 1234)
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    assert [r["doc_id"] for r in stored.orderBy("seq").collect()] == list(range(5000))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # of the file that may hold the id, one row group is read
        plan = one.select("seq")._jdf.queryExecution().executedPlan()
        assert plan.executeCollect()[0] is not None
        assert 0 < plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= tokens.ROW_GROUP
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    jvm, filled = spark.sparkContext._jvm, 0
    for file in tmp_path.joinpath("t").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == tokens.ROW_GROUP
        if reader.getNumberOfRows():
            every = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
            for i in range(len(every)):
                every[i] = True
            index = reader.rows().readRowIndex(0, every, every)
            column = reader.getSchema().findSubtype("doc_id").getId()
            assert index.getRowGroupIndex()[column].getEntryCount() == -(-reader.getNumberOfRows() // tokens.ROW_GROUP)
            assert index.getBloomFilterIndex()[column].getBloomFilterCount() == index.getRowGroupIndex()[column].getEntryCount()
            filled += 1
    assert filled


def test_small_cache():
    with open(path(), encoding="utf-8") as f:
        text = f.read()
    coder, whole = tokens.WordEncoder(text, limit=5), tokens.TextEncoder(text)
    for texts in ([b"a b c d e f g h", b""], [b"b c x y"], [b"a. B, c<|endoftext|>d"]):
        a, b = coder.encode(texts), whole.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-2]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0.5 * sizes[0]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ids = {r["doc_id"] for r in got.collect()}
    assert ids <= {r["doc_id"] for r in now.select("doc_id").collect()} and len(ids) > 0.5 * sizes[-1]


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(25) for _ in range(8)]
    clean = {i: text(rng.randrange(60, 120)) for i in range(300)}
    toxic = {400 + i: [*text(40), "vilefoul", "grimcurse", "vilefoul", *text(40)] for i in range(60)}
    copies = {500 + i: [*clean[i][:-1], "changed"] for i in range(30)} | {600 + i: clean[i] for i in range(20)}
    leaked = {700 + i: [*text(30), *item, *text(30)] for i, item in enumerate(items)}
    rows = [(i, " ".join(t), "en", "abc"[i % 3], 0) for i, t in (clean | toxic | copies | leaked).items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i for i, *_ in rows}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], (toxic, copies, leaked), strict=True):
        now, left = stage(spark, now, str(tmp_path)).cache(), left - set(gone)
        assert sorted(r["doc_id"] for r in now.collect()) == sorted(left), name
    library, want = Tokenizer.from_file(path()), []
    for r in corpus_pipeline.mix_sources(spark, now, str(tmp_path)).collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [tokens.END_ID]
        want.append((r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]


def odd_tables(spark, folder, rows, columns=""):
    """Tables of a pipeline run: documents (doc_id, text, source, and further string columns), labels, benchmark."""
    extra = [c for c in columns.split() if c]
    full = [(i, t, "en", "abc"[n % 3], 0, *("x" for _ in extra)) for n, (i, t) in enumerate(rows)]
    schema = ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{c} string" for c in extra)])
    spark.createDataFrame(full, schema).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the benchmark asks how many of the seven ships came home that year"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


CLASHING = "tokens size _pass _doc_id _source _key _gone _id component_id n_shingles slot at toxic severity ids seq start n_tokens c0 _row"


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    leak = "some words first " + "the benchmark asks how many of the seven ships came home that year" + " and then some more"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [*ODD, (None, leak), (80, leak), (81, long), (None, long), (None, long), (82, long), (82, "another text of that id entirely")]
    folder = odd_tables(spark, tmp_path, rows, CLASHING)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, folder).cache()
        assert now.columns == columns
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert [i for i, t in left if t == long] == [81] and (82, "another text of that id entirely") in left
    assert not any(t == leak for _, t in left) and [i for i, t in left if t == "one"] == [4]
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert {r["doc_id"] for r in got} <= {i for i, _ in left}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0
