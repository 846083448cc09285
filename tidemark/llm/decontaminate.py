"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Terms are lower-cased runs of letters and digits. The term space is the benchmark's: other terms can't add to a product
with an item. Terms of more than ``STOP_SHARE`` of the items are left out of it, but an item keeps its rarest ones.
Documents are cut into passages: windows of 2 and of 4 blocks of 16 tokens, each stepping by half its width; an item is
sought among the narrow or the wide ones by its length, a long item by its parts.

1. A pass finds the benchmark's terms in all texts; what it finds is written and read by the following ones.
2. Blocks that have a term are counted over all documents: inverse document frequencies.
3. Randomised SVD of the TF-IDF matrix A of all wide passages: workers add up A'(A G) for a Gaussian G, sums meet by
   term, and the driver gets the (terms x rank) sketch, whose Nystroem form gives the leading singular vectors.
4. Every passage is projected; its score with an item is their cosine among the singular vectors times the share of the
   passage's length that lies in the term space, where a token that is no term counts ``OTHER`` of a mean term. Passages
   that reach ``LEAST_COSINE`` are candidates. So are, whatever their cosine, those from which on a stretch long enough for
   the part holds half of the part's ANCHORS rarest terms: a verbatim copy holds them all and never hangs on the cosine.
5. A candidate's neighbourhood in the text is compared with the item word by word: it is contaminated where the longest
   common subsequence holds ``SURE`` of the item's words, or ``LIKELY`` of them and the answer (the item's last sentence)
   almost whole.

The benchmark is the stated query set. Its items are held on the driver and broadcast, ITEMS_AT_ONCE or so of them: a larger
benchmark is dealt into parts by hash, and the documents are searched for one part after another.

A score is a cosine times a share, so a passage whose share is below ``LEAST_COSINE`` isn't projected at all; that changes
no result. Products of passages and items are made in blocks of BLOCK_CELLS.

Defined cases: null, empty and termless texts match nothing, items without terms are skipped; a (doc_id, item) is
reported once, with its best match; equal rows match alike; null ids are reported as null; empty tables give an empty
result. Columns besides doc_id and text pass through ``without_leaks``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import MARKS, word_spans

BLOCK, NARROW, WIDE = 16, 2, 4
#: Items of up to so many tokens are sought among narrow passages; longer ones in parts of PART tokens among wide ones.
SHORT, PART = 32, 64
STOP_SHARE, KEPT_TERMS = 0.05, 4
RANK, SPARE = 64, 8
LEAST_COSINE = 0.35
OTHER = 0.5
#: The rarest terms of an item's part, of which a passage shares half or more to be a candidate by them.
ANCHORS = 8
SURE, LIKELY, ANSWER = 0.75, 0.55, 0.8
ITEMS_AT_ONCE = 50_000
#: Cells of a block of products of passages and items (4 bytes each).
BLOCK_CELLS = 2_000_000
#: Up to so many candidates their ids and places (16 bytes each) are broadcast to pick texts; beyond, texts are joined.
MOST_BROADCAST = 500_000


@dataclass
class Benchmark:
    """The items' tokens as hashes, the term space (sorted hashes), and the parts that are sought: (item, tokens, wide or not)."""

    ids: list
    tokens: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    parts: list[tuple[int, np.ndarray, bool]]


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    _, _, _, hashes, offsets = word_spans(texts, MARKS)
    return [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _answer(text: bytes) -> bytes:
    """The last sentence of at least three words, else the last third of the words."""
    sentences = [x for x in text.replace(b"!", b".").replace(b"?", b".").split(b".") if len(x.split()) >= 3]
    words = text.split()
    return sentences[-1] if len(sentences) > 1 else b" ".join(words[-max(3, len(words) // 3) :])


def read_benchmark(items: DataFrame) -> Benchmark:
    """The items of a part, which a driver can hold."""
    rows = items.select("item_id", F.lower("text").alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text").collect()
    texts = [r["text"].encode() for r in rows]
    tokens, answers = _hashed(texts), _hashed([_answer(t) for t in texts])
    known = [np.unique(t) for t in tokens]
    every, shared = np.unique(np.concatenate([*known, np.zeros(0, np.uint64)]), return_counts=True)
    stop = every[shared > max(STOP_SHARE * len(texts), 2)]
    chosen = []
    for t in known:
        content = t[~np.isin(t, stop)]
        if len(content) < KEPT_TERMS:
            content = t[np.argsort(shared[np.searchsorted(every, t)], kind="stable")[:KEPT_TERMS]]
        chosen.append(content)
    terms = np.unique(np.concatenate([*chosen, np.zeros(0, np.uint64)]))
    parts = []
    for i, t in enumerate(tokens):
        if len(t):
            n = max(1, round(len(t) / PART))
            parts += [(i, part, len(t) > SHORT) for part in np.array_split(t, n)]
    return Benchmark([r["item_id"] for r in rows], tokens, answers, terms, parts)


def _places(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the hashes that are terms, which terms)."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == hashes)
    return hit, at[hit]


def found_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, at, term, tokens): places among a document's tokens of the benchmark's terms, and their number. Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(batches, "doc_id"):
            _, _, _, hashes, offsets = word_spans(texts, MARKS)
            hit, term = _places(shared.value, hashes)
            cuts = np.searchsorted(hit, offsets)
            inside = hit - np.repeat(offsets[:-1], np.diff(cuts))
            ends = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (inside, term)]
            yield pa.RecordBatch.from_arrays([ids, *lists, pa.array(np.diff(offsets))], names=["doc_id", "at", "term", "tokens"])

    found = common.in_arrow(docs.select("doc_id", F.lower("text").alias("text")), run, f"doc_id {kind}, at array<int>, term array<int>, tokens long")
    found = common.stored(found, "benchmark-terms")
    shared.unpersist()
    return found


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's row, block, term) of each occurrence in a batch."""
    at, term = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "term"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    return row, at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) // BLOCK, term.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


_ROW = 1 << 32


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of a sorted array, number among them of each entry)."""
    head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    return key[head], np.cumsum(head) - 1


def frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """Inverse document frequencies of the terms over all blocks that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            row, block, term = _entries(batch)
            blocks, number = _numbered(row * _ROW + block)
            total[:n_terms] += np.bincount(np.unique(number * n_terms + term) % n_terms, minlength=n_terms)
            total[n_terms] += len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "n"])

    sums = common.in_arrow(found.select("at", "term"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(n_terms + 1)
    count[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return np.log((1 + count[n_terms]) / (1 + count[:n_terms])) + 1


def _windows(row: np.ndarray, block: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages, number of the passage and term of each occurrence in one). Passage p of ``width`` blocks starts at block p * width / 2."""
    halves, number = _numbered(row * _ROW + block // (width // 2))
    inner = halves % _ROW > 0
    passages = np.unique(np.concatenate([halves, halves[inner] - 1]))
    own, before = np.searchsorted(passages, halves)[number], np.searchsorted(passages, halves - 1)[number]
    twice = inner[number]
    return passages, np.concatenate([own, before[twice]]), np.concatenate([term, term[twice]])


def _weighted(number: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1: (first entry of each, terms, values, length before, occurrences). Every row has an entry."""
    cell, times = np.unique(number * len(idf) + term, return_counts=True)
    row, term = cell // len(idf), cell % len(idf)
    value = (1 + np.log(times)) * idf[term]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    norm = np.sqrt(np.add.reduceat(value**2, first)) if len(first) else np.zeros(0)
    return first, term, value / np.repeat(norm, np.diff(np.append(first, len(row)))), norm, np.add.reduceat(times, first) if len(first) else first


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` up to the next, none without a row: eight are added up at a time, then their sums."""
    sizes = np.diff(np.append(first, len(rows)))
    pieces = -(-sizes // 8)
    of, heads = np.repeat(np.arange(len(first)), pieces), np.cumsum(pieces) - pieces
    begin = first[of] + 8 * (np.arange(len(of)) - heads[of])
    length = np.minimum(8, (first + sizes)[of] - begin)
    order = np.argsort(-length, kind="stable")
    begin = begin[order]
    total = rows[begin]
    for k in range(1, 8):
        n = int((length > k).sum())
        if not n:
            break
        total[:n] += rows[begin[:n] + k]
    out = np.empty_like(total)
    out[order] = total
    return out if len(of) == len(first) else _sums(out, heads)


def _projected(first: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows times ``basis``, some rows at a time."""
    out, ends = np.zeros((len(first), basis.shape[1]), np.float32), np.append(first, len(term))
    value = value.astype(np.float32)
    for a in range(0, len(first), 1024):
        b = min(a + 1024, len(first))
        part = slice(ends[a], ends[b])
        rows = basis[term[part]]
        rows *= value[part, None]
        out[a:b] = _sums(rows, first[a:b] - ends[a])
    return out


def _gaussian(n_terms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n_terms, RANK + SPARE)).astype(np.float32)


def singular_vectors(found: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """(terms x rank): leading right singular vectors of the TF-IDF matrix of all wide passages, over their singular values."""
    n_terms = len(idf)
    shared = found.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauss = _gaussian(n_terms, seed)
        total = np.zeros(gauss.shape, np.float32)
        for batch in batches:
            row, block, term = _entries(batch)
            first, term, value, _, _ = _weighted(*_windows(row, block, term, WIDE)[1:], shared.value)
            rows = _projected(first, term, value, gauss)
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
            value = value.astype(np.float32)
            for a in range(0, len(term), 20_000):
                some = a + np.argsort(term[a : a + 20_000], kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(term[some]) > 0]))
                weighted = rows[owner[some]]
                weighted *= value[some, None]
                total[term[some[head]]] += _sums(weighted, head)
        touched = np.flatnonzero(total.any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(touched) + 1) * total.shape[1], pa.int32()), pa.array(total[touched].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(touched), lists], names=["term", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.runs(batches, "term"):
            rows = group.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
            yield pa.RecordBatch.from_arrays([group.column("term").combine_chunks()[:1], pa.array([rows.sum(0, dtype=np.float64).astype(np.float32)])], names=["term", "sums"])

    parts = common.in_arrow(found.select("at", "term"), run, "term long, sums array<float>")
    sums = parts.repartition("term").sortWithinPartitions("term").mapInArrow(add, "term long, sums array<float>").toArrow()
    shared.unpersist()
    gauss, sketch = _gaussian(n_terms, seed).astype(np.float64), np.zeros((n_terms, RANK + SPARE))
    if sums.num_rows:
        sketch[sums.column("term").to_numpy()] = sums.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sums.num_rows, -1)
    core = gauss.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 0) * 1e-9
    if not good.any():
        return np.zeros((n_terms, 0), np.float32)
    left, size, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return (left[:, :RANK] / size[:RANK]).astype(np.float32)


def _anchors(number: np.ndarray, term: np.ndarray, n_parts: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by term, parts that have the term among their rarest, how many of them each part asks for)."""
    number, term = np.unique(np.stack([number, term]), axis=1)
    order = np.lexsort((term, -idf[term], number))
    number, term = number[order], term[order]
    few = np.arange(len(number)) - np.searchsorted(number, number) < ANCHORS
    number, term = number[few], term[few]
    by_term = np.lexsort((number, term))
    return np.searchsorted(term[by_term], np.arange(len(idf) + 1)), number[by_term], -(-np.bincount(number, minlength=n_parts) // 2)


def _sharing(row: np.ndarray, block: np.ndarray, term: np.ndarray, step: int, span: int, anchors: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(passage, part) where the ``span`` steps of blocks from the passage's first on share enough anchors with the part."""
    offsets, parts, need = anchors
    there = np.flatnonzero(offsets[term + 1] > offsets[term])
    half, back = block[there] // step, np.arange(span)
    inner = half[:, None] >= back
    stretches, number = np.unique(((row[there] * _ROW + half)[:, None] - back)[inner], return_inverse=True)
    terms = len(offsets) - 1
    cell = np.unique(number * terms + np.repeat(term[there], inner.sum(1)))
    number, term = cell // terms, cell % terms
    n = offsets[term + 1] - offsets[term]
    part = parts[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - offsets[term], n)]
    pair, shared = np.unique(np.repeat(number, n) * len(need) + part, return_counts=True)
    pair = pair[shared >= need[pair % len(need)]]
    return stretches[pair // len(need)], pair % len(need)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def candidates(found: DataFrame, bench: Benchmark, idf: np.ndarray, basis: np.ndarray, least: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, item, place, width, cosine): passages near an item's part, by first token; of overlapping ones all. Stored."""
    queries = {}
    for wide in (False, True):
        parts = [(i, t) for i, t, w in bench.parts if w == wide]
        key = np.concatenate([np.full(len(t), n) for n, (_, t) in enumerate(parts)] or [np.zeros(0, np.int64)])
        hit, term = _places(bench.terms, np.concatenate([t for _, t in parts] or [np.zeros(0, np.uint64)])) if len(bench.terms) else (np.zeros(0, np.int64),) * 2
        names, number = _numbered(key[hit].astype(np.int64))
        anchors = _anchors(number, term, len(names), idf)
        first, term, value, _, _ = _weighted(number, term, idf)
        queries[wide] = (np.array([parts[n][0] for n in names], np.int64), _unit(_projected(first, term, value, basis)), anchors)
    shared = found.sparkSession.sparkContext.broadcast((idf, basis, queries))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, queries = shared.value
        other = OTHER * idf.mean() ** 2
        for batch in batches:
            row, block, term = _entries(batch)
            tokens = batch.column(3).to_numpy(zero_copy_only=False)
            for wide, width, span in ((False, NARROW, 3), (True, WIDE, 4)):  # a part of 32 or of 95 tokens ends in so many steps
                items, wanted, anchors = queries[wide]
                if not len(items) or not len(term) or not basis.shape[1]:
                    continue
                key, number, terms = _windows(row, block, term, width)
                passage, part = _sharing(row, block, term, width // 2, span, anchors)
                spot = np.minimum(np.searchsorted(key, passage), len(key) - 1)
                spot, part = spot[key[spot] == passage], part[key[spot] == passage]
                first, terms, value, norm, times = _weighted(number, terms, idf)
                inside = np.minimum(width * BLOCK, tokens[key // _ROW] - (key % _ROW) * (width // 2) * BLOCK)
                share = norm / np.sqrt(norm**2 + other * np.maximum(inside - times, 0))
                worth = share >= least
                worth[spot] = True
                kept, renumbered = np.flatnonzero(worth), np.cumsum(worth) - 1
                entry = np.repeat(worth, np.diff(np.append(first, len(terms))))
                sizes = np.diff(np.append(first, len(terms)))[kept]
                first, terms, value = np.cumsum(sizes) - sizes, terms[entry], value[entry]
                key, share, spot = key[kept], share[kept].astype(np.float32), renumbered[spot]
                rows = max(1, min(4096, BLOCK_CELLS // len(items)))
                by_spot = np.argsort(spot, kind="stable")
                spot, part = spot[by_spot], part[by_spot]
                for a in range(0, len(key), rows):
                    b = min(a + rows, len(key))
                    some = slice(first[a], first[b] if b < len(first) else len(terms))
                    near = (_unit(_projected(first[a:b] - first[a], terms[some], value[some], basis)) * share[a:b, None]) @ wanted.T
                    chosen, here = near >= least, slice(*np.searchsorted(spot, (a, b)))
                    chosen[spot[here] - a, part[here]] = True
                    p, q = np.nonzero(chosen)
                    place = (key[a:b][p] % _ROW) * (width // 2) * BLOCK
                    if len(p):
                        columns = [batch.column(0).take(pa.array(key[a:b][p] // _ROW)), pa.array(items[q]), pa.array(place), pa.array(np.full(len(p), width * BLOCK)), pa.array(near[p, q].astype(np.float64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item", "place", "width", "cosine"])

    schema = f"doc_id {kind}, item long, place long, width long, cosine double"
    near = common.stored(common.in_arrow(found.select("doc_id", "at", "term", "tokens"), run, schema), "leak-candidates")
    shared.unpersist()
    return near


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for x in b.tolist():
        match = state & masks.get(x, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def confirmed(docs: DataFrame, found: DataFrame, bench: Benchmark) -> DataFrame:
    """(doc_id, item, cosine, overlap, answer): candidates whose texts bear them out."""
    near = F.collect_list(F.struct("item", "place", "width", "cosine"))
    by_doc = found.groupBy(F.col("doc_id").alias("_of")).agg(near.alias("near"))
    if found.count() <= MOST_BROADCAST:
        by_doc = F.broadcast(by_doc)
    rows = docs.select("doc_id", F.lower("text").alias("text")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_of"))).select("doc_id", "text", "near")
    shared = docs.sparkSession.sparkContext.broadcast((bench.tokens, bench.answers))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, answers = shared.value
        for batch in batches:
            at = 0
            for ids, texts in common.text_slices([batch], "doc_id"):
                lists = batch.column(2).slice(at, len(ids)).to_pylist()
                at += len(ids)
                out = []
                for i, (words, near) in enumerate(zip(_hashed(texts), lists, strict=True)):
                    best: dict[int, tuple] = {}
                    for x in near:
                        item = tokens[x["item"]]
                        around = len(item) if len(item) > PART else len(item) // 2
                        part = words[max(0, x["place"] - around) : x["place"] + x["width"] + around]
                        overlap = common_length(item, part) / len(item)
                        if overlap >= LIKELY:
                            answer = answers[x["item"]]
                            held = common_length(answer, part) / len(answer) if len(answer) else 0.0
                            if overlap >= SURE or held >= ANSWER:
                                best[x["item"]] = max(best.get(x["item"], (0.0, 0.0, 0.0)), (overlap, held, x["cosine"]))
                    out += [(i, item, c, o, h) for item, (o, h, c) in best.items()]
                columns = [ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.float64()) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item", "cosine", "overlap", "answer"])

    found = common.in_arrow(rows, run, f"doc_id {kind}, item long, cosine double, overlap double, answer double")
    return found.groupBy("doc_id", "item").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("answer").alias("answer"))


def _leaks_of(docs: DataFrame, items: DataFrame, least_cosine: float) -> DataFrame:
    spark = docs.sparkSession
    bench = read_benchmark(items)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(bench.ids)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    if not len(bench.terms):
        return docs.select("doc_id").limit(0).join(names.select("item_id").limit(0)).selectExpr("doc_id", "item_id", "0D AS cosine", "0D AS overlap", "0D AS answer")
    found = found_terms(docs, bench.terms)
    idf = frequencies(found, len(bench.terms))
    near = candidates(found, bench, idf, singular_vectors(found, idf), least_cosine)
    return confirmed(docs, near, bench).join(F.broadcast(names), "item").select("doc_id", "item_id", "cosine", "overlap", "answer")


def leaks(docs: DataFrame, items: DataFrame, *, least_cosine: float = LEAST_COSINE, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer): documents that hold a benchmark item, verbatim or paraphrased."""
    parts = -(-items.count() // items_at_once) or 1
    if parts == 1:
        return _leaks_of(docs, items, least_cosine)
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return functools.reduce(DataFrame.union, [_leaks_of(docs, items.filter(of == n), least_cosine) for n in range(parts)])


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item; those without an id stay."""
    return common.without(docs, leaks(docs, items, **options).select("doc_id"))
