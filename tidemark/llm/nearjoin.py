"""Self-join of texts by the Jaccard similarity of their word-shingle sets, with PartEnum signatures.

Set sizes fall into bands whose ends are a factor 1/threshold apart, so that similar sets lie in the same band or in
neighbouring ones; instance i holds bands i-1 and i. Similar sets of an instance differ in at most k elements. The
feature domain is partitioned into n1 parts, each into n2 sub-parts; with n1 * (k2 + 1) > k some part differs in at most
k2 elements, so one of the subsets of n2 - k2 of its sub-parts has equal content in both sets: each subset's content is
hashed to a signature, and similar sets share one. ``spare`` extra parts let signatures of fewer than LIGHT elements
(empty ones) be left out where a set has few parts with any, which keeps chance meetings rare without losing a pair.

Steps: one pass fingerprints the sets; a second one hashes them to signatures, links documents that share one inside a
batch and forwards one document for each signature; the signatures meet by instance and hash range and are linked
there; components of these candidate links, within an instance, are clusters. A cluster falls into parts by its sets'
shapes: how many elements they have in each of a number of cells of the domain, which grows with the set. Shapes differ by no
more than the sets do, so pairs whose shapes differ too much aren't similar. All pairs of a part are counted exactly. Both are
done in blocks of bounded size, every row being copied once for each block of its group; rounds bound the copies that are on
disk at once. The components of the true links, with the classes of equal sets put back, are the result of
``near_components``, which needs a spanning forest of them only; ``near_pairs`` returns them all. Candidates only cost time:
whatever shares no signature is not similar, whatever is not similar fails the exact count.

Defined cases: texts without words (null, empty, blank) have an empty set and are linked with nothing; equal sets are
linked; rows that share a doc_id are one node; rows with a null doc_id get a null component; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import mixed, shingle_sets

LIGHT = 1
#: Signatures of an instance that a range of hashes holds, about; the least number of ranges.
RANGE_SIGNATURES, SHARDS = 2_000_000, 16
#: Least cells of a shape, 2 bytes each, and elements in a cell at most: with more, unrelated sets have like shapes.
CELLS, CELL_ELEMENTS = 64, 4
#: Documents, and elements of their sets, in a block of a cluster, whose shapes are compared at once.
BLOCK_DOCS, BLOCK_SHAPED = 4096, 8_000_000
#: Elements of sets in a block of a part; a pair of blocks is counted at once.
BLOCK_ELEMENTS = 500_000
#: Elements (8 bytes each) that a round copies to pairs of blocks, if the elements of all sets aren't more.
ROUND_ELEMENTS = 50_000_000
#: Signatures that a worker holds before it links and forwards them.
HELD = 1_500_000
#: Up to so many documents of clusters their ids (8 bytes each) are broadcast to pick texts; beyond, texts are joined.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Scheme:
    """Signature parameters of one instance."""

    n1: int
    n2: int
    k2: int
    spare: int


class PartEnum:
    """Bands and signature schemes for a threshold of ``percent`` hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [0]  # last size of each band; band 0 is empty
        self.schemes: list[Scheme] = [Scheme(0, 1, 0, 0)]

    def _extend(self, size: int) -> None:
        while self.ends[-1] < size:
            end = (self.ends[-1] + 1) * 100 // self.percent
            self.ends.append(end)
            k = (100 - self.percent) * 2 * end // (100 + self.percent)
            if k == 0:
                scheme = Scheme(1, 1, 0, 0)
            else:
                need = -(-(k + 1) // 2)
                spare = 0 if need <= 4 else 1 + need // 8
                scheme = Scheme(need + spare, 3, 1, spare)
            self.schemes.append(scheme)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        self._extend(int(sizes.max(initial=0)))
        return np.searchsorted(np.array(self.ends), sizes, side="left")

    def scheme(self, instance: int) -> Scheme:
        while len(self.schemes) <= instance:
            self._extend(self.ends[-1] + 1)
        return self.schemes[instance]

    def signatures(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, index of the set that each is of, instance). Codes are sorted within each set."""
        sizes = np.diff(offsets)
        bands = self.band(sizes)
        found, owners, instances = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in (0, 1):
            for instance in np.unique(bands[bands > 0]) + step:
                sets = np.flatnonzero((bands + step == instance) & (bands > 0))
                sig, owner = self._of_instance(int(instance), codes, offsets[sets], sizes[sets])
                found.append(sig)
                owners.append(sets[owner])
                instances.append(np.full(len(sig), instance))
        return np.concatenate(found), np.concatenate(owners), np.concatenate(instances)

    def _of_instance(self, instance: int, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.scheme(instance)
        parts = s.n1 * s.n2
        row = np.repeat(np.arange(len(sizes)), sizes)
        x = codes[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]
        part = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cell = row * parts + part  # ascends, as codes do
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total, count = np.zeros(len(sizes) * parts, np.uint64), np.zeros(len(sizes) * parts, np.int32)
        with np.errstate(over="ignore"):
            total[cell[first]] = np.add.reduceat(mixed(x), first)
            count[cell[first]] = np.diff(np.append(first, len(cell)))
            total, count = total.reshape(-1, s.n1, s.n2), count.reshape(-1, s.n1, s.n2)
            subsets = list(combinations(range(s.n2), s.n2 - s.k2))
            content = np.stack([total[:, :, list(c)].sum(2, dtype=np.uint64) for c in subsets], 2)
            filled = np.stack([count[:, :, list(c)].sum(2) for c in subsets], 2)
            name = np.uint64(instance << 32) + np.arange(s.n1 * len(subsets), dtype=np.uint64).reshape(1, s.n1, -1)
            sig = mixed(content + mixed(name))
        heavy = filled >= LIGHT
        few = (~heavy).any(2).sum(1) <= s.spare if s.n1 > 1 or s.spare else heavy.all((1, 2))
        keep = heavy | ~few[:, None, None]
        return sig[keep], np.nonzero(keep)[0]


class Forest:
    """Union-find over arbitrary long ids; roots are least ids."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def link(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.root(a), self.root(b)
            if a != b:
                self.above[max(a, b)] = min(a, b)

    def edges(self) -> np.ndarray:
        """A link of each node to its root."""
        return np.array([(x, self.root(x)) for x in list(self.above)], np.int64).reshape(-1, 2)


def _meet(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct signatures in order, least document of each, links of other documents to it)."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    head = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
    leader = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else doc
    other = leader != doc
    return sig[head], doc[head], np.unique(np.stack([doc[other], leader[other]], 1), axis=0)


def _fingerprints(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set; 0 for empty ones."""
    full = np.diff(offsets) > 0
    with np.errstate(over="ignore"):
        sums = [np.add.reduceat(np.append(mixed(codes ^ np.uint64(salt)), np.uint64(0)), offsets[:-1]) for salt in (0, 0x5851F42D4C957F2D)]
    return tuple(np.where(full, x, np.uint64(0)).view(np.int64) for x in sums)


def _shapes(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Numbers of each set's elements in its cells (equal ranges of codes, a power of two times CELLS), as 16-bit integers."""
    sizes = np.diff(offsets)
    cells = CELLS << np.ceil(np.log2(np.maximum(sizes / (CELLS * CELL_ELEMENTS), 1))).astype(np.int64)
    ends = np.cumsum(cells)
    cell = np.repeat(ends - cells, sizes) + ((codes >> np.uint64(32)).astype(np.int64) * np.repeat(cells, sizes) >> 32)
    counts = np.minimum(np.bincount(cell, minlength=int(cells.sum())), 32767).astype("<i2")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends * 2).astype(np.int32)), pa.py_buffer(counts)])


def _in_like_cells(shapes: list[bytes]) -> np.ndarray:
    """A row for each shape, in as many cells as the smallest one has: cells of the others lie whole in one of its."""
    cells = min(map(len, shapes)) // 2
    return np.stack([np.frombuffer(x, "<i2").reshape(cells, -1).sum(1, dtype=np.int16) for x in shapes])


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fa, fb, shape): size, fingerprint and shape of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(batches, "doc_id"):
            codes, offsets = shingle_sets(texts, words)
            fa, fb = _fingerprints(codes, offsets)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(fa), pa.array(fb), _shapes(codes, offsets)], names=["doc_id", "n", "fa", "fb", "shape"])

    return common.stored(common.in_arrow(_texts(docs), run, "doc_id long, n long, fa long, fb long, shape binary"), "sets")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


_SIGNED = "instance long, shard long, sigs array<long>, docs array<long>, others array<long>"
_LONGS = pa.list_(pa.int64())


def _ranges(classes: DataFrame, percent: int) -> int:
    """How many ranges of hashes the signatures of the largest instance need."""
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent)))  # about a band
    sizes = {r["step"]: (r["docs"], r["n"]) for r in classes.groupBy(step.alias("step")).agg(F.count("*").alias("docs"), F.max("n").alias("n")).collect()}
    scheme, most = PartEnum(percent), 0
    for k, (docs, n) in sizes.items():
        s = scheme.scheme(int(scheme.band(np.array([n]))[0]))
        both = docs + max(sizes.get(k - 1, (0, 0))[0], sizes.get(k + 1, (0, 0))[0])
        most = max(most, both * s.n1 * len(list(combinations(range(s.n2), s.n2 - s.k2))))
    return max(SHARDS, -(-most // RANGE_SIGNATURES))


def _forwarded(sig: np.ndarray, doc: np.ndarray, instance: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of an instance: one document for each signature by shard, and (in shard 0) the links inside the batch, docs to others."""
    columns: list[list] = [[], [], [], [], []]
    order = np.argsort(instance, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(instance[order]) > 0, [True]])) if len(order) else np.zeros(1, int)
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[begin:end]
        number = int(instance[at[0]])
        heads, leaders, links = _meet(sig[at], doc[at])
        if len(links):
            forest = Forest()
            forest.link(links)
            links = forest.edges()
            for column, value in zip(columns, (number, 0, [], links[:, 0], links[:, 1]), strict=True):
                column.append(value)
        shard = (heads >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for column, value in zip(columns, (number, int(shard[a]), heads[a:b].view(np.int64), leaders[a:b], []), strict=True):
                column.append(value)
    arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, _LONGS) for c in columns[2:])]
    yield pa.RecordBatch.from_arrays(arrays, names=["instance", "shard", "sigs", "docs", "others"])


def candidate_links(docs: DataFrame, words: int, percent: int, ranges: int = SHARDS) -> DataFrame:
    """(instance, u, v): links that connect all documents of an instance that share a signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, held, n_held = PartEnum(percent), [], 0
        for ids, texts in common.text_slices(batches, "doc_id"):
            codes, offsets = shingle_sets(texts, words)
            sizes = np.diff(offsets)
            fa, fb = _fingerprints(codes, offsets)
            known = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((number, ~known, fb, fa))  # of equal sets only the least document goes on
            same = np.concatenate([[False], (fa[order][1:] == fa[order][:-1]) & (fb[order][1:] == fb[order][:-1])])
            known[order[same]] = False
            keep = np.flatnonzero(known)
            sig, owner, instance = scheme.signatures(codes[np.repeat(known, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
            held.append((sig, number[keep][owner], instance))
            n_held += len(sig)
            if n_held > HELD:
                yield from _forwarded(*map(np.concatenate, zip(*held, strict=True)), ranges)
                held, n_held = [], 0
        if n_held:
            yield from _forwarded(*map(np.concatenate, zip(*held, strict=True)), ranges)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.runs(batches, "instance"):
            forest = Forest()
            for part in common.runs(iter(rows.to_batches()), "shard"):
                sig, doc, other = (part.column(c).combine_chunks() for c in ("sigs", "docs", "others"))
                linked = pc.greater(pc.list_value_length(other), 0)
                u, v = (x.filter(linked).flatten().to_numpy(zero_copy_only=False) for x in (doc, other))
                forest.link(np.stack([u, v], 1))
                met = doc.filter(pc.invert(linked)).flatten().to_numpy(zero_copy_only=False)
                forest.link(_meet(sig.flatten().to_numpy(zero_copy_only=False), met)[2])
            links = forest.edges()
            if len(links):
                number = np.full(len(links), rows.column("instance")[0].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(links[:, 0]), pa.array(links[:, 1])], names=["instance", "u", "v"])

    rows = common.in_arrow(_texts(docs), sign, _SIGNED).repartition("instance", "shard").sortWithinPartitions("instance", "shard")
    return common.stored(common.in_arrow(rows, meet, "instance long, u long, v long"), "candidates")


def _links_of(ids: np.ndarray, codes: np.ndarray, offsets: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Links between a block's sets (side 0 with itself where there is no side 1, else side 0 with side 1), exactly counted."""
    sizes = np.diff(offsets)
    order = np.lexsort((ids, sizes))
    owner = np.empty(len(order), np.int64)
    owner[order] = np.arange(len(order))
    sizes, ids, side = sizes[order], ids[order], side[order]
    row = np.repeat(owner, np.diff(offsets))
    _, code, count = np.unique(codes, return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one set alone counts only in its size
    place = np.cumsum(shared) - 1
    keep = shared[code]
    row, bit = row[keep], place[code[keep]]
    table = np.zeros((len(sizes), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(table, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    apart, found = bool(side.any()), []
    for i in range(len(sizes) - 1):
        end = np.searchsorted(sizes * percent, sizes[i] * 100, side="right")
        j = np.arange(i + 1, end)
        if apart:
            j = j[side[j] != side[i]]
        if len(j):
            both = np.bitwise_count(table[i] & table[j]).sum(1, dtype=np.int64)
            j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
            found.append(np.stack([np.full(len(j), ids[i]), ids[j]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """The members (doc_id, cluster, ...) that links (cluster, u, v) connect with others, ``cluster`` now naming the component.

    Nodes are hashes of document and cluster; should two collide, their components are taken for one.
    """
    node = lambda c: F.xxhash64(F.col(c), "cluster")
    found = components(links.select(node("u").alias("u"), node("v").alias("v")))
    rows = members.withColumn("node", node("doc_id")).join(found, "node").drop("node", "cluster").withColumnRenamed("component", "cluster")
    several = common.stored(rows.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("elements")).filter("docs > 1"), "cluster-sizes")
    if several.count() <= MOST_BROADCAST:
        several = F.broadcast(several)  # else a hot cluster's rows would meet in one task
    return common.stored(rows.join(several, "cluster"), "clusters")


def _in_pairs_of_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row of (cluster, doc_id, ...) once for each block of its cluster, under the pair's ``_key``; ``side`` tells its block of two."""
    rows = rows.withColumn("_blocks", F.ceil(blocks).cast("long")).withColumn("_block", F.pmod(F.xxhash64("doc_id"), "_blocks"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.withColumn("_key", F.xxhash64("cluster", F.least("_block", "_other"), F.greatest("_block", "_other")))
    return rows.withColumn("side", (F.col("_block") > F.col("_other")).cast("long")).drop("_blocks", "_block", "_other")


def _compared(dealt: DataFrame, run, schema: str, name: str, amount: int, most: int) -> DataFrame:
    """``run`` over the groups by ``_key`` of ``dealt``, whose shuffle moves ``amount``: in rounds of about ``most``, each with keys of its own."""
    rounds, made = max(1, -(-amount // max(1, most))), []
    for i in range(rounds):
        some = dealt.filter(F.pmod("_key", F.lit(rounds)) == i) if rounds > 1 else dealt
        made.append(common.stored(common.in_arrow(some.repartition("_key").sortWithinPartitions("_key"), run, schema), name))
    return reduce(DataFrame.union, made)


def _round_elements(classes: DataFrame) -> int:
    """Elements that a round copies: as many as all sets have, so that disk stays in proportion to the input."""
    return max(ROUND_ELEMENTS, classes.agg(F.sum("n")).first()[0] or 0)


def _like(ids: np.ndarray, sizes: np.ndarray, shapes: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Links between sets that may be similar by their sizes and shapes (side 0 with itself where there is no side 1)."""
    order = np.lexsort((ids, sizes))
    ids, sizes, shapes, side = ids[order], sizes[order], shapes[order], side[order]
    apart, found = bool(side.any()), [np.zeros((0, 2), np.int64)]
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, np.searchsorted(sizes * percent, sizes[i] * 100, side="right"))
        if apart:
            j = j[side[j] != side[i]]
        if len(j):
            differ = np.abs(shapes[j] - shapes[i]).sum(1, dtype=np.int64)
            j = j[differ * (100 + percent) <= (100 - percent) * (sizes[i] + sizes[j])]
            found.append(np.stack([np.full(len(j), ids[i]), ids[j]], 1))
    return np.concatenate(found)


def clusters(candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, cluster, docs, elements): representatives of classes in groups of like shapes; docs and elements are the group's."""
    nodes = candidates.select(F.col("instance").alias("cluster"), F.col("u").alias("doc_id")).union(candidates.select("instance", "v")).distinct()
    nodes = nodes.join(classes.select(F.col("class_id").alias("doc_id"), "n", "shape"), "doc_id")
    members = _grouped(candidates.select(F.col("instance").alias("cluster"), "u", "v"), nodes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.runs(batches, "_key"):
            if group.num_rows > 1:
                ids, sizes, side, cluster = (group.column(c).to_numpy() for c in ("doc_id", "n", "side", "cluster"))
                shapes = _in_like_cells(group.column("shape").to_pylist())
                forest = Forest()
                forest.link(_like(ids, sizes, shapes, side, percent))
                links = forest.edges()
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), cluster[0])), pa.array(links[:, 0]), pa.array(links[:, 1])], names=["cluster", "u", "v"])

    blocks = F.greatest(F.col("docs") / BLOCK_DOCS, F.col("elements") / BLOCK_SHAPED)
    amount = members.agg(F.sum((F.length("shape") + 40) * F.ceil(blocks))).first()[0] or 0
    dealt = _in_pairs_of_blocks(members, blocks).select("_key", "cluster", "doc_id", "n", "side", "shape")
    links = _compared(dealt, compare, "cluster long, u long, v long", "like", amount, 8 * _round_elements(classes))
    return _grouped(links, members.drop("shape", "docs", "elements"))


def _verified(docs: DataFrame, members: DataFrame, most: int, words: int, percent: int, *, every: bool = False) -> DataFrame:
    """True links (u, v) inside clusters: a spanning forest of each pair of blocks, or every link (twice where two clusters share it).

    A round copies about ``most`` elements; where there are several rounds, the sets are written first.
    """
    places = members.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "elements")).alias("places"))  # at most two
    if members.count() <= MOST_BROADCAST:
        places = F.broadcast(places)
    texts = _texts(docs).join(places, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, text in common.text_slices([batch], "doc_id"):
                codes, offsets = shingle_sets(text, words)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(at, len(ids)), lists], names=["doc_id", "places", "codes"])
                at += len(ids)

    made = common.in_arrow(texts.select("doc_id", "text", "places"), sets, "doc_id long, places array<struct<cluster:bigint,elements:bigint>>, codes array<bigint>")
    blocks = F.col("elements") / BLOCK_ELEMENTS
    amount = members.agg(F.sum(F.col("n") * F.ceil(blocks))).first()[0] or 0
    if amount > most:
        made = common.stored(made, "clustered-sets")
    made = made.select("doc_id", "codes", F.explode("places").alias("_p")).select("doc_id", "codes", "_p.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        table = lambda links: pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])
        for group in common.runs(batches, "_key"):
            if group.num_rows > 1:
                lists = group.column("codes").combine_chunks()
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
                codes = lists.flatten().to_numpy(zero_copy_only=False)
                links = _links_of(group.column("doc_id").to_numpy(), codes, offsets, group.column("side").to_numpy(), percent)
                if every:
                    yield table(links)
                else:
                    forest.link(links)
        yield table(forest.edges())

    dealt = _in_pairs_of_blocks(made, blocks).select("_key", "doc_id", "side", "codes")
    return _compared(dealt, count, "u long, v long", "true-links", amount, most)


def _sets_and_clusters(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, those that may be linked, their classes, clusters of classes)."""
    sets = set_table(docs, words)
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = common.stored(known.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("class_id"), F.first("shape").alias("shape")), "classes")
    candidates = candidate_links(docs, words, percent, _ranges(classes, percent))
    return sets, known, classes, clusters(candidates, classes, percent)


def near_pairs(docs: DataFrame, *, words: int = 4, percent: int = 85) -> DataFrame:
    """(u, v), u < v: every pair of classes (by class_id) whose sets are similar, once.

    With the class_id of ``near_components`` no link between documents is lost: those of a class are all linked, and those of
    two linked classes too. There may be as many pairs as a group of similar classes has, its size squared.
    """
    _, _, classes, members = _sets_and_clusters(docs, words, percent)
    links = _verified(docs, members, _round_elements(classes), words, percent, every=True)
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def near_components(docs: DataFrame, *, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of ``docs``.

    class_id is the least doc_id with an equal set, component_id the least one that links reach; both are the document
    itself where it is linked with nothing.
    """
    sets, known, classes, members = _sets_and_clusters(docs, words, percent)
    true = components(_verified(docs, members, _round_elements(classes), words, percent))
    linked = F.coalesce("component", "class_id").alias("component_id")
    classes = classes.join(true, F.col("class_id") == F.col("node"), "left").select("fa", "fb", "n", "class_id", linked)
    whole = known.join(classes, ["fa", "fb", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = sets.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return whole.union(alone)
