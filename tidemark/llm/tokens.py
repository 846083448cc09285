"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on the document id, stripes read in parallel.

Documents are dealt by ranges of their id and sorted, so that the files in name order, and the rows in each, ascend by
id; each task then encodes its texts and streams them to its ORC file. A row is (seq, doc_id, ids): seq ascends with
doc_id through all files (part number times 2^33 plus row), ids end with ``end_id``. Readers prune stripes and row
groups by the indexes and Bloom filters of doc_id, and get places in the whole stream from the lengths.

Texts are encoded a word (run without ASCII white space) at a time, through a bounded cache by 64-bit hash. That equals
encoding the whole text for vocabularies that drop white space, split at it and lower-case (``word_bpe_49k.json``); pass
``by_word=False`` for others. Texts with what may be a special token (``<|``) or with combining marks, whose composition
depends on case, go to the library whole.

Defined cases: a null text counts as empty and gives only ``end_id``; rows that repeat a doc_id follow each other in
the order of (hash of text, text); null ids come first; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import word_spans

END_ID = 1
CACHE_WORDS = 1_500_000
ROW_GROUP = 1000
#: Bytes of a stripe: what a reader takes as one piece, and what a writer holds in memory.
STRIPE = 16_000_000

_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[ord("."), ord(",")]] = True
#: Words that the library gets in one call.
CALL_WORDS = 2000


def _goes_whole(text: bytes) -> bool:
    """Whether a text may hold a special token or a combining mark (U+0300 to U+036F)."""
    return b"<|" in text or b"\xcc" in text or b"\xcd" in text


class WordEncoder:
    """Ids of whole texts by way of their words; keeps the ids of up to ``limit`` words (about 25 bytes each)."""

    def __init__(self, tokenizer_json: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_unit[[i for unit, i in vocabulary.items() if unit.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1024, np.int32), 0

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        coded = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), np.int32, len(coded))
        return np.fromiter((i for x in coded for i in x), np.int32, int(counts.sum())), counts

    def _together(self, words: list[bytes], units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, encoded many at once: each unit, of letters or a mark, ends with an id that ends a unit."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(self.ends_unit[ids])
        if len(ends) != units.sum() or ends[-1] + 1 != len(ids):
            return self._one_by_one(words)
        return ids, np.diff(ends[np.cumsum(units) - 1] + 1, prepend=0).astype(np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Take up new words, by their sorted keys and places in ``data``."""
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        marked = _POINT[data[ends - 1]] & (ends - begins > 1)
        stems = ends - marked
        plain = letters[stems] - letters[begins] == stems - begins
        raw, starts, counts = data.tobytes().lower(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for at in range(0, len(some), CALL_WORDS):
                part = some[at : at + CALL_WORDS]
                words = [raw[a:b] for a, b in zip(begins[part].tolist(), ends[part].tolist(), strict=True)]
                ids, n = self._together(words, 1 + marked[part]) if plain[part[0]] else self._one_by_one(words)
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2, np.int32)])
                self.ids[self.used : self.used + len(ids)] = ids
                starts[part], counts[part] = self.used + np.cumsum(n, dtype=np.int64) - n, n
                self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.counts = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)."""
        whole = [i for i, x in enumerate(texts) if _goes_whole(x)]
        if whole:
            held = set(whole)
            rest, counts = self.encode([b"" if i in held else x for i, x in enumerate(texts)])
            parts = np.split(rest, np.cumsum(counts)[:-1])
            for i, x in zip(whole, self.tokenizer.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False), strict=True):
                parts[i] = np.array(x.ids, np.int32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        data, begins, ends, hashes, offsets = word_spans(texts)
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + new.sum() > self.limit:
            self._clear()
            new[:] = True
        if new.any():
            self._learn(keys[new], data, begins[first[new]], ends[first[new]])
        at = np.searchsorted(self.keys, keys)
        counts = self.counts[at][place].astype(np.int64)
        upto = np.cumsum(counts)
        take = np.repeat(self.starts[at][place] - (upto - counts), counts) + np.arange(int(upto[-1]) if len(upto) else 0)
        return self.ids[take], np.diff(np.concatenate([[0], upto])[offsets])


class TextEncoder:
    """Ids of whole texts straight from the library."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and the offsets of the texts."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


_encoders: dict[tuple[int, bool], WordEncoder | TextEncoder] = {}


def encoder(tokenizer_json: str, by_word: bool) -> WordEncoder | TextEncoder:
    """The worker's encoder; one is kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (hash(tokenizer_json), by_word)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (WordEncoder if by_word else TextEncoder)(tokenizer_json)
    return _encoders[key]


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """(doc_id, ids) in the order and partitions of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema["doc_id"].dataType
    fields = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, by_word)
        for ids, texts in common.text_slices(batches, "doc_id"):
            flat, offsets = _with_end(*coder.encode(texts), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"])

    return common.in_arrow(docs.select("doc_id", "text"), run, fields)


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = END_ID, by_word: bool = True) -> None:
    """Write the documents' ids under ``path`` in ascending order of doc_id."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", tie.alias("_tie"), F.rand(0).alias("_salt"))  # the salt spreads equal rows
    rows = rows.repartitionByRange("doc_id", "_tie", "_salt").sortWithinPartitions("doc_id", "_tie", "text")
    coded = encoded(rows, tokenizer_json, end_id, by_word)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_GROUP), "orc.stripe.size": str(STRIPE), "compression": "zstd"}
    with common.writing(docs.sparkSession):
        coded.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(seq, doc_id, ids); filters on doc_id prune stripes and row groups."""
    return spark.read.orc(path)


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document."""
    kind = tokens.schema["doc_id"].dataType
    fields = T.StructType([T.StructField("seq", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())],
                names=["seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = common.in_arrow(tokens.select("seq", "doc_id", "ids"), run, fields).withColumn("_chunk", F.shiftright("seq", 33))
    rows = common.stored(rows, "token-digests")
    placed = common.running_start(rows, [], "_chunk", [F.col("seq")], "n_tokens", "start")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """Write the documents' ids to a fresh ORC table in the shared folder, read it back and digest it."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    path = common.scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_json, end_id, by_word)
    return digests(read_tokens(docs.sparkSession, path))
