"""Token ids of a corpus in Huffman-coded files, in key order, and reading them back.

Layout of a file set (two Parquet tables, so that Spark commits and finds them anywhere):

* ``code``: (token int, length int) of the canonical code, taken from counts over the whole corpus;
* ``blocks``: rows in key order, each with whole documents: part and seq (order), keys, lengths (ids per
  document), first (position of the first id within the part), checkpoints (bit offset of every 256th
  id, the start of an independent block) and payload (32-bit words, most significant bit first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealens.llm.huffman import canonical_codes, code_lengths, decoding_table, pack, unpack
from arealens.llm.text import text_slices
from arealens.scratch import new_path, stage

ROW_IDS = 400_000  # ids in a row of ``blocks``, unless one document has more

class WordCachedTokenizer:
    """The library's encoder, asked once for each word while it is remembered.

    The tokenizer drops white space and never merges across it, and normalises characters without looking
    across it, so the ids of a text are those of its words. A slice's words are numbered in Arrow and looked up among the
    remembered ones there as well; only new words reach the library, and all ids are gathered from one pool.
    """

    def __init__(self, path: str, limit: int = 400_000, run: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.run = limit, run
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.checked = self._by_words()
        self.words, self.sizes, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _by_words(self) -> bool:
        """Whether the tokenizer is of the kind that this class may take apart; others encode whole texts."""
        import json

        d = json.loads(self.library.to_str())
        kinds = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
        split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and "[\\p{L}]+" in split["pattern"].get("Regex", "")

    def _places(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where each of distinct words has its ids, and how many; words met more than once are remembered."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        coded = [e.ids for e in self.library.encode_batch_fast(words.take(pa.array(fresh)).to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        own = np.fromiter(chain.from_iterable(coded), self.dtype, int(sizes.sum()))
        at[fresh] = len(self.words) + np.arange(len(fresh))
        size = np.concatenate([self.sizes, sizes])
        found = np.concatenate([self.pool, own]), (np.cumsum(size) - size)[at], size[at]
        again = (counts[fresh] > 1) & (len(self.words) + np.arange(len(fresh)) < self.limit)
        if again.any():
            self.pool = np.concatenate([self.pool, own[np.repeat(again, sizes)]])
            self.sizes = np.concatenate([self.sizes, sizes[again]])
            self.words = pa.concat_arrays([self.words, words.take(pa.array(fresh[again]))])
        return found

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Ids of each text and ``end_id`` as little-endian numbers of ``dtype`` (large binary); ``texts`` is no slice of an array."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.checked:
            coded = self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([np.array([*e.ids, end_id], self.dtype).tobytes() for e in coded], pa.large_binary())
        split = pc.ascii_split_whitespace(texts)
        offsets, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        place = words.indices.to_numpy()
        pool, starts, sizes = self._places(words.dictionary, np.bincount(place, minlength=len(words.dictionary)))
        size = sizes[place]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[offsets[1:]] + np.arange(1, len(texts) + 1)  # with an end id each
        ids = np.empty(int(before[-1]) + len(texts), self.dtype)
        ids[ends - 1] = end_id
        row = np.searchsorted(offsets, np.arange(0, len(place), self.run), side="right") - 1
        for first, at in zip(range(0, len(place), self.run), row.tolist(), strict=True):
            last = min(first + self.run, len(place))
            own, n = starts[place[first:last]], size[first:last]
            local = before[first : last + 1] - before[first]
            flat = pool[np.arange(local[-1]) + np.repeat(own - local[:-1], n)]
            # Where a text ends within the run, its end id stands between.
            cuts = before[offsets[at + 1 : np.searchsorted(offsets, last, side="left")]] - before[first]
            into = np.arange(local[-1]) + before[first] + at
            if len(cuts):
                shift = np.zeros(local[-1] + 1, np.int64)
                np.add.at(shift, cuts, 1)
                into += np.cumsum(shift[:-1])
            ids[into] = flat
        bounds = np.concatenate([[0], ends]) * ids.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark fills the cores
        _tokenizers[path] = WordCachedTokenizer(path)
    return _tokenizers[path]


def encode_ids(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of each whole text and ``end_id``, packed little-endian; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for whole in batches:
            for batch in text_slices(whole, 1, most=8_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), own.encode(batch.column(1), end_id).cast(pa.binary())], ["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids binary")


def _counts(coded: DataFrame, dtype: str, vocabulary: int) -> np.ndarray:
    """Occurrences of every id in the corpus; the driver gets a number an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype)
            total += np.bincount(ids, minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in coded.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["token"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the file set to ``path``, documents in ascending order of key.

    Null keys come first; documents with one key are ordered by their ids' bytes. Null and empty texts have the
    end id alone; an empty table gives an empty file set. Other columns are not read.
    """
    spark = docs.sparkSession
    own = tokenizer(tokenizer_path)
    dtype, vocabulary = own.dtype, max(own.library.get_vocab_size(), end_id + 1)
    coded = stage(encode_ids(docs, tokenizer_path, end_id, key, text), "ids")
    lengths = code_lengths(_counts(coded, dtype, vocabulary))
    table = spark.createDataFrame([(int(t), int(lengths[t])) for t in np.flatnonzero(lengths)], "token int, length int")
    table.coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, widths = shared.value
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys, ids, n = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], np.int64)
            payload, offsets = pack(np.concatenate(ids), codes, widths)
            columns = [[part], [seq], [first], [keys], [sizes], [offsets.astype("<i8").tobytes()], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                ids.append(np.frombuffer(x.as_py(), dtype))
                n += len(ids[-1])
                if n >= ROW_IDS:
                    yield row()
                    seq, first, keys, ids, n = seq + 1, first + n, [], [], 0
        if keys:
            yield row()

    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
    ordered = coded.repartitionByRange("key").sortWithinPartitions("key", "ids")
    ordered.mapInArrow(blocks, "part int, seq int, first long, keys array<long>, lengths array<long>, checkpoints binary, payload binary").write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document of a file set, decoded from its blocks.

    start counts the ids of all documents before; ids_crc32 is over the ids as little-endian unsigned 32-bit
    numbers; ids (array<int>) is left out with ``digest_only``.
    """
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["token"].max()) + 1 if len(code) else 1, np.uint8)
    lengths[code["token"]] = code["length"]
    shared = spark.sparkContext.broadcast(lengths)
    stored = spark.read.parquet(f"{path}/blocks")
    sizes = stored.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    bases = stage(sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                part, first, keys, sizes, offsets, payload = (c[r].as_py() for c in batch.columns)
                ids = unpack(payload, sum(sizes), np.frombuffer(offsets, "<i8"), table).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(starts + first), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if not digest_only:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "part", "at", "n_tokens", "ids_crc32"] + ["ids"] * (not digest_only)
    schema = "key long, part int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * (not digest_only)
    decoded = stored.select("part", "first", "keys", "lengths", "checkpoints", "payload").mapInArrow(run, schema)
    placed = decoded.join(F.broadcast(bases) if bases.count() <= 1_000_000 else bases, F.col("part") == F.col("_part"))
    return placed.select("key", (F.col("at") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", *names[5:])


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Write the file set into the shared folder, read it back and return its documents' digests."""
    path = new_path(docs.sparkSession, "token_files")
    write_token_files(docs, tokenizer_path, end_id, path, key)
    return read_token_files(docs.sparkSession, path, digest_only=True).withColumnRenamed("key", key)
