"""Token-id files with one shared zstandard dictionary, readable document by document.

A store is a folder with two Parquet tables, so any file system Spark can
write to will do and a lost writer task is redone by Spark:

``dictionary``  dict_hash (sha256), dictionary, id_bytes
``blocks``      shard, block, first_doc, last_doc, tokens_before, n_tokens,
                dict_hash, and per document: doc_ids, offsets (one more than
                documents, into ``payload``), counts; ``payload`` holds each
                document's ids as a zstandard frame of its own.

The dictionary is trained on the serialized ids of a sample of about
``sample_docs`` documents, chosen by hash over all rows (of a document over 64 KB
sixteen evenly spread parts); it only affects the size, never the content.  Blocks follow ascending doc_id: shards are ranges of ids, blocks
are numbered inside a shard, and a document is read by its block's id range,
offset index and one small frame.

Defined results: a null text is empty (its end id only); a null doc_id sorts
first; repeated ids stay as separate documents, in the order of their content;
an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.arrow_text import slices, texts
from cohortforge.llm.word_tokens import encoder, load_definition, public_vocabulary
from cohortforge.session import stage_path

END_ID = 2
SAMPLE_DOCS = 2000
DICT_BYTES = 64 * 1024
MOST_BYTES = 1 << 16
BLOCK_BYTES = 4 * 1024 * 1024
LEVEL = 3
# Bytes of text encoded at a time: a word is looked up once in as many.
ENCODE_BYTES = 16 * 1024 * 1024

_ENCODED = "doc_id long, n_tokens long, frame binary"
_BLOCKS = ("shard int, block int, first_doc long, last_doc long, tokens_before long, n_tokens long, "
           "dict_hash string, doc_ids array<long>, offsets array<long>, counts array<long>, "
           "payload binary")


def id_bytes_for(definition: str) -> int:
    """2 when every id of the vocabulary fits two bytes, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else 4


def even_parts(ids: np.ndarray, most: int = MOST_BYTES, parts: int = 16) -> bytes:
    """The serialized ids, of a long document ``parts`` runs spread evenly from its start to its end."""
    if ids.nbytes <= most:
        return ids.tobytes()
    size = most // parts // ids.itemsize
    starts = np.linspace(0, len(ids) - size, parts).astype(np.int64)
    return b"".join(ids[a:a + size].tobytes() for a in starts)


def train_dictionary(docs: DataFrame, definition: str, id_bytes: int, end_id: int = END_ID,
                     sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from about ``sample_docs`` documents; b'' if too few.

    Every row has the same chance, whatever its id or place; the sample goes to
    the driver as at most ``MOST_BYTES`` a document.
    """
    rows = docs.select("doc_id").count()
    if rows == 0:
        return b""
    steps = 1 << 30
    at = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(steps))
    sample = docs.withColumn("at", at).filter(F.col("at") < int(min(1.0, sample_docs / rows) * steps))

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(definition)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = enc.encode(texts(part))
                raw = [even_parts(np.append(ids[a:b], end_id).astype(f"<u{id_bytes}"))
                       for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    got = [bytes(r.raw) for r in sample.select("doc_id", "text").mapInArrow(serialized, "raw binary").toLocalIterator()]
    try:
        return zstd.train_dictionary(dict_bytes, sorted(got)).as_bytes()
    except zstd.ZstdError:  # too little to train on
        return b""


def write_store(docs: DataFrame, path: str, definition: str, id_col: str = "doc_id",
                text_col: str = "text", end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every text and write the store at ``path``."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    width = id_bytes_for(definition)
    raw_dict = train_dictionary(own, definition, width, end_id)
    dict_hash = hashlib.sha256(raw_dict).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(raw_dict), width)],
                          "dict_hash string, dictionary binary, id_bytes int").coalesce(1) \
        .write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(definition)
        comp = zstd.ZstdCompressor(level=LEVEL, write_content_size=True, write_dict_id=False,
                                   dict_data=zstd.ZstdCompressionDict(raw_dict) if raw_dict else None)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                offsets, ids = enc.encode(texts(part))
                ids = ids.astype(f"<u{width}")
                end = np.array([end_id], ids.dtype).tobytes()
                frames = [comp.compress(ids[a:b].tobytes() + end)
                          for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets) + 1), pa.array(frames, pa.binary())],
                    names=["doc_id", "n_tokens", "frame"])

    # written once, so that the range sort below samples files and not the encoder
    encoded = stage_path(spark, "encoded_ids")
    own.mapInArrow(encode, _ENCODED).write.parquet(encoded)

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush():
            nonlocal block, before, held
            known = [i for i in ids if i is not None]
            offs = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            total = sum(counts)
            row = [shard, block, min(known, default=None), max(known, default=None), before, total,
                   dict_hash, list(ids), offs.tolist(), list(counts), b"".join(frames)]
            block, before, held = block + 1, before + total, 0
            ids.clear(), counts.clear(), frames.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)],
                names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                ids.append(doc), counts.append(n), frames.append(frame)
                held += len(frame)
                if held >= block_bytes or len(ids) >= 1 << 16:
                    yield flush()
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame")]
    (spark.read.schema(_ENCODED).parquet(encoded)
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(block_up, _BLOCKS)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary), row.dict_hash, row.id_bytes


def _decompressor(raw_dict: bytes):
    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw_dict) if raw_dict else None)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this id, by the blocks' id ranges and offset index."""
    raw_dict, dict_hash, width = _dictionary(spark, path)
    found = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").filter(
        (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    out = []
    at = F.posexplode(F.col("doc_ids")).alias("k", "doc")
    frames = (found.select("dict_hash", "offsets", "payload", at).filter(F.col("doc") == doc_id)
              .select("dict_hash", F.expr("substring(payload, int(offsets[k]) + 1, "
                                          "int(offsets[k + 1] - offsets[k]))").alias("frame")))
    for row in frames.toLocalIterator():
        if row.dict_hash != dict_hash:
            raise ValueError("the block was written with another dictionary")
        out.append(np.frombuffer(_decompressor(raw_dict).decompress(bytes(row.frame)), f"<u{width}")
                   .astype(np.uint32))
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    raw_dict, dict_hash, width = _dictionary(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _decompressor(raw_dict)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != dict_hash:
                    raise ValueError("the block was written with another dictionary")
                data, offs = memoryview(r["payload"]), r["offsets"]
                got = [np.frombuffer(dec.decompress(data[a:b]), f"<u{width}").astype("<u4")
                       for a, b in zip(offs[:-1], offs[1:])]
                n = np.array([len(g) for g in got], np.int64)
                if n.tolist() != r["counts"]:
                    raise ValueError("a block's index disagrees with its payload")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), r["shard"], np.int32)), pa.array(r["doc_ids"], pa.int64()),
                     pa.array(r["tokens_before"] + np.cumsum(n) - n), pa.array(n),
                     pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64())],
                    names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(decode, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    # one row per shard (a write task), so this list is as long as the number of tasks
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    first, firsts = 0, []
    for shard, n in totals:
        firsts.append((shard, first))
        first += n
    base = spark.createDataFrame(firsts, "shard int, first long")
    return rows.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to a store in the shared folder and read it back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = stage_path(spark, "id_store")
    write_store(docs, path, load_definition(public_vocabulary()))
    return read_store(spark, path)
