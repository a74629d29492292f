"""Token-id files: Simple-8b words with per-block offsets, in ascending id order, inside Parquet rows."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import documents, scratch_dir, slices
from .encoder import encoding

#: A file row is closed when it has so many ids; it always holds whole documents.
ROW_IDS = 1 << 16


def write_token_ids(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with end_id after it, in ascending id order (nulls first).

    One range exchange deals rows by (id, hash of the text), so that even one id on many rows is spread; rows of
    one id are in the order of that hash. Each task then writes rows (part, before, n_ids, doc_ids, doc_tokens,
    words, offsets): the coded ids of whole documents and how many ids of the same part come before. Null texts
    count as empty and have end_id alone. An empty table writes no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row():
            nonlocal before
            ids = np.concatenate([x for _, x in held])
            words, offsets = simple8b.encode(ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(id_type)), pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([offsets.astype("<i8").tobytes()], pa.binary())],
                names=["part", "before", "n_ids", "doc_ids", "doc_tokens", "words", "offsets"],
            )
            before += len(ids)
            held.clear()
            return out

        size = 0
        with encoding(path, splice=False, memo=1_000_000, keep=True) as enc:
            for batch in slices(batches, "text", 1 << 20):
                id_type = batch.schema.field("id").type
                for i, x in zip(batch.column("id").to_pylist(), enc.ids([t or "" for t in batch.column("text").to_pylist()])):
                    held.append((i, np.append(x, np.uint32(end_id))))
                    size += len(x) + 1
                    if size >= ROW_IDS:
                        yield row()
                        size = 0
        if held:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange("id", key).sortWithinPartitions("id", key)
    coded = dealt.mapInArrow(encode, f"part int, before long, n_ids long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, words binary, offsets binary")
    coded.write.option("compression", "none").parquet(out)


def read_token_ids(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of such files: id, start (ids of all documents before), n_tokens, ids_crc32.

    The parts' sizes, one number for each task that wrote, go to the driver to become the parts' starts.
    """
    files = spark.read.parquet(out)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    starts, total = {}, 0
    for part, n in files.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        starts[part] = total
        total += n

    def decode(batches):
        for batch in batches:
            for part, before, n, doc_ids, tokens, words, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                ids = simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<i8"), n).astype("<u4")
                ends = np.cumsum(tokens)
                begins = ends - tokens
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, batch.schema.field("doc_ids").type.value_type), pa.array(begins + before + starts[part], pa.int64()), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    columns = files.select("part", "before", "n_ids", "doc_ids", "doc_tokens", "words", "offsets")
    return columns.mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_ids(spark, out)
