"""Token counts: exact counts by a public tokenizer, huge documents by overlap resynchronisation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices
from .encoder import encoding


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle: each scan task encodes its own rows, about 1 MB at a time. Null texts count as empty: 0 bytes,
    0 tokens. Repeated rows and null ids are counted row by row; an empty table gives an empty result. Other
    columns are not read, so names can't clash. path: a tokenizers .json file that the executors can open.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        with encoding(path) as enc:
            for batch in slices(batches, "text", 1 << 20):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array([len(x) for x in enc.ids(texts)], pa.int64())],
                    names=["id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
