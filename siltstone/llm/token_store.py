"""Token ids as Parquet list columns, laid out for selective reads.

Ids are written by Spark's own Parquet writer, whose commits survive lost
tasks, with format version 2: ids dictionary-encoded, or delta-binary-packed;
the document id delta-packed, and sorted within a file; row groups and pages of a
set size, with page indexes.  A reader that wants some documents, or only the
metadata, then reads only the pages and columns for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import shared_dir, slices
from siltstone.llm.tokens import VOCABULARY, encode

SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"


def _tokenizer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = encode(part.column("text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))],
                    ["doc_id", "n_tokens", "token_ids"],
                )

    return run


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row; a null or empty text has an empty list."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_tokenizer(vocabulary), SCHEMA)


def write_tokens(
    tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000
) -> None:
    """Writes (doc_id, n_tokens, token_ids) rows; ``encoding`` of the ids is "dictionary" or "delta".

    Rows are sorted by document id within each task's file, so that page
    indexes narrow a look-up down to few pages.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    writer = tokens.sortWithinPartitions("doc_id").write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    writer = writer.option("parquet.enable.dictionary", "false")
    if encoding == "dictionary":
        writer = writer.option("parquet.enable.dictionary#token_ids.list.element", "true").option("parquet.dictionary.page.size", 1 << 20)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The stored rows, of some documents or with some columns only; both reach the Parquet reader."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    return df.select(*columns) if columns else df


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, encoding: str = "delta", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token ids of all rows to the shared folder and returns what is read there again.

    Repeated rows and null ids are written as any other; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_tokens(token_ids(docs, vocabulary, id_col, text_col), path, encoding)
    return read_tokens(spark, path)
