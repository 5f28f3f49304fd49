"""Token counts of flat token files by a separator scan.

A flat token file holds the token ids of many documents, each document followed by the end-of-document id, and nothing
else: no index. Files are cut into blocks that are read independently; each block's separators are found by one
vectorised comparison. A prefix scan over the blocks of a file, which sees one row per block, carries the last separator
and the number of documents from block to block, and so stitches documents that lie across block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary's free id, and the little-endian type that holds all ids.
END_OF_DOCUMENT = 50256
ID_TYPE = "<u2"
BLOCK_BYTES = 8 << 20


def _token_bytes(ranks_file: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks_file.splitlines())}
        encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            column = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                ids = [np.asarray(encoding.encode_ordinary(t), dtype=ID_TYPE).tobytes() if t else b""
                       for t in column.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])
    return run


def write_token_files(df: DataFrame, path: str, text: str = "text", vocabulary: str = VOCABULARY) -> None:
    """Write the texts of df, in its partitions and order, as flat token files under `path`. Null counts as empty.

    The bytes of the ids go through the text sink, whose line separator is the end-of-document id.
    """
    with open(vocabulary, "rb") as f:
        ranks_file = f.read()
    ids = df.select(F.col(text).alias("text")).mapInArrow(_token_bytes(ranks_file), "ids binary")
    separator = np.array([END_OF_DOCUMENT], dtype=ID_TYPE).tobytes().decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", separator).text(path)


def _open(path: str):
    uri = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _separators(end_of_document: int, id_type: str):
    width = np.dtype(id_type).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["length"] % width:
                    raise ValueError(f"{row['path']} is not a file of {id_type}")
                with _open(row["path"]) as f:
                    f.seek(row["begin"])
                    ids = np.frombuffer(f.read(row["end"] - row["begin"]), dtype=id_type)
                found = np.flatnonzero(ids == end_of_document) + row["begin"] // width
                unfinished = bool(row["end"] == row["length"] and ids[-1] != end_of_document)
                if unfinished:      # the last document of the file has no separator
                    found = np.append(found, row["length"] // width)
                out.append((row["path"], row["begin"], found, int(found[-1]) if len(found) else None, len(found),
                            unfinished))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                names=["path", "begin", "found", "last", "documents", "unfinished"])
    return run


def token_counts(spark: SparkSession, path: str, end_of_document: int = END_OF_DOCUMENT, id_type: str = ID_TYPE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document in the files under `path`: file, doc_no (from 0), start, n_tokens, terminated.

    start and n_tokens are in tokens and leave the separator out. Tokens after a file's last separator are a document
    with terminated false. Empty files have no documents; block_bytes is a multiple of the id's width.
    """
    if block_bytes % np.dtype(id_type).itemsize:
        raise ValueError("block_bytes must be a multiple of the width of an id")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = files.withColumn("begin", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))).withColumn(
        "end", F.least(F.col("begin") + block_bytes, F.col("length")))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = blocks.repartition(spread, "path", "begin").mapInArrow(
        _separators(end_of_document, id_type),
        "path string, begin long, found array<bigint>, last long, documents long, unfinished boolean")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.withColumn("carry", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn(
        "earlier", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    starts = F.transform(F.col("found"), lambda p, i: F.when(i == 0, F.col("carry")).otherwise(
        F.get(F.col("found"), i - 1)) + 1)
    rows = stitched.select("path", "earlier", "documents", "unfinished", F.posexplode(
        F.arrays_zip(starts.alias("start"), F.col("found").alias("stop"))).alias("i", "d"))
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("earlier") + F.col("i")).alias("doc_no"),
        F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
        (~(F.col("unfinished") & (F.col("i") == F.col("documents") - 1))).alias("terminated"))


def document_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the texts of df as flat token files in the shared folder and scan these."""
    path = shared_path(df.sparkSession, "tokens")
    write_token_files(df, path, text, vocabulary)
    return token_counts(df.sparkSession, path, block_bytes=block_bytes)
