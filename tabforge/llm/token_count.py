"""Token counts of flat token files by a separator scan.

A token file is nothing but fixed-width ids, one end-of-document id after each document, no index. Blocks
of a file are searched with one vector comparison each; a prefix scan over the blocks' small summaries
(separators so far, last separator so far) then numbers the documents and stitches those that cross
block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.bpe import WordBpe, read_spec
from tabforge.llm.common import settle, ship

ship(__name__)
#: Ids are unsigned 16-bit, high byte first. The end-of-document id lies beyond the vocabulary of 49,408 ids, and its
#: two bytes are one UTF-8 character, so Spark's text writer can put it after each document as a line separator.
DTYPE, END_CHAR = ">u2", "\u0080"
END_ID = int(np.frombuffer(END_CHAR.encode(), DTYPE)[0])
BLOCK_TOKENS = 1 << 18


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode whole texts (null: empty) and write them as flat token files, a file for each partition, rows in order."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        for b in batches:
            data = [ids.astype(DTYPE).tobytes() for ids in bpe.batches(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["tokens"])
    (docs.select(F.col("text").cast("string")).mapInArrow(run, "tokens binary")
     .select(F.col("tokens").cast("string")).write.option("lineSep", END_CHAR).text(path))


def _large(spark: SparkSession, path: str, length: int, width: int, block: int) -> DataFrame:
    """Blocks of one file too large for one row, as records of the largest fitting size that divides its length."""
    size = max(s for s in range(width, block * width + 1, width) if length % s == 0)
    rows = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda r: (path, r[1] * (size // width), bytearray(r[0])))
    return spark.createDataFrame(rows, "path string, at long, content binary")


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = DTYPE,
                 block_tokens: int = BLOCK_TOKENS, max_file_bytes: int = 256 << 20) -> DataFrame:
    """``path, doc_no, first_token, n_tokens``: every document of every file, numbered from 0 within its file.

    Ids after a file's last separator are a document too; two separators in a row hold an empty one; an empty file
    has none. Files over ``max_file_bytes`` are read in records instead of whole. A file whose length is no multiple
    of the id's width is an error. All ids count, repeated documents too.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if files.where(F.col("length") % width != 0).limit(1).count():
        raise ValueError(f"a file's length is no multiple of {width} bytes")
    parts = files.where(F.col("length") <= max_file_bytes).select("path", F.lit(0).cast("long").alias("at"), "content")
    for r in files.where(F.col("length") > max_file_bytes).select("path", "length").collect():
        parts = parts.unionByName(_large(spark, r["path"], r["length"], width, block_tokens))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, at, content in zip(*(c for c in b.columns)):
                ids = np.frombuffer(content.as_buffer(), dtype)
                for k in range(0, len(ids), block_tokens):
                    piece = ids[k:k + block_tokens]
                    first = at.as_py() + k
                    ends = np.flatnonzero(piece == end_id) + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p.as_py()]), pa.array([first]), pa.array([len(piece)]), pa.array([ends], pa.list_(pa.int64()))],
                        ["path", "first", "n", "ends"])
    blocks = settle(parts.mapInArrow(scan, "path string, first long, n long, ends array<long>"))
    order = Window.partitionBy("path").orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("path", "first", F.size("ends").alias("k"), F.array_max("ends").alias("last"),
                         (F.col("first") + F.col("n")).alias("stop"))
    sums = sums.select("path", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("done"),
                       F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"),
                       F.lead("first").over(order).isNull().alias("tail"), "stop")
    ends = F.col("ends")
    ends = F.when(F.col("tail") & (F.coalesce(F.array_max("ends"), F.col("open")) < F.col("stop") - 1),
                  F.concat(ends, F.array("stop"))).otherwise(ends)
    docs = blocks.join(settle(sums), ["path", "first"]).select("path", "done", "open", ends.alias("ends"))
    docs = docs.select("path", "done", F.posexplode_outer(F.zip_with(
        "ends", F.concat(F.array("open"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))),
        lambda e, o: F.struct((o + 1).alias("a"), e.alias("b")))).alias("i", "d")).where("d is not null and d.b is not null")
    return docs.select("path", (F.col("done") + F.col("i")).alias("doc_no"), F.col("d.a").alias("first_token"),
                       (F.col("d.b") - F.col("d.a")).alias("n_tokens"))
