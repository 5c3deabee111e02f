"""Token counts of documents in flat, unindexed token files, found by their separators.

A flat file is nothing but token ids of a fixed width; each document ends with
the end-of-document id. Files are read as blocks that begin and end anywhere
(``file``, ``block`` from 0, ``data``). In each block one vectorised comparison
finds the separators; a prefix scan over the blocks of a file (window functions
over one small row per block) gives the number of separators before a block and
the length of the document that is open at its start, and so joins what a border
cut. Nothing needs an index or whole files in memory.

Defined cases: two separators in a row enclose a document of 0 tokens; tokens
after the last separator are one more document with ``closed`` false; an empty
file or table gives no rows; a width that does not divide a block is an error, as are
ids that a width cannot hold; null and empty texts are documents of 0 tokens; rows with
one doc_id, and equal rows, are counted each for itself; other columns are ignored; a
text of any length is encoded as a whole, by pieces of the pre-tokeniser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import PIECE, Ranks, worker_encoder
from quillspark.llm.durable import durable
from quillspark.llm.textnum import pieces

BLOCK_BYTES = 1 << 18


def _summaries(batches: Iterator[pa.RecordBatch], separator: int, kind: str) -> Iterator[pa.RecordBatch]:
    width = np.dtype(kind).itemsize
    for batch in batches:
        sizes, found = [], []
        for data in batch.column("data"):
            body = data.as_buffer() if data.is_valid else b""
            if len(body) % width:
                raise ValueError(f"a block of {len(body)} bytes is no whole number of {width}-byte tokens")
            tokens = np.frombuffer(body, kind)
            sizes.append(len(tokens))
            found.append(np.flatnonzero(tokens == separator).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("file").cast(pa.string()), batch.column("block").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file", "block", "n", "seps"])


def count_tokens(blocks: DataFrame, separator: int, kind: str = "<u2") -> DataFrame:
    """One row for each document: file, ordinal (from 0), start_token, n_tokens, closed.

    The prefix scan sees three numbers of each block; separators stay where they were found.
    """
    found = durable(blocks.select("file", "block", "data").mapInArrow(lambda it: _summaries(it, separator, kind), "file string, block long, n long, seps array<int>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = found.select("file", "block", "n", F.size("seps").alias("m"), F.try_element_at("seps", F.lit(-1)).alias("last"))
    last_end = F.when(F.col("m") > 0, F.col("at") + F.col("last") + 1)
    scanned = (
        numbers.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("m").over(before), F.lit(0)))
        .withColumn("open_from", F.coalesce(F.max(last_end).over(before), F.lit(0)))
        .withColumn("rest_from", F.coalesce(last_end, F.col("open_from")))
        .withColumn("file_end", F.when(F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(), F.col("at") + F.col("n")))
    )
    scanned = durable(scanned.drop("n", "last"), "scan")
    ends = F.transform("seps", lambda s: s + F.col("at"))
    closed = found.filter(F.size("seps") > 0).select("file", "block", "seps").join(scanned, ["file", "block"])
    closed = closed.select("file", "ordinal", "open_from", F.posexplode(ends).alias("k", "end"), ends.alias("ends"))
    closed = closed.select(
        "file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.get("ends", F.col("k") - 1) + 1).alias("start_token"), "end", F.lit(True).alias("closed"),
    )
    rest = scanned.filter("file_end > rest_from").select("file", (F.col("ordinal") + F.col("m")).alias("ordinal"), F.col("rest_from").alias("start_token"), F.col("file_end").alias("end"), F.lit(False).alias("closed"))
    return closed.unionByName(rest).select("file", "ordinal", "start_token", (F.col("end") - F.col("start_token")).alias("n_tokens"), "closed")


def _ranges(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    places: dict[str, tuple] = {}
    for batch in batches:
        for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            scheme = file.split(":")[0] if "://" in file or file.startswith("file:") else "file"
            if scheme not in places:
                places[scheme] = fs.FileSystem.from_uri(file)[0] if scheme != "file" else fs.LocalFileSystem()
            path = file.removeprefix("file:").replace("///", "/", 1) if scheme == "file" else fs.FileSystem.from_uri(file)[1]
            with places[scheme].open_input_file(path) as f:
                body = f.read_at(block_bytes, block * block_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([body], pa.binary())], ["file", "block", "data"])


def flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the files under ``path``, whatever their size: the driver lists names and lengths, each task reads its ranges (local, HDFS or S3 paths)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = [(f.getPath().toString(), f.getLen()) for f in listed if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    known = spark.createDataFrame(files, "file string, length long").filter("length > 0")
    blocks = known.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(lambda it: _ranges(it, block_bytes), "file string, block long, data binary")


_ROWS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def kind_for(ranks: Ranks, separator: int) -> str:
    """The narrowest token type that holds every id and the separator."""
    return "<u2" if max(separator, len(ranks.tokens) - 1) < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, ranks: Ranks, separator: int, kind: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode documents into flat files, one for each partition: (blocks, manifest of file, ordinal, doc_id).

    Blocks are cut at ``block_bytes`` without regard to documents and kept in the shared folder.
    """
    if separator in range(len(ranks.tokens)) and ranks.tokens[separator]:
        raise ValueError("the separator is a token of the vocabulary")
    kind = kind or kind_for(ranks, separator)
    if max(separator, len(ranks.tokens) - 1) > np.iinfo(kind).max:
        raise ValueError(f"ids up to {max(separator, len(ranks.tokens) - 1)} do not fit {kind}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, name, held, block, ordinal = worker_encoder(key, shared.value), f"part-{TaskContext.get().partitionId():06d}", [], 0, 0
        size, end = 0, np.array([separator], kind).tobytes()

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            if not held or not last and size < block_bytes:
                return
            body = b"".join(held)
            to = len(body) if last else len(body) // block_bytes * block_bytes
            for lo in range(0, to, block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([body[lo : min(to, lo + block_bytes)]], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], schema=_ROWS)
                block += 1
            held, size = [body[to:]], len(body) - to

        for whole in batches:
            for batch in pieces(whole, limit=PIECE):
                ids = batch.column("doc_id")
                for tokens in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                    held += [tokens.astype(kind).tobytes(), end]
                    size += len(held[-2]) + len(end)
                    yield from cut(False)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), ids.cast(pa.int64())], schema=_ROWS)
                ordinal += n
        yield from cut(True)

    written = durable(docs.select("doc_id", "text").mapInArrow(run, "file string, block long, data binary, ordinal long, doc_id long"), "tokens")
    return written.filter("block is not null").select("file", "block", "data"), written.filter("ordinal is not null").select("file", "ordinal", "doc_id")


def document_token_counts(docs: DataFrame, ranks: Ranks, separator: int) -> DataFrame:
    """doc_id, n_tokens, file, start_token of all documents, counted in flat files written from them."""
    blocks, manifest = write_flat(docs, ranks, separator)
    counts = count_tokens(blocks, separator, kind_for(ranks, separator))
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start_token")
