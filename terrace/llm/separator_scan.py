"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian unsigned 16-bit ids; each document ends with the separator id.
``scan`` reads the files in blocks that know nothing of documents: each block finds its separators with one
vectorised comparison and reports the ids before its first and after its last separator. A prefix scan over
the blocks of a file then carries the open document across any number of blocks, and numbers the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import AttemptFile, RangeReader, file_system, shared_dir, table, written

SEPARATOR = 50256
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 27
BLOCK = "file string, block long, n_ids long, n_separators long, head long, tail long, inner array<int>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """A byte-level BPE encoder without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts (null: empty) to token files below ``folder``; returns (file, ordinal, doc_id), written.

    The table is only the caller's record of which document is the n-th of a file; ``scan`` doesn't need it. Null ids stay, repeated
    rows are written again, other columns are ignored, an empty table writes no file. A vocabulary whose ids pass 16 bits, or that
    has the separator among them, fails."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_to_numpy
        out, n, ids_written = None, 0, 0
        for b in batches:
            names, ordinals = [], []
            for t in b.column(1):
                if out is None:
                    out, n, ids_written = AttemptFile(folder, "tokens", ".u16"), 0, 0
                text = (t.as_py() or "").encode("utf-8", "surrogatepass").decode("utf-8", "replace")
                ids = encode(text, allowed_special=set(), disallowed_special=())
                if len(ids) and (ids.max() > 0xFFFF or (ids == SEPARATOR).any()):
                    raise ValueError(f"{path}: token files hold ids up to 65535, and {SEPARATOR} ends documents")
                ids = np.append(ids, SEPARATOR).astype("<u2")
                out.write(memoryview(ids).cast("B"))
                names.append(out.name), ordinals.append(n)
                n, ids_written = n + 1, ids_written + len(ids)
                if ids_written >= file_ids:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), b.column(0)], ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_ids) of all token files of a folder, by listing it."""
    fs, path = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else []
    return spark.createDataFrame([(f.base_name, f.size // 2) for f in found if f.base_name.endswith(".u16")], "file string, n_ids long")


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, ids before the first, ids after the last, lengths between them); without any, all ids are head and tail."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return 0, len(ids), len(ids), np.empty(0, np.int32)
    return len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).astype(np.int32)


def scan_blocks(files: DataFrame, folder: str, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each block of each file of ``files`` (file, n_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for b in batches:
            rows = []
            for name, block, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(reader.read(name, 2 * block * block_ids, 2 * n), "<u2")
                count, head, tail, inner = scan_block(ids, separator)
                rows.append((name, block, n, count, head, tail, inner))
            kinds = (pa.string(), *[pa.int64()] * 5, pa.list_(pa.int32()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])
        reader.close()

    last = F.expr(f"(n_ids - 1) div {block_ids}")
    blocks = files.where("n_ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(block_ids).cast("long").alias("most"), "n_ids")
    blocks = blocks.select("file", "block", F.least("most", F.col("n_ids") - F.col("block") * F.col("most")).alias("n"))
    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return blocks.repartition(n, "file", "block").mapInArrow(run, BLOCK)


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, terminated): documents of each file in order.

    The scan's state is (documents so far, ids since the last separator); a block without separators adds to the
    second, any other replaces it. Ids after a file's last separator are a last document that isn't terminated."""
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("base", F.coalesce(F.sum("n_separators").over(so_far), F.lit(0).cast("long")))
    # Since the block with the last separator: its tail, and whole blocks without one.
    total = b.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0).cast("long")))
    closed = F.when(F.col("n_separators") > 0, F.col("ids_before") + F.col("n_ids") - F.col("tail"))
    total = total.withColumn("open_from", F.coalesce(F.max(closed).over(so_far), F.lit(0).cast("long")))
    carry = F.col("ids_before") - F.col("open_from")
    final = F.lead("block").over(order).isNull()
    docs = total.select(
        "file", "base", (carry + F.col("head")).alias("first"), "inner", "n_separators",
        F.when(final & (F.col("n_separators") > 0) & (F.col("tail") > 0), F.col("tail"))
        .when(final & (F.col("n_separators") == 0), carry + F.col("n_ids")).alias("rest"),
    )
    none = F.array().cast("array<long>")
    own = F.when(F.col("n_separators") > 0, F.concat(F.array("first"), F.col("inner").cast("array<long>"))).otherwise(none)
    every = F.concat(own, F.when(F.col("rest").isNotNull(), F.array("rest")).otherwise(none))
    found = docs.select("file", "base", "n_separators", F.posexplode(every).alias("i", "n_tokens"))
    return found.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("i") < F.col("n_separators")).alias("terminated"))


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts of all documents in the token files of ``folder``; an empty folder gives an empty result."""
    return stitch(scan_blocks(file_sizes(spark, folder), folder, separator, block_ids))


def count_tokens(docs: DataFrame, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens, terminated): write ``docs`` to token files and count by scanning them.

    Null and empty texts count 0 ids; null ids and repeated rows keep a row each; other columns are ignored."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    order = write_tokens(docs, folder, path)
    # Files of attempts that failed are not in the order table.
    named = order.select("file").distinct()
    # The order table is small as a file and large in memory: it is never broadcast.
    files = file_sizes(spark, folder).join(named, "file", "left_semi")
    return stitch(scan_blocks(files, folder, SEPARATOR, block_ids)).join(order.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated")


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
