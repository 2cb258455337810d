"""Token counts of flat, unindexed token files by a scan for end-of-document marks.

A token file is nothing but big-endian unsigned 16-bit ids; each document ends in a mark.
Files are cut into blocks, each block is searched for marks at once, and a prefix scan
over the blocks' last marks and numbers of marks stitches documents that cross blocks.

`write_token_files` makes such files from documents through Spark's own text sink, so any
store works: a row is a document's ids and the line separator is the mark, whose two
bytes are the UTF-8 form of U+0100.  Each document has an address, the table file and the row in it that it was read
from.  A task writes a token file for each run of consecutive rows, FILE_DOCS at most, and the file's folder names the
address of the first.  So counts find their documents by address, however later scans are split.

Defined cases: a null or empty text has 0 tokens; files may be empty; tokens after
a file's last mark are a document that isn't ended; repeated rows are counted each; other columns are carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytes_kernel as bk
from .arrow_rows import quoted
from .scratch import Scratch

MARK = 0xC480
_MARK_TEXT = "Ā"
BLOCK_TOKENS = 1 << 20
FILE_DOCS = 5_000
#: Text that a worker encodes at once.
ENCODED_BYTES = 4 << 20
#: Files up to this size are read whole, larger ones in records that divide their size.
WHOLE_FILE = 256 << 20


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    if max(ranks.values()) >= MARK:
        raise ValueError("the vocabulary has the mark's id")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def addressed(docs: DataFrame, text: str, carry: Sequence[str] | None) -> DataFrame:
    """(doc, text, file, row) of a table that is read from Parquet files."""
    columns = docs.columns if carry is None else list(carry)
    return docs.select(
        F.struct(*[F.col(quoted(c)) for c in columns]).alias("doc"), F.col(quoted(text)).cast("string").alias("text"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def write_token_files(rows: DataFrame, where: str, ranks: str, pattern: str) -> None:
    """Encodes whole texts of addressed rows; a file's documents are those of the rows from `first` on of table file `file`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        file, first, row = None, 0, -1
        for batch, _, _ in bk.chunks(batches, "text", ENCODED_BYTES):
            ids = [np.array(encoding.encode_ordinary(t), ">u2").tobytes() if t else b"" for t in batch.column(0).to_pylist()]
            firsts = []
            for own, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own != file or at != row + 1 or at - first >= FILE_DOCS:
                    file, first = own, at
                row = at
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column(1), pa.array(firsts, pa.int64()), batch.column(2)], names=["ids", "file", "first", "row"])

    encoded = rows.select("text", "file", "row").mapInArrow(run, "ids binary, file long, first long, row long").sortWithinPartitions("file", "first", "row")
    encoded.select(F.col("ids").cast("string").alias("value"), "file", "first").write.mode("overwrite").partitionBy("file", "first").option("lineSep", _MARK_TEXT).text(where)


def _scan(data: bytes, path: str) -> Iterator[tuple]:
    tokens = np.frombuffer(data, ">u2")
    for block, at in enumerate(range(0, len(tokens), BLOCK_TOKENS)):
        part = tokens[at : at + BLOCK_TOKENS]
        yield path, block, at, len(part), np.flatnonzero(part == MARK) + at


def _blocks(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            for p, block, at, n, marks in _scan(memoryview(content.as_buffer()), path):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([block]), pa.array([at]), pa.array([n]), pa.array([marks], pa.list_(pa.int64()))], names=["path", "block", "start", "n", "marks"]
                )


_BLOCK = "path string, block long, start long, n long, marks array<long>"


def _large(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Blocks of a file too large to read whole: records of a length that divides its size, a block of many records where only short ones do."""
    most, width = 8 << 20, 2
    record = next((size // k for k in range(-(-size // most), 100_000) if size % k == 0 and size // k % width == 0), width)

    def found(part: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        together = max(1, most // record)
        while run := list(islice(part, together)):  # consecutive records of one partition
            at, data = run[0][1], b"".join(r for r, _ in run)
            yield path, at, at * record // width, len(data) // width, (np.flatnonzero(np.frombuffer(data, ">u2") == MARK) + at * record // width).tolist()

    return spark.createDataFrame(spark.sparkContext.binaryRecords(path, record).zipWithIndex().mapPartitions(found), _BLOCK)


def scan_token_files(spark: SparkSession, where: str) -> DataFrame:
    """(path, document: its number in the file, start, n_tokens without the mark, ended)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    blocks = files.filter(F.col("length") <= WHOLE_FILE).select("path", "content").mapInArrow(_blocks, _BLOCK)
    for row in files.filter(F.col("length") > WHOLE_FILE).select("path", "length").toLocalIterator():
        blocks = blocks.unionByName(_large(spark, row["path"], row["length"]))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "path", "block", "start", "n", "marks",
        F.coalesce(F.max(F.try_element_at("marks", F.lit(-1))).over(before), F.lit(-1)).alias("last"),
        F.coalesce(F.sum(F.size("marks")).over(before), F.lit(0)).alias("first"),
        (F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()).alias("final"),
    )
    # Each document by the mark before it and its own; what follows a file's last mark has no own.
    edges = F.concat(F.array("last"), "marks")
    end = F.col("start") + F.col("n")
    tail = F.when(F.col("final") & (F.element_at(edges, -1) + 1 < end), F.array(end)).otherwise(F.array().cast("array<long>"))
    bounds = F.concat(edges, tail)
    docs = F.transform(
        F.slice(bounds, F.lit(2), F.size(bounds)),
        lambda m, i: F.struct(
            (F.col("first") + i).cast("long").alias("document"),
            (F.get(bounds, i) + 1).alias("start"),
            (m - F.get(bounds, i) - 1).alias("n_tokens"),
            (i < F.size("marks")).alias("ended"),
        ),
    )
    return stitched.select("path", F.explode(docs).alias("d")).select("path", "d.*")


def count_tokens(docs: DataFrame, where: str, ranks: str, pattern: str, text: str = "text", carry: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """(doc, n_tokens): writes the token files of docs under `where`, scans them, and matches documents by address.

    stored: docs is a table just as it is read from Parquet files; any other is written to such a table first.
    """
    spark = docs.sparkSession
    if not stored:
        docs = Scratch(spark, "counted").keep(docs, "docs")
    rows = addressed(docs, text, carry)
    write_token_files(rows, where, ranks, pattern)
    counts = scan_token_files(spark, where).filter("ended").select(
        F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long").alias("file"),
        (F.regexp_extract("path", r"/first=(\d+)/", 1).cast("long") + F.col("document")).alias("row"),
        "n_tokens",
    )
    joined = rows.select("doc", "file", "row").join(counts.hint("merge"), ["file", "row"], "full")
    # A document without a count or a count without a document: files were changed.
    checked = F.when(F.col("doc").isNull() | F.col("n_tokens").isNull(), F.raise_error(F.lit("token files and documents do not match")).cast("long")).otherwise(F.col("n_tokens"))
    return joined.select("doc", checked.alias("n_tokens"))
