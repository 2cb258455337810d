"""Applying a vectorised function to the texts of a DataFrame, other columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_kernel as bk

#: A batch of rows that goes to Python ends at so many bytes, not at a number of rows alone: long texts
#: take no more of an executor's memory than short ones.
BATCH_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, text: str, carry: Sequence[str] | None) -> DataFrame:
    """(doc: struct of the columns to carry, all if None; text), for Python in batches of BATCH_BYTES."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    columns = docs.columns if carry is None else list(carry)
    return docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("doc"), F.col(quoted(text)).cast("string").alias("text"))


def map_texts(docs: DataFrame, text: str, carry: Sequence[str] | None, fields: str, fn: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """(doc, *fields): fn gets the UTF-8 bytes and offsets of some documents, and returns a column for each field."""
    rows = carried(docs, text, carry)
    added = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    schema = T.StructType([rows.schema["doc"], *added.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in bk.chunks(batches, "text"):
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in fn(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return rows.mapInArrow(run, schema)
