"""Best-fit packing of tokenised documents into training sequences.

A document's ids end with an end mark; only those longer than a sequence are cut.  Pieces
are dealt at random into groups of about GROUP pieces, and each group is packed
longest first by vector best fit: a bin has residual capacities for tokens, documents and
attention cost (the sum of squared lengths), a piece fits where none is exceeded, and among
those the bin is taken that is left with the least weighted residual norm, or that has
the largest weighted dot product of residual and piece.  Groups of thousands lose
less than one sequence each against packing all at once.

Ids never are shuffled: pieces are placed by their lengths, and `sequences` joins the
ids when the sequences themselves are wanted.

Defined cases: a null or empty text is its end mark alone; repeated rows are packed each; an
empty table gives no rows; other columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_kernel as bk
from . import word_bpe
from .arrow_rows import carried
from .scratch import Scratch

SEQUENCE = 4096
END_ID = 1
GROUP = 8192


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", carry: Sequence[str] | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc, piece, start, length, ids: little-endian unsigned 32-bit) for each piece."""
    rows = carried(docs, text, carry)
    fields = T._parse_datatype_string("piece int, start long, length long, ids binary")
    schema = T.StructType([rows.schema["doc"], *fields.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.shared(tokenizer)
        for batch, _, _ in bk.chunks(batches, "text"):
            ids, offsets = bpe.encode(batch.column(1).to_pylist())
            n = np.diff(offsets)
            own = np.empty(len(ids) + len(n), np.uint32)
            first = offsets[:-1] + np.arange(len(n))
            own[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            own[first + n] = end_id
            pieces = -(-(n + 1) // length)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = bk.ragged(np.zeros(len(n), np.int64), pieces)
            start = piece * length
            size = np.minimum(n[doc] + 1 - start, length)
            at = np.append(first[doc] + start, len(own)).astype(np.int64) * 4
            blob = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(own.astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), blob], names=names
            )

    return rows.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; capacity and weights: tokens, documents, attention cost."""
    cap, weight = np.asarray(capacity, float), np.asarray(weights, float)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((n, 3))
    used = np.zeros(n, np.int64)
    opened, live = 0, np.zeros(n, np.int64)  # live: bins that can still take the shortest piece
    n_live = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = np.array([lengths.min(), 1, float(lengths.min()) ** 2]) if n else None
    for i in order:
        size = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        residual = left[live[:n_live]]
        fits = np.flatnonzero((residual >= size).all(1))
        if len(fits):
            after = residual[fits] - size
            if rule == "norm":
                k = fits[np.argmin(((after / cap) ** 2) @ weight)]
            else:
                k = fits[np.argmax((residual[fits] / cap) @ (weight * size / cap))]
            b = live[k]
        else:
            b, k = opened, n_live
            if (size > cap).any():
                raise ValueError("a piece is larger than a sequence")
            left[b] = cap
            live[n_live] = b
            opened, n_live = opened + 1, n_live + 1
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        left[b] -= size
        if (left[b] < shortest).any():
            n_live -= 1
            live[k] = live[n_live]
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = SEQUENCE, max_docs: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (their columns but ids are kept).

    Without max_docs or max_attention those capacities are as large as max_tokens allows.
    """
    capacity = (max_tokens, max_docs or max_tokens, max_attention or float(max_tokens) ** 2)
    light = pieces.drop("ids")
    kept = Scratch(pieces.sparkSession, "pack").keep(light, "pieces")
    n = kept.count()
    groups = max(1, -(-n // group))
    dealt = kept.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([f for f in dealt.schema.fields if f.name != "group"] + T._parse_datatype_string("sequence_id long, offset long").fields)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("length", ascending=False, kind="stable")
        bins, offsets = best_fit(part["length"].to_numpy(np.int64), capacity, weights, rule)
        return part.assign(sequence_id=part["group"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="group")[schema.names]

    return dealt.groupBy("group").applyInPandas(fit, schema)


def sequences(pieces: DataFrame, packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(sequence_id, ids, docs) with the ids of each sequence joined in order; keys: columns that tell pieces apart."""
    placed = packed.select(*keys, "sequence_id", "offset").join(pieces.select(*keys, "ids"), list(keys))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda x, p: F.concat(x, p["ids"])).alias("ids"), F.size("parts").alias("docs")
    )
