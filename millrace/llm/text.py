"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends a word: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``limit`` bytes each (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size + 16, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").to_pylist()


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """Column names like these that are not taken, in any case of letters."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in low:
            n += "_"
        out.append(n)
        low.add(n.lower())
    return out
