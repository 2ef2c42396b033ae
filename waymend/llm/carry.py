"""Row-wise Arrow steps that add columns and carry all others along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import CHUNK_BYTES, chunks
from .names import Inner


def with_text_columns(docs: DataFrame, text_col: str, new: dict[str, str], step: Callable, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with the columns of `new` (name to type) that step(bytes, offsets, is_null) gives as Arrow arrays.

    A column of docs with one of those names, case aside, gives way to the new one.
    """
    inner = Inner(docs, new)
    text = inner.at(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch[text].is_null()
            for row, values, offsets in chunks(batch[text], chunk_bytes):
                n = len(offsets) - 1
                found = step(values, offsets, null.slice(row, n).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(x.slice(row, n) for x in batch.columns), *found], names=[*batch.schema.names, *new])

    done = inner.df.mapInArrow(run, inner.schema(", ".join(f"{c} {kind}" for c, kind in new.items())))
    return done.select(*inner.outer(), *new)
