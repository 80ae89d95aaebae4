"""Documents packed into blocks: one row for about 2 million characters, so that numpy works on many texts at a time and what a block
has in many documents is asked about once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ready, stage, steps, string

#: Orders and marks rows without an id.
NO_ID = np.iinfo(np.int64).max


def ids_of(column: pd.Series) -> np.ndarray:
    out = np.full(len(column), NO_ID, np.int64)
    known = column.notna().to_numpy()
    out[known] = column[known].astype(np.int64)
    return out


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A staged table with a row for each block: block, n_docs, n_bytes, n_words, doc_ids, sizes and texts (zstd-packed UTF-8)."""
    ready(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)
        for rows in parts:
            for some in steps(rows, "text"):
                raw = [(string(t) or "").encode("utf-8", "replace") for t in some.text]
                yield pd.DataFrame({
                    "block": [block], "n_docs": [len(raw)], "n_bytes": [sum(map(len, raw))], "n_words": [sum(len(r.split()) for r in raw)],
                    "doc_ids": [ids_of(some.doc_id).tobytes()], "sizes": [np.array([len(r) for r in raw], "<u8").tobytes()],
                    "texts": [press.compress(b"".join(raw))],
                })
                block += 1

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "block long, n_docs long, n_bytes long, n_words long, doc_ids binary, sizes binary, texts binary")
    return stage(out, "blocks", blobs=True)


class Block:
    def __init__(self, row: object) -> None:
        self.block = int(row.block)
        self.doc_ids = np.frombuffer(row.doc_ids, np.int64)
        cuts = np.cumsum([0, *np.frombuffer(row.sizes, "<u8").tolist()])
        data = zstandard.ZstdDecompressor().decompress(row.texts, int(row.n_bytes)) if row.n_bytes else b""
        self.raw = [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def words(self, lower: bool = False) -> Words:
        return Words([r.decode("utf-8") for r in self.raw], lower)


def blocks_of(parts: Iterator[pd.DataFrame]) -> Iterator[Block]:
    for rows in parts:
        for row in rows.itertuples(index=False):
            yield Block(row)

