"""Operator 4: token counts by rank-synchronous array merging.

Every task holds batches of pre-tokens as ragged numpy arrays (``bpe.Merger``), applies the
lowest-rank pair of each sequence at once, round by round, and counts the surviving symbols.
Nothing is shuffled; memory is one pass of texts (2 MB, or one longer text) and a bounded
store of distinct pre-tokens in each Python worker.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null;
repeated rows are each counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeflow.llm.bpe import merger
from episodeflow.llm.common import passes


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of each row's whole text."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merger(path)
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                _, n = table.encode(data, offsets, ids=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
