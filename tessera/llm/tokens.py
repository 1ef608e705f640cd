"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary is read where it lies; every executor has it at the same place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text before merging that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text_col: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of each text in place of the text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [n if i == at else c for i, c in enumerate(batch.columns)], [out if i == at else name for i, name in enumerate(batch.schema.names)]
            )

    schema = ", ".join(f"`{out}` bigint" if f.name == text_col else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def sizes(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, **more: str) -> DataFrame:
    """``(id, n_tokens, *more)``; ``more`` names further columns to keep."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *[F.col(c).alias(n) for n, c in more.items()])
    return with_token_counts(kept, "__text", "n_tokens", vocabulary)
