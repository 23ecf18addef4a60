"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import free_name, need

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the vocabulary's word pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, made once in each Python process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _counter(path: str, col: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(col).to_pylist()]
            cols = [c for i, c in enumerate(b.columns) if i != col]
            names = [n for i, n in enumerate(b.schema.names) if i != col]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    return run


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``, the whole text's size; NULL and empty texts have 0 tokens.

    ``path`` names the vocabulary file, which every executor must be able to read.
    """
    need(df, text, *keep)
    if "n_tokens" in keep:
        raise ValueError("n_tokens is also an input column")
    t = free_name(df.select(*keep), "_text")
    picked = df.select(*keep, F.col(text).alias(t))
    schema = T.StructType([f for f in picked.schema.fields if f.name != t] + [T.StructField("n_tokens", T.LongType())])
    return picked.mapInArrow(_counter(path, len(keep)), schema)
