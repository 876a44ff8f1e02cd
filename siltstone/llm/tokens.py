"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_loaded: dict = {}


def encoding(path: str):
    """The byte-level tokenizer of a ``.tiktoken`` vocabulary, kept per worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(
            os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, *keep: str) -> DataFrame:
    """``doc_id, n_tokens`` and the columns to keep, one row per distinct id;
    a null text has no tokens, rows with a null id are left out."""

    def run(batches):
        enc = encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.asarray(n, dtype=np.int64)), *[batch.column(c) for c in keep]],
                names=["doc_id", "n_tokens", *keep],
            )

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "n_tokens long", *[f"{c} {types[c]}" for c in keep]])
    one = docs.where("doc_id is not null").select("doc_id", "text", *keep)
    return one.mapInArrow(run, schema).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), *[F.min(c).alias(c) for c in keep])
