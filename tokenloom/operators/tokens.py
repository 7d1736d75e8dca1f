"""Token counting job (U4).

The default counter is native (``approx_tokens``): a Catalyst regex count that
stays inside whole-stage codegen.  The exact BPE counter is opt-in: it needs a
local vocabulary file (no download), and runs as an iterator pandas UDF with
one encoder per Python worker.  Results carry a ``counter`` column so the two
are never mixed in one table.
"""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import approx_tokens

# Fixed value: the cl100k pre-tokenizer pattern (used with an exact vocabulary).
_CL100K_PATTERN = (r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+""")


def count_tokens_job(files: DataFrame, vocab_path: str | None = None, content_col: str = "content") -> DataFrame:
    """U4: adds ``tokens`` (BIGINT) and ``counter``; never drops a row."""
    if vocab_path is None:
        return files.withColumn("tokens", approx_tokens(content_col)).withColumn("counter", F.lit("approx"))
    return files.withColumn("tokens", _exact_counter(vocab_path)(F.col(content_col))).withColumn(
        "counter", F.lit("cl100k"))


def _exact_counter(vocab_path: str):
    @F.pandas_udf("long")
    def exact_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        ranks = load_tiktoken_bpe(vocab_path)
        enc = tiktoken.Encoding(name="cl100k_local", pat_str=_CL100K_PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
        for s in batches:
            # special markers are encoded as ordinary text: no row is dropped
            yield s.fillna("").map(lambda t: len(enc.encode_ordinary(t))).astype("int64")

    return exact_tokens
