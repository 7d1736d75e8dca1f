"""U4: the native counter and the opt-in exact BPE counter (local vocabulary file)."""
from __future__ import annotations

import base64

import pytest

from tokenloom.operators.tokens import count_tokens_job


def test_native_counter(spark):
    df = spark.createDataFrame([("p", "a.py", "def f(x):\n    return x + 1\n"), ("p", "b.md", None)],
                               "project string, path string, content string")
    got = {r.path: (r.tokens, r.counter) for r in count_tokens_job(df).collect()}
    assert got["b.md"] == (0, "approx")
    assert got["a.py"][0] > 5


def test_exact_counter_with_local_vocabulary(spark, tmp_path):
    """A byte-level vocabulary (256 single-byte tokens, no merges): every UTF-8
    byte is one token, so the expected count is the byte length."""
    pytest.importorskip("tiktoken")
    vocab = tmp_path / "bytes.tiktoken"
    vocab.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    texts = ["hello world", "naïve café <|endoftext|>", ""]
    df = spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], "project string, path string, content string")
    got = {r.path: (r.tokens, r.counter) for r in count_tokens_job(df, vocab_path=str(vocab)).collect()}
    for i, t in enumerate(texts):
        assert got[f"f{i}"] == (len(t.encode("utf-8")), "cl100k")
