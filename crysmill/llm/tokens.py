"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


def default_vocabulary() -> str:
    """Path of the byte-level BPE ranks that the environment offers; the file is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, enc) -> list[int]:
    """Tokens of a whole text; lone surrogates become the replacement character."""
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def counted(docs: DataFrame, keep: list[str], text: str, vocabulary: str) -> DataFrame:
    """``keep`` columns and n_tokens BIGINT; null and empty texts have none."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            sizes = [len(encode(t, enc)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens BIGINT")


