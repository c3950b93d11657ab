"""Exact token counts of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written

#: The public vocabulary; a parameter, never copied.
VOCABULARY = "byte_bpe_50k.tiktoken"
_held: dict[str, object] = {}


def encoder(name: str):
    """The vocabulary's encoder, made once a process."""
    if name not in _held:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _held[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[name]


def pattern() -> str:
    """The vocabulary's rule for what merges never cross, with classes of all of Unicode."""
    import public_tokenizers

    return "(?U)" + public_tokenizers.PATTERN


def _lengths(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(name).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"piece": pdf["piece"], "tokens": [len(encode(p)) for p in pdf["piece"]]})

    return run


def token_counts(rows: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``tokens`` of each key: the length of its texts' encoding. Null and empty texts have none.

    Texts are cut into pieces by an expression, pieces are counted for each key before anything moves, and
    the merges are applied once to each distinct piece of the whole table; its length is joined back.
    """
    pieces = rows.select(*keys, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(pattern()), F.lit(0))).alias("piece"))
    counted = written(pieces.groupBy(*keys, "piece").agg(F.count("piece").alias("_times")))
    lengths = written(counted.where("piece IS NOT NULL").select("piece").distinct().mapInPandas(_lengths(vocabulary), "piece string, tokens long"))
    joined = counted.join(lengths, "piece", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_times") * F.col("tokens")), F.lit(0)).alias("tokens"))
