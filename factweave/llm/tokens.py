"""Sizes in tokens of a public tokenizer, and ranks within a key that no single task has to sort."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the ranks of the tokenizer are; they belong to the machine, not to the repository.
TOKENIZER = os.environ.get("FACTWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# How byte-level BPE cuts a text into pieces before it merges bytes; no token reaches over two pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose size is kept at hand.
CACHE = 300_000


class Sizer:
    """Counts tokens piece by piece, so that a piece that comes again is looked up; nothing but numbers is kept of a text."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(PIECES).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        known, total = self.known, 0
        for piece in self.pieces(text or ""):
            size = known.get(piece)
            if size is None:
                if len(known) >= CACHE:
                    known.clear()
                size = known[piece] = len(self.encode(piece))
            total += size
        return total


_loaded: dict[str, Sizer] = {}


def count_tokens(texts: Iterable[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of whole texts; 0 for null and empty ones."""
    if path not in _loaded:
        _loaded[path] = Sizer(path)
    return [_loaded[path](t) for t in texts]


def with_tokens(documents: DataFrame, text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The documents with a column tokens; whole texts are encoded."""

    @F.pandas_udf("int")
    def size(text: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(text, path), dtype="int32")

    return documents.withColumn("tokens", size(F.col(text_col)))


def place_by_rank(rows: DataFrame, keys: list[str], identity: list[str], plan: DataFrame, seed: int = 0, buckets: int = 64) -> DataFrame:
    """The rows with rank_ (from 0) within their key, in the order of a seeded hash of their identity, and the columns of the run of
    the plan that holds this rank; rows of no run are left out.

    plan: the keys (not null), first_rank, end_rank and further columns; runs of one key do not overlap. A key is cut into ranges of
    the hash, each sorted alone, and the counts of the ranges before it are added: a key with a third of all rows is spread over
    `buckets` tasks. The plan is joined to the ranges, of which there are at most `buckets` a key, and with them to the rows by the
    partitioning they were ranked in. Equal rows get different ranks in an arbitrary but complete order.
    """
    hashed = rows.withColumn("h_", F.xxhash64(*identity, F.lit(seed)))
    hashed = hashed.withColumn("bucket_", (F.shiftrightunsigned(F.col("h_"), 32) * buckets / F.lit(float(1 << 32))).cast("int"))
    counts = hashed.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    ranges = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy(*keys).orderBy("bucket_")) - F.col("n_"))
    met = ranges.join(plan, keys).where((F.col("first_rank") < F.col("before_") + F.col("n_")) & (F.col("end_rank") > F.col("before_"))).drop("n_")
    local = F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy("h_", *identity)) - 1
    ranked = hashed.withColumn("local_", local).drop("h_")
    placed = ranked.join(met, [*keys, "bucket_"]).withColumn("rank_", F.col("local_") + F.col("before_"))
    return placed.where((F.col("rank_") >= F.col("first_rank")) & (F.col("rank_") < F.col("end_rank"))).drop("bucket_", "local_", "before_")
