"""Counting and cutting texts by a model's tokens, from a vocabulary file whose path is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from legispark.functions.text import token_count

#: Counts that a worker remembers.
MEMORY = 50_000


class Tokens:
    """Counts with special tokens, cuts and tails, as the vocabulary in ``path`` (a tokenizer's JSON file) splits texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self.count = lru_cache(MEMORY)(self._count)
        self.special = self._count("")

    def _count(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=True).ids)

    def split(self, text: str, most: int) -> list[str]:
        """Pieces of at most ``most`` tokens, special ones included, cut between tokens."""
        if most <= self.special:
            raise ValueError(f"at least {self.special + 1} tokens are needed")
        spans = [(a, b) for a, b in self._tokenizer.encode(text, add_special_tokens=False).offsets if b > a]
        if not spans:
            return [text] if text else []
        room = most - self.special
        # A character may be several tokens, so a piece begins where the one before it ended.
        ends = [spans[min(k + room, len(spans)) - 1][1] for k in range(0, len(spans), room)]
        pieces = (text[a:b].strip() for a, b in zip([spans[0][0], *ends], ends, strict=False))
        return [p for p in pieces if p]

    def tail(self, text: str, most: int) -> str:
        """The last piece."""
        return (self.split(text, most) or [""])[-1]


@lru_cache(4)
def load(path: str) -> Tokens:
    return Tokens(path)


def counter(path: str | None = None) -> Callable[[str], int]:
    """The counter that chunking takes: the model's if a path is given, else words and marks."""
    if path is not None:
        return load(path).count
    from legispark.operators.chunking import approximate_tokens

    return approximate_tokens


def model_token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text: exact where a vocabulary is given, whose file every worker can read; else the native approximation. A null has none."""
    if path is None:
        return token_count(text)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = load(path)
        for batch in batches:
            yield batch.map(lambda t: tokens.count(t) if t is not None else 0).astype("int64")

    return count(text)
