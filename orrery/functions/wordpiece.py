"""WordPiece: greedy longest match against a vocabulary, which is an input."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 100


def words(text: str) -> list[str]:
    """Lower-cased words without accents; each mark of punctuation or symbol is a word."""
    out, own = [], []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        if c.isspace() or kind[0] in "PS":
            if own:
                out.append("".join(own))
                own = []
            if not c.isspace():
                out.append(c)
        else:
            own.append(c)
    return [*out, "".join(own)] if own else out


def pieces(word: str, vocabulary: dict[str, int], unknown: int) -> list[int]:
    if len(word) > LONGEST:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (found := vocabulary.get(("##" if at else "") + word[at:end])) is not None:
                out.append(found)
                at = end
                break
        else:
            return [unknown]
    return out


def encode(text: str | None, vocabulary: dict[str, int], most: int = 256) -> list[int]:
    """Ids between those of ``[CLS]`` and ``[SEP]``, ``most`` at most."""
    body = [i for w in words(text or "") for i in pieces(w, vocabulary, vocabulary["[UNK]"])]
    return [vocabulary["[CLS]"], *body[: max(0, most - 2)], vocabulary["[SEP]"]]


def wordpiece(text: Column, vocabulary: dict[str, int], most: int = 256) -> Column:
    """Array of ids. The vocabulary travels with the task: some ten thousand entries."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t, vocabulary, most) for t in texts])

    return ids(text)
