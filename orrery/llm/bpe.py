"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that never stand side by side inside any vocabulary token can never end up in one token. A word is cut at
each such pair; the fragments are encoded independently and their ids concatenated, which gives the ids of the whole word.

Text is prepared as the vocabulary file says: special tokens are found in the raw text, the rest is brought to NFC, lower-cased and
split into words. For texts in which all characters lie below U+0250 (except U+0130) NFC is the identity, and a pattern splits the
words; other texts go through the file's own normalizer and splitter.

Cases: null and empty texts have no ids and decode to an empty text; texts of any length are read whole; merges inside a fragment use
a heap, so a fragment of n symbols takes n log n steps. Rows aren't compared, so repeated rows, ties and null ids pass unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import arrow_bounds

#: Characters between words, as the vocabulary's patterns take white space below U+0250.
WHITE = r"\t-\r \x85\xa0"
CACHED, CACHED_CHARS, SHORT = 300_000, 64, 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes and decodes with one vocabulary file of the ``tokenizers`` format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or spec["decoder"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("only BPE vocabularies without decoder, unknown token and subword prefix are read")
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.number = {i: str(i) for i in self.token}
        self.inside = {pair for t in self.vocab for pair in self.pairs(t)}
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in byte} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in byte)}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.plain = regex.compile(r"[\x00-įı-ɏ]*")
        self.known: dict[str, tuple[int, str, str]] = {}

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def pairs(self, token: str) -> zip:
        """Neighbouring symbols inside a token."""
        end = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        parts = self.symbols(token[: -len(self.suffix)]) if end else list(token)
        return zip(parts, parts[1:], strict=False)

    def fragments(self, word: str) -> list[list[str]]:
        """Symbols of a word of byte letters, cut wherever no token can reach across."""
        symbols = self.symbols(word)
        out = [[symbols[0]]]
        for pair in zip(symbols, symbols[1:], strict=False):
            if pair in self.inside:
                out[-1].append(pair[1])
            else:
                out.append([pair[1]])
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair is joined first, the leftmost of equals."""
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, rank, made = len(ids), self.rank, self.made
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            least, i, p = heapq.heappop(heap)
            j = after[i]
            if ids[i] != p[0] or j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j] = made[least], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0 and (p := (ids[at], ids[after[at]])) in rank:
                    heapq.heappush(heap, (rank[p], at, p))
        return [i for i in ids if i >= 0]

    def word(self, letters: str) -> list[int]:
        return [i for part in self.fragments(letters) for i in self.merge(part)]

    def entry(self, word: str, letters: str | None = None) -> tuple[int, str, str]:
        """Of a word: number of ids, ids and tokens, each joined by spaces. letters: its byte letters, where they are known; the word
        then starts with a space, which no other word holds."""
        if (found := self.known.get(word)) is None:
            ids = self.word(letters or "".join(self.letter[b] for b in word.encode()))
            found = len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])
            if len(word) <= CACHED_CHARS:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[word] = found
        return found

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        out = []
        for part in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if part in self.special:
                out.append((1, str(self.special[part]), part))
            elif self.plain.fullmatch(part):
                known, entry = self.known.get, self.entry
                out += [known(w) or entry(w) for w in self.words.findall(part.lower())]
            else:
                for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(self.entry(f" {letters}", letters))
        return [x for x in out if x[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self.entries(text or "") for i in x[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by spaces and of the decoded text."""
        found = self.entries(text or "")
        ids, tokens = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


@lru_cache(maxsize=4)
def encoder(path: str | None) -> Encoder:
    """A worker's encoder. Without a path, the vocabulary file is found where the worker runs."""
    return Encoder(path or default_path())


def bpe_encode(text: Column, path: str | None = None) -> Column:
    """Array of ids of each text."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([e.encode(x) for x in texts])

    return encode(text)


def bpe_decode(ids: Column, path: str | None = None) -> Column:
    """Text of each array of ids; a null array decodes to an empty text, unknown ids are left out."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([e.decode(x if x is not None else []) for x in rows])

    return decode(ids)


def bpe_digest(text: Column, path: str | None, spark) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text, encoded and decoded in one pass."""
    arrow_bounds(spark)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        return pd.DataFrame([e.digest(x) for x in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)
