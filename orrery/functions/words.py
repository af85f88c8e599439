"""Word functions of the correction engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbouring keys of each key (fixed values).
NEIGHBOURS = {
    "q": "wa", "w": "qase", "e": "wsdr", "r": "edft", "t": "rfgy", "y": "tghu", "u": "yhji", "i": "ujko", "o": "iklp", "p": "ol",
    "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn", "k": "jiolm", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}


def deletes(word: Column, distance: int = 1, prefix: int | None = 7) -> Column:
    """Distinct texts that remain of the word's prefix after up to ``distance`` deletions, itself included."""
    head = word if prefix is None else F.substring(word, 1, prefix)
    out = F.array(head)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one_less))))
    return F.filter(out, lambda d: d != "")


def one_less(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def signature(word: Column) -> Column:
    """The word's letters a-z in order."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(F.lower(word), "[^a-z]", ""), "")), "")


def repeated_variants(word: Column) -> Column:
    """The word without one of two equal neighbouring letters."""
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), lambda i: (F.length(word) >= 2) & (F.substring(word, i, F.lit(1)) == F.substring(word, i - 1, F.lit(1))))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def letters_differ(a: Column, b: Column) -> Column:
    """Places, from 1, at which two words of equal length differ."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))


def transposition(a: Column, b: Column) -> Column:
    """Whether swapping two neighbouring letters of one gives the other."""
    at = letters_differ(a, b)
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    swapped = (F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))) & (F.substring(a, j, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return (F.length(a) == F.length(b)) & (F.size(at) == 2) & (j == i + 1) & swapped


def within_one(a: Column, b: Column) -> Column:
    """Whether the optimal string alignment distance is 1 at most."""
    return F.levenshtein(a, b, 1).between(0, 1) | F.coalesce(transposition(a, b), F.lit(False))


def scramble(a: Column, b: Column) -> Column:
    """Equal letters in another order behind an equal first letter, five at least."""
    return (F.length(a) == F.length(b)) & (F.length(a) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (signature(a) == signature(b))


def keyboard_slip(a: Column, b: Column) -> Column:
    """Whether the words differ in one letter, which lies beside the other on the keyboard."""
    at = letters_differ(a, b)
    i = F.get(at, F.lit(0))
    near = F.create_map(*(F.lit(x) for kv in NEIGHBOURS.items() for x in kv))
    return (F.length(a) == F.length(b)) & (F.size(at) == 1) & F.coalesce(F.contains(near[F.substring(a, i, F.lit(1))], F.substring(b, i, F.lit(1))), F.lit(False))


def alignment_within(a: Column, b: Column, limit: int = 2) -> Column:
    """Optimal string alignment distance if it is 2 at most, else 3; ``limit`` 1 or 2. Plain edits are counted by the built-in distance, which stops early. Only
    words that are 3 or 4 plain edits apart can be nearer by swaps: then a swapped pair must part both words so that at most one edit or swap is left
    before or behind it."""
    if limit == 1:
        return F.when(a == b, 0).when(within_one(a, b), 1).otherwise(2)

    def parted(i: Column, s: Column) -> Column:
        pair = (F.substring(a, i, F.lit(1)) == F.substring(b, i + s + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i + s, F.lit(1)))
        head, own = F.substring(a, F.lit(1), i - 1), F.substring(b, F.lit(1), i + s - 1)
        tail, end = F.substring(a, i + 2, F.length(a)), F.substring(b, i + s + 2, F.length(b))
        return (i + s >= 1) & pair & (((head == own) & within_one(tail, end)) | (within_one(head, own) & (tail == end)))

    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.exists(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: parted(i, s)))
    near = F.levenshtein(a, b, 4)
    return F.when(a == b, 0).when(within_one(a, b), 1).when(near == 2, 2).when((near > 2) & (F.length(a) > 1) & swapped, 2).otherwise(3)


def apply_casing(original: Column, word: Column) -> Column:
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    upper = (letters == F.upper(letters)) & (F.length(letters) > 1)
    head = F.substring(original, 1, 1)
    capital = (head == F.upper(head)) & (head != F.lower(head))
    return F.when(upper, F.upper(word)).when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.expr("''"), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
