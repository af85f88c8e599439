"""Local rewrites of prompts: seven actions made of typo fixes, sentence shape, fillers and templates, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

#: Words that are often mistyped (fixed values).
TYPOS = {
    "vidoe": "video", "viede": "video", "chercter": "character", "stlye": "style", "promto": "prompt", "protm": "prompt", "reqeite": "rewrite", "tokesn": "tokens", "maek": "make", "iamge": "image",
}
#: Fillers that a short prompt leaves out, in order, and one that a professional prompt does (fixed values).
FILLERS = ["please ", "i need ", "can you ", "make sure ", "very ", "really "]
CASUAL = " bro"
#: Phrases of video prompts and what stands for them, in order (fixed values).
VIDEO = [(" no text", ". No on-screen text"), (" same character", "Keep the same reference character")]
#: What surrounds the goal of a coding prompt; wording of our own.
CODING = ("Work with care. Goal: ", " Stay within scope, keep it modular and add tests.")
EDGES, WHITE = r",.!?;:", r" \t\n\x0B\f\r"
ACTIONS = ["smart", "optimize", "compress", "professional", "direct", "video", "coding"]


def fix_typos(text: Column) -> Column:
    """Words between single spaces, punctuation at their ends aside, are looked up whatever their case; the text is trimmed."""
    known = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))

    def fixed(word: Column) -> Column:
        core = F.regexp_replace(word, f"^[{EDGES}]+|[{EDGES}]+$", "")
        better = F.element_at(known, F.lower(core))
        # The core is of letters only where it is known, so it may serve as a pattern.
        return F.when(better.isNull(), word).otherwise(F.call_function("regexp_replace", word, F.concat(F.lit("(?i)"), core), better))

    return trimmed(F.array_join(F.transform(F.split(text, " "), fixed), " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def sentence(text: Column) -> Column:
    """Parts between spaces without white space around them, empty ones left out; a capital in front and a mark at the end."""

    def shaped(flat: Column) -> Column:
        first = F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))
        return F.when((flat == "") | F.substring(flat, -1, 1).isin(".", "!", "?"), first).otherwise(F.concat(first, F.lit(".")))

    return let(F.array_join(F.filter(F.transform(F.split(text, " "), trimmed), lambda p: p != ""), " "), shaped)


def without(text: Column, phrases: list[str]) -> Column:
    """The text without some phrases, one after the other, whatever the case."""
    for phrase in phrases:
        text = F.regexp_replace(text, f"(?i){phrase}", "")
    return text


def rewrite(text: Column, action: str) -> Column:
    """A prompt rewritten by one of ``ACTIONS``; others only have typos fixed. A null prompt stays null."""
    fixed = fix_typos(text)
    shaped = sentence(fixed)
    if action == "smart":
        return without(sentence(F.when(shaped == "", fixed).otherwise(shaped)), FILLERS)
    if action == "optimize":
        return F.when(shaped == "", fixed).otherwise(shaped)
    if action in ("compress", "direct"):
        return without(shaped, FILLERS)
    if action == "professional":
        return without(shaped, [CASUAL])
    if action == "video":
        for phrase, to in VIDEO:
            shaped = F.regexp_replace(shaped, f"(?i){phrase}", to)
        return shaped
    if action == "coding":
        return F.concat(F.lit(CODING[0]), shaped, F.lit(CODING[1]))
    return fixed


def all_rewrites(text: Column) -> Column:
    """Array of (action, rewritten): what each action makes of a prompt."""
    return F.array(*(F.struct(F.lit(a).alias("action"), rewrite(text, a).alias("rewritten")) for a in ACTIONS))
