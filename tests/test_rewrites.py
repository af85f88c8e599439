"""The seven local rewrites on prompts whose result is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import rewrites as W

def expected(text):
    """Each action stated anew, word by word."""
    white = " \t\n\x0b\f\r"
    words = []
    for w in text.split(" "):
        core = w.strip(",.!?;:")
        words.append(w.replace(core, W.TYPOS[core.lower()]) if core.lower() in W.TYPOS else w)
    fixed = " ".join(words).strip(white)
    flat = " ".join(p for p in (x.strip(white) for x in fixed.split(" ")) if p)
    shaped = flat and flat[0].upper() + flat[1:] + ("" if flat[-1] in ".!?" else ".")

    def less(t, phrases):
        for p in phrases:
            while (at := t.lower().find(p)) >= 0:
                t = t[:at] + "\0" + t[at + len(p) :]
            t = t.replace("\0", "")
        return t

    video = shaped
    for p, to in W.VIDEO:
        while (at := video.lower().find(p)) >= 0:
            video = video[:at] + to.upper().replace(" ", "\1") + video[at + len(p) :]
        video = video.replace(to.upper().replace(" ", "\1"), to)
    short = less(shaped, W.FILLERS)
    return {"smart": short, "optimize": shaped or fixed, "compress": short, "direct": short, "professional": less(shaped, [W.CASUAL]), "video": video, "coding": W.CODING[0] + shaped + W.CODING[1]}


def test_rewrites(spark):
    texts = ["please maek a VIDOE, ok", "  can you   please help bro ", "draw same character  no text!", "", " \t ", "ünder iamges iamge?", "really very REALLY good", "make sure i need it.", "a\nb  c", "Promto! tokesn; (stlye)"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", W.all_rewrites(F.col("t")).alias("r")).collect()
    for r in rows:
        got = {x["action"]: x["rewritten"] for x in r["r"]}
        assert got == (dict.fromkeys(W.ACTIONS) if r["t"] is None else expected(r["t"])), r["t"]
    assert rows[0]["r"][0]["rewritten"] == "make a video, ok." and rows[2]["r"][5]["rewritten"] == "DrawKeep the same reference character. No on-screen text!"
