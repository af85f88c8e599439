"""Prompt analytics and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, contains_any, redact, token_estimate

#: Task types by words, first match wins (fixed values).
TASKS = {
    "Ui": ["animation", "animate", "transition", "scroll", "parallax", "design", "ui", "layout", "style", "css", "color", "responsive", "page look"],
    "Bugfix": ["bug", "error", "crash", "not working", "broken", "fails", "exception", "undefined", "null reference"],
    "Refactor": ["refactor", "clean up", "restructure", "rename", "extract", "simplify"],
    "Debug": ["debug", "why is", "investigate", "trace", "log", "reproduce"],
    "Test": ["test", "unit test", "coverage", "spec"],
    "Docs": ["doc", "readme", "comment", "explain in docs"],
    "Feature": ["add", "create", "build", "implement", "new feature", "support"],
}
#: Phrases that say little, cues of code, words that set limits (fixed values).
VAGUE = ["make it better", "make this better", "fix this", "fix it", "change the design", "improve this", "do something", "make it nice", "clean it up", "make it work"]
CUES = [".tsx", ".ts", ".js", ".jsx", ".cs", ".py", ".css", "component", "function", "file", "route", "endpoint"]
LIMITS = ["keep", "don't", "only"]
#: Fillers that a rewrite drops; our own list.
FILLERS = ["please", "just", "really", "basically", "actually", "kind of", "maybe"]


def task_type(low: Column) -> Column:
    out = F.lit("Unknown")
    for name, needles in reversed(TASKS.items()):
        out = F.when(contains_any(low, needles), name).otherwise(out)
    return out


def clarity(low: Column, words: Column) -> Column:
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.5 - plus(contains_any(low, VAGUE), 0.3) + plus(words >= 6, 0.15) + plus(words >= 14, 0.1) - plus(words <= 3, 0.2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + plus(contains_any(low, CUES), 0.2) + plus(contains_any(low, LIMITS), 0.05)))


#: What a prompt is after, by task (our own wording).
INTENT = {"Ui": "Change what the user sees", "Bugfix": "Mend something that is broken", "Refactor": "Restructure without other effects", "Debug": "Find out why something happens", "Feature": "Add something new", "Test": "Add or improve tests", "Docs": "Write documentation"}


def context_score(low: Column, found: Column, total: Column, named: Column) -> Column:
    """What is known of a prompt's project: .35, more by the scores of the ``found`` files, .15 if the prompt names one of them."""
    more = F.when(found > 0, F.least(F.lit(0.4), 0.15 * total + 0.05 * found)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.35 + more + F.when(named, 0.15).otherwise(0.0)))


def retrieved_for(prompts: DataFrame, retrieved: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """retrieved: the keys of prompts, ``path``, ``role``, ``score``. Adds ``found``, ``total``, ``named`` (a file's stem is in the prompt), ``shown`` (a component, route or style is
    among them) to prompts; one row each, whatever was retrieved."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    rows = retrieved.join(prompts.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")), keys)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("found"), F.sum("score").alias("total"), F.max((stem != "") & F.contains("_text", stem)).alias("named"), F.max(F.col("role").isin("Component", "Route", "Style")).alias("shown"))
    return prompts.join(sums, keys, "left").fillna({"found": 0, "total": 0.0, "named": False, "shown": False})


def analyze(prompts: DataFrame, text: str = "text", indexed: bool = True) -> DataFrame:
    """Adds ``task``, ``intent``, ``clarity``, ``context``, ``quality``, ``missing`` (array), ``ask_more``, ``risk`` and ``reason``. prompts may carry what was retrieved for them (see
    :func:`retrieved_for`); without that, no file was. indexed: whether there is a project."""
    have = prompts.columns
    col = lambda c, x: F.col(c) if c in have else F.lit(x)
    found, total, named, shown = col("found", 0), col("total", 0.0), col("named", False), col("shown", False)
    flat = clean(F.coalesce(F.col(text), F.lit("")))
    words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))
    rows = prompts.withColumns({"_low": F.lower(flat), "_words": words})
    rows = rows.withColumns({"task": task_type(F.col("_low")), "clarity": F.round(clarity(F.col("_low"), F.col("_words")), 4)})
    intent = F.coalesce(F.create_map(*(F.lit(x) for kv in INTENT.items() for x in kv))[F.col("task")], F.when(F.col("_low") != "", "General help with code").otherwise("Unclear"))
    rows = rows.withColumns({"intent": intent, "context": F.round(context_score(F.col("_low"), found, total, named), 4) if indexed else F.lit(0.2)})
    rows = rows.withColumn("quality", F.bround(0.55 * F.col("clarity") + 0.45 * F.col("context"), 2))
    rows = rows.withColumn("missing", missing_context(F.col("task"), F.col("_low"), F.col("_words"), found, shown, indexed))
    rows = rows.withColumn("ask_more", (F.col("clarity") < 0.45) | ((F.col("quality") < 0.5) & (F.size("missing") > 0)))
    risk = F.when((F.col("clarity") < 0.4) | ((F.col("context") < 0.4) & (found == 0)), "High").when(F.col("quality") >= 0.7, "Low").otherwise("Medium")
    reason = F.when(F.col("ask_more"), "vague").when(F.col("context") >= 0.6, "clear, with files of the project").otherwise("workable; name the files")
    return rows.withColumns({"risk": risk, "reason": reason}).drop("_low", "_words")


def shorten(text: Column) -> Column:
    """Drops fillers, collapses white space, starts with a capital and ends with a full stop."""
    out = F.regexp_replace(text, r"(?i)\b(" + "|".join(FILLERS) + r")\b", "")
    out = clean(out)
    out = F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))
    return F.when(out.rlike(r"[.!?]$") | (out == ""), out).otherwise(F.concat(out, F.lit(".")))


def imperative(text: Column) -> Column:
    flat = clean(text)
    flat = F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))
    return F.when(flat.rlike(r"\.$") | (flat == ""), flat).otherwise(F.concat(flat, F.lit(".")))


def preferences(prompts: DataFrame, text: str = "text") -> DataFrame:
    """``signal``, ``rows``, ``preferred``: rows that hold a signal, and whether they reach max(2, a fifth of all rows)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sums = prompts.agg(F.count("*").alias("n"), *(F.count(F.when(contains_any(low, v), 1)).alias(k) for k, v in SIGNALS.items()))
    return sums.select("n", F.explode(F.create_map(*(x for k in SIGNALS for x in (F.lit(k), F.col(k))))).alias("signal", "rows")).select("signal", "rows", (F.col("rows") >= F.greatest(F.lit(2), F.floor(F.col("n") / 5))).alias("preferred"))


SIGNALS = {"full_code": ["full code", "complete code", "whole file"], "minimal": ["only", "minimal", "small change"], "explain": ["explain", "why"], "tests": ["test", "spec"]}


def usage(events: DataFrame, action: str, before: str, after: str) -> DataFrame:
    """Per action: events, sums before and after, what was saved and the percent of it."""
    sums = events.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"), F.sum(before).alias("before"), F.sum(after).alias("after"))
    saved = F.greatest(F.lit(0.0), F.col("before") - F.col("after"))
    return sums.select("action", "n", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round(saved, 4).alias("saved"), F.when(F.col("before") > 0, F.bround(100 * saved / F.col("before"), 2)).otherwise(0.0).alias("percent"))


def saved_tokens(files: Column, before: Column, after: Column, improved_longer: Column) -> Column:
    """Tokens that a better prompt saves downstream, 150 at least."""
    gain = 180 * files + F.when(improved_longer, 220).otherwise(120) + F.when(before < 25, 650).otherwise(320)
    return F.greatest(F.lit(150), gain - F.greatest(F.lit(0), after - before)).cast("int")


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.greatest(F.lit(0.0), F.bround((1 - after / before) * 100, 0))).otherwise(0.0).cast("int")


def missing_context(task: Column, low: Column, words: Column, found: Column, shown: Column | None = None, indexed: bool = True) -> Column:
    """What a prompt should say but doesn't. found: how many files it matched; shown: whether one of them is a component, route or style."""
    picture = contains_any(low, ["image", "screenshot", "match the"])
    shown = F.lit(False) if shown is None else shown
    return F.array_compact(
        F.array(
            F.lit(None) if indexed else F.lit("project"),
            F.when((found == 0) & F.lit(indexed), "target file"),
            F.when((task == "Ui") & picture, "reference image"),
            F.when((task == "Ui") & ~picture & ~shown, "component or page"),
            F.when(task.isin("Bugfix", "Debug") & ~contains_any(low, ["error", "expected"]), "exact error"),
            F.when((task == "Feature") & (words < 8), "acceptance criteria"),
        )
    )


#: Headings that a compact prompt drops, marks behind which a writer's text ends (fixed values).
HEADINGS = ["Goal:", "Context:", "Steps:", "Acceptance:", "Constraints:"]
FILE_MARKS = ["Files:", "File:", "Relevant files:", "Necessary files:", "Necessary files for this task:", "Read at files:"]
WRITER_MARKS = ["Return strict JSON", '{"optimizedPrompt"']
#: What is said last, by agent; our own wording.
TAILS = {"cli": "Read the listed regions first and change as little as possible.", "cloud": "Read the listed regions first and stay within scope."}
#: Repeated tokens of prompts that show a preference, with its label (fixed values).
ANIMATIONS = {"gsap": "GSAP", "lenis": "Lenis", "framer": "Framer Motion", "anime": "anime.js"}


def flattened(text: Column, original: Column) -> Column:
    """A prompt on one line without headings; blank ones give the original."""
    body = F.regexp_replace(text, "(?i)" + "|".join(HEADINGS), "")
    return F.when(F.coalesce(clean(text), F.lit("")) == "", clean(original)).otherwise(clean(body))


def cut_at(text: Column, marks: list[str]) -> Column:
    """The text up to the first line that begins with a mark, whatever the case."""
    quoted = "|".join(m.replace("{", r"\{") for m in marks)
    return F.trim(F.regexp_replace(text, r"(?is)\r?\n(?:" + quoted + ").*$", ""))


def capped(text: Column, over: int = 55, keep: int = 45) -> Column:
    """The first ``keep`` words and a full stop, if there are more than ``over`` (the contract's lengths)."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.when(F.size(words) > over, F.concat(F.array_join(F.slice(words, 1, keep), " "), F.lit("."))).otherwise(text)


def writer_output(text: Column) -> Column:
    """What a writer model gave, from its first brace to its last; null where that is no JSON with a prompt."""
    schema = "optimizedPrompt string, taskType string, relevantFiles array<string>, tasks array<string>, constraints array<string>, warnings array<string>"
    got = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    return F.when(F.trim(F.coalesce(got["optimizedPrompt"], F.lit(""))) != "", got)


def line_text(rows: Column) -> Column:
    """A result as a line: its path, its lines if it has some, and its symbol or kind."""
    label = F.when(F.trim(F.coalesce(rows["symbol"], F.lit(""))) == "", rows["kind"]).otherwise(rows["symbol"])
    at = F.when((rows["start_line"] > 0) & (rows["end_line"] > 0), F.concat_ws("", F.lit(":"), rows["start_line"].cast("string"), F.lit("-"), rows["end_line"].cast("string"))).otherwise("")
    return F.concat(F.lit("- "), rows["path"], at, F.lit(" ("), label, F.lit(")"))


def assembled(prompts: DataFrame, hits: DataFrame, keys: list[str], agent: str | None = None) -> DataFrame:
    """prompts: the keys, ``body``, ``original``; hits: the keys, ``path``, ``symbol``, ``kind``, ``start_line``, ``end_line``, ``score``, ``id`` (already limited, see :func:`search.line_hits`). Adds
    ``prompt``: the body on one line, the lines to read, the agent's last words; and ``n_hits``."""
    h = F.struct((-F.col("score")).alias("order"), "id", *(F.col(c) for c in ("path", "symbol", "kind", "start_line", "end_line")))
    listed = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias("_hits"))
    rows = prompts.join(listed, keys, "left").withColumn("n_hits", F.coalesce(F.size("_hits"), F.lit(0)))
    rows = rows.withColumn("n_hits", F.greatest("n_hits", F.lit(0)))
    body = flattened(F.col("body"), F.col("original"))
    text = F.when(F.col("n_hits") > 0, F.concat(body, F.lit("\n\nRead at files:\n"), F.array_join(F.transform("_hits", line_text), "\n"))).otherwise(body)
    tail = TAILS.get(agent or "")
    return rows.withColumn("prompt", F.concat(text, F.lit(f"\n\n{tail}")) if tail else text).drop("_hits")


def compiled(prompts: DataFrame, hits: DataFrame, keys: list[str], text: str = "text", agent: str | None = None, written: str | None = None) -> DataFrame:
    """A prompt from its text and hits. written: a column of a writer model's output; where it is usable its prompt is taken (cut at marks, capped), else a
    template. Adds ``prompt``, ``short``, ``used_writer``, ``warning``, ``n_hits``, ``token_change``, ``retries_saved``, ``confidence``."""
    flat = clean(F.coalesce(F.col(text), F.lit("")))
    got = writer_output(F.col(written)) if written else F.lit(None).cast("struct<optimizedPrompt: string, tasks: array<string>>")
    rows = prompts.withColumn("_got", got).withColumn("used_writer", F.col("_got").isNotNull())
    made = F.concat(imperative(flat), F.lit(" Read only the listed regions. Change as little as possible."))
    body = F.when(F.col("used_writer"), capped(cut_at(cut_at(F.col("_got.optimizedPrompt"), FILE_MARKS), WRITER_MARKS))).otherwise(made)
    rows = assembled(rows.withColumns({"body": body, "original": F.coalesce(F.col(text), F.lit(""))}), hits, keys, agent)
    short = F.coalesce(F.get(F.col("_got.tasks"), F.lit(0)), imperative(flat))
    warning = F.when(~F.col("used_writer"), F.lit("writer unavailable" if written is None else "writer unusable"))
    change = token_estimate(F.col("prompt")) - token_estimate(F.coalesce(F.col(text), F.lit("")))
    hit = F.col("n_hits") > 0
    return rows.withColumns({"short": short, "warning": warning, "token_change": change, "retries_saved": F.when(hit, 1.4).otherwise(0.5), "confidence": F.when(hit, 0.82).otherwise(0.62)}).drop("_got", "body", "original")


def outcome(indexed: Column, hits: Column, used_writer: Column) -> Column:
    """How a request ended."""
    return F.when(~indexed, "NotIndexed").when((hits > 0) | used_writer, "Ready").otherwise("Fallback")


def structured(prompts: DataFrame, files: DataFrame, keys: list[str], text: str = "text", most: int = 8) -> DataFrame:
    """prompts: of :func:`analyze`; files: the keys, ``path``, ``score``. ``kind`` (Question where more must be asked), ``prompt`` (Task, Context, Files, Instructions), ``short`` and
    ``sureness`` (.4 + .55 quality)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "path")
    top = files.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most)
    listed = top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "path"))), lambda x: x["path"]).alias("_files"))
    rows = prompts.join(listed, keys, "left").withColumn("_files", F.coalesce("_files", F.array().cast("array<string>")))
    flat = clean(F.coalesce(F.col(text), F.lit("")))
    missing = F.when(F.size("missing") > 0, F.concat(F.lit("Missing: "), F.array_join("missing", ", "))).otherwise("Complete")
    names = F.when(F.size("_files") > 0, F.concat(F.lit("Files:\n- "), F.array_join("_files", "\n- "))).otherwise("Files: none found")
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Task: "), imperative(flat)), F.concat(F.lit("Context: "), F.col("intent"), F.lit(". "), missing), names, F.lit("Instructions: change as little as possible."))
    return rows.withColumns({"kind": F.when(F.col("ask_more"), "Question").otherwise("ImprovedPrompt"), "prompt": redact(prompt), "short": redact(imperative(flat)), "sureness": F.round(0.4 + 0.55 * F.col("quality"), 4)}).drop("_files")


def repeated_tokens(prompts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """``label``, ``n``: tokens of a list that stand ``least`` times or more in all prompts together."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    sums = prompts.agg(*(F.coalesce(F.sum(F.regexp_count(low, F.lit(k))), F.lit(0)).alias(v) for k, v in ANIMATIONS.items()))
    return sums.select(F.explode(F.create_map(*(x for v in ANIMATIONS.values() for x in (F.lit(v), F.col(f"`{v}`"))))).alias("label", "n")).filter(F.col("n") >= least)


def agent_label(agent: Column, labels: dict[str, str]) -> Column:
    """labels: an input, since agents and models change."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.lower(agent)], F.lit("Generic")) if labels else F.lit("Generic")


def payload(results: DataFrame, most: int = 5, size: int = 700) -> DataFrame:
    """results: ``id``, ``path``, ``score``, ``body``. One row ``json``: the best results with trimmed bodies."""
    top = results.orderBy(F.desc("score"), "id").limit(most)
    rows = top.select(F.struct((-F.col("score")).alias("order"), "id", "path", F.substring("body", 1, size).alias("body")).alias("r"))
    listed = rows.agg(F.sort_array(F.collect_list("r")).alias("r"))
    return listed.select(F.to_json(F.transform("r", lambda r: F.struct(r["id"].alias("id"), r["path"].alias("path"), r["body"].alias("body")))).alias("json"))
