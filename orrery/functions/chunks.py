"""How a file's text is cut into chunks: by headings, by declarations, or by size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import code as C
from . import files as P
from . import text as X
from .scopes import FACT

#: Where a declaration begins, by language; our own patterns. The group behind the keyword is its name.
DECLARATIONS = {
    "typescript": r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|class|interface|type|enum|const)[ \t]+([A-Za-z_$][\w$]*)",
    "python": r"(?:async[ \t]+def|def|class)[ \t]+(\w+)",
    "csharp": r"(?:public|private|protected|internal)[ \t]+(?:[\w<>\[\],?]+[ \t]+)*([A-Za-z_]\w*)[ \t]*(?=[({:\n]|$)",
    "sql": r"(?i:create|alter)[ \t]+(?i:or[ \t]+replace[ \t]+)?\w+[ \t]+(?i:if[ \t]+not[ \t]+exists[ \t]+)?([\w.]+)",
    "css": r"([.#@*&]?[A-Za-z_][^{};\n]*?)[ \t]*\{",
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
#: Sizes and overlaps: of plain text, of long sections without headings, with them, of JSON and of long declarations (fixed values).
PLAIN, HEADLESS, SECTION, JSON, DECLARED = (2400, 260), (2600, 200), (2800, 180), (2200, 200), (2800, 260)
#: Lengths from which sections, JSON texts and declarations are cut by size (fixed values).
LONG_SECTION, LONG_JSON, LONG_DECLARED = 3400, 3500, 4200
MOST = 24
FACTS = "array<struct<" + FACT.replace(" ", ": ").replace(",: ", ", ") + ">>"
RANGE = "array<struct<kind: string, symbol: string, start_line: int, end_line: int, body: string>>"


def newlines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n"))


def by_size(text: Column, size: tuple[int, int], kind: str | Column, symbol: Column, first: Column) -> Column:
    """Slices of a text that begins at line ``first``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    cut = X.fixed_chunks(text, *size)
    rows = F.transform(cut, lambda c: F.struct(kind.alias("kind"), symbol.alias("symbol"), (c["start_line"] + first - 1).cast("int").alias("start_line"), (c["end_line"] + first - 1).cast("int").alias("end_line"), c["chunk"].alias("body")))
    return F.coalesce(rows, F.array().cast(RANGE)).cast(RANGE)


def parts_of(text: Column, begins: str, long_: int, size: tuple[int, int], kind: str, name: str) -> Column:
    """One range from each line that begins so to the next; what stands before the first is left out; long ones are cut by size."""

    def cut(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            first = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(1), lambda n, p: n + newlines(p))
            symbol = F.regexp_extract(part, name, 1)
            whole = F.array(F.struct(F.lit(kind).alias("kind"), symbol.alias("symbol"), first.alias("start_line"), (first + newlines(F.rtrim(part)) - F.when(F.endswith(part, F.lit("\n")), 1).otherwise(0)).cast("int").alias("end_line"), part.alias("body")))
            return F.when(F.length(part) > long_, by_size(part, size, kind, symbol, first)).otherwise(whole.cast(RANGE))

        return F.flatten(F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"].rlike("^(?:" + begins + ")")), lambda x: one(x["p"], x["i"])))

    return X.let(F.split(text, r"(?m)(?=^(?:" + begins + "))", -1), cut)


def markdown(text: Column) -> Column:
    """One range for each heading line, named by its first word."""
    found = parts_of(text, "#", LONG_SECTION, SECTION, "section", r"^#+[ \t]*([^\s]*)")
    return F.when(F.size(found) > 0, found).otherwise(by_size(text, HEADLESS, "text", F.lit(""), F.lit(1)))


def json(text: Column) -> Column:
    whole = F.array(F.struct(F.lit("json").alias("kind"), F.lit("").alias("symbol"), F.lit(1).alias("start_line"), (newlines(text) + 1).cast("int").alias("end_line"), text.alias("body")))
    return F.when(F.length(text) < LONG_JSON, whole.cast(RANGE)).otherwise(by_size(text, JSON, "json", F.lit(""), F.lit(1)))


def declared(text: Column, of: str) -> Column:
    begins = r"[ \t]*" + DECLARATIONS[of]
    return parts_of(text, begins, LONG_DECLARED, DECLARED, "symbol", "^" + begins)


def ranges(path: Column, text: Column, most: int = MOST) -> Column:
    """The chunks of a file, ``most`` at most (the index's own limit for a file): by its language, and by size where that finds none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")
    of = P.language(path)

    def cut(body: Column) -> Column:
        found = F.when(of == "markdown", markdown(body)).when(of == "json", json(body))
        for name in DECLARATIONS:
            found = found.when(of == name, declared(body, name))
        found = F.coalesce(found, F.array().cast(RANGE))
        found = F.when(F.size(found) > 0, found).otherwise(by_size(body, PLAIN, "text", F.lit(""), F.lit(1)))
        return F.slice(F.filter(found, lambda r: F.trim(r["body"]) != ""), 1, most)

    return X.let(body, cut)


def scoped_ranges(text: Column, facts: Column, most: int = MOST) -> Column:
    """The chunks of a file whose facts are known (see :mod:`.scopes`): one for each type, function, method and property, members inside their types included,
    with its kind and parent. Empty where nothing is declared. facts: a column that is already there, since Spark
    takes no Python function inside a transformation."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")

    def cut(body: Column) -> Column:
        own = F.filter(F.coalesce(facts, F.array().cast(FACTS)), lambda f: f["fact"] == "symbol")
        rows = F.transform(own, lambda f: F.struct(F.concat(F.lit("code_"), f["kind"]).alias("kind"), f["label"].alias("symbol"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"), F.substring(body, f["begin"] + 1, f["stop"] - f["begin"]).alias("body"), f["parent"].alias("parent")))
        return F.slice(F.filter(rows, lambda r: F.trim(r["body"]) != ""), 1, most)

    return X.let(body, cut)


def summary(text: Column, role: Column, symbols: Column) -> Column:
    """The comment at a file's head (160 characters), else its role and first three symbols."""
    comment = X.clean(F.regexp_replace(F.regexp_extract(text, r"^\s*(/\*[\s\S]*?\*/|(?:(?://|#)[^\n]*\n?)+)", 1), r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+!?)|\*+/", " "))
    short = F.when(F.length(comment) > 160, F.concat(F.substring(comment, 1, 160), F.lit("..."))).otherwise(comment)
    names = F.array_join(F.slice(symbols, 1, 3), ", ")
    return F.when(comment != "", short).when(names != "", F.concat(role, F.lit(" file: "), names)).otherwise(F.concat(role, F.lit(" file")))


def embedded(chunk: dict[str, Column]) -> Column:
    """The text that is embedded for a chunk: a labelled head and its body. Takes ``path``, ``language``, ``kind``, ``symbol``, ``parent``, ``imports``, ``body``."""
    named = lambda c: F.when(X.blank(c), "none").otherwise(c)
    imports = F.when(F.size(chunk["imports"]) > 0, F.array_join(F.slice(chunk["imports"], 1, 12), ", ")).otherwise("none")
    heads = [("File", chunk["path"]), ("Language", chunk["language"]), ("Type", chunk["kind"]), ("Symbol", named(chunk["symbol"])), ("Parent", named(chunk["parent"])), ("Imports", imports)]
    return F.concat(F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in heads)), F.lit("\n\nCode/Text:\n"), chunk["body"])
