"""Queries over source files that hold whole texts of the tables: scripts of pages, and files in which each document's text stands in a comment or a string,
where it must hide nothing and declare nothing. SQL counts the text's lines to say where what surrounds it must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as K
from ..functions import scopes as S
from ..functions import text as X
from ..operators import graph as G
from ..operators import rewrites as W
from ..operators import search as R
from ..operators import structure as ST
from ..operators.trigrams import Trigrams
from ..sources.buckets import Buckets
from .queries import LIKE, TERMS, documents, query, table

#: A file of each family: {t} is the text, {i} the id. Each declares a type, a member with a head of two lines, and calls.
JS = "/* {t}*/\nimport {{ a }} from './m{i}';\nexport class C{i} {{\n  run(a,\n      b = {{}}) {{\n    // no0(1)\n    return go(a, 'no1(2)', `${{deep(b)}} no2()`);\n  }}\n}}\nconst f{i} = async (x) => {{\n  wait(x);\n}};\n"
CSHARP = "using M{i}.Part;\nnamespace N\n{{\n  public class C{i}\n  {{\n    private string held = @\"{t}\";\n    public int Size => held.Length;\n    public bool Run(int a,\n        int b)\n    {{\n      return Go(a, \"class No {{ }}\");\n    }}\n  }}\n}}\n"
GO = "package p\nimport \"m{i}\"\nvar held = `{t}`\ntype C{i} struct {{\n  x int\n}}\nfunc (c *C{i}) Run(a int,\n  b int) {{\n  m.Go(a, \"func No() {{}}\")\n}}\n"
PYTHON = "import m{i}\nclass C{i}:\n    \"\"\" {t}\"\"\"\n    async def run(self, a,\n                  b=None):\n        # no0(1)\n        return go(a, 'no1(2)')\n"
SHAPES = [("src/a{i}.ts", JS), ("src/a{i}.cs", CSHARP), ("src/a{i}.go", GO), ("src/a{i}.py", PYTHON)]


def quoted(text: Column, of: int) -> Column:
    """A text that may stand where the family's template has it."""
    marks = {0: ("*/", "* /"), 1: ('"', '""'), 2: ("`", "'"), 3: ('"', "'")}[of]
    safe = F.replace(F.replace(text, F.lit("\r"), F.lit(" ")), F.lit(marks[0]), F.lit(marks[1]))
    return F.replace(F.replace(safe, F.lit("\\"), F.lit("/")), F.lit("\x00"), F.lit(" ")) if of == 3 else safe


def files(spark: SparkSession, sf_dir: str, of: int | None = None) -> DataFrame:
    """``doc_id``, ``path``, ``content``, one for each document, in one of four languages, or all in one."""
    i = F.col("doc_id").cast("string")
    path = content = F.lit(None).cast("string")
    for k, (name, shape) in enumerate(SHAPES):
        made = [F.lit(None).cast("string"), F.lit(None).cast("string")]
        for at, template in enumerate((name, shape)):
            parts = [F.concat_ws("", *(x for j, own in enumerate(p.replace("{{", "{").replace("}}", "}").split("{i}")) for x in ([i] if j else []) + [F.lit(own)])) for p in template.split("{t}")]
            made[at] = F.concat(*(x for j, p in enumerate(parts) for x in ([quoted(F.coalesce("text", F.lit("")), k)] if j else []) + [p]))
        own = F.pmod("doc_id", F.lit(4)) == k if of is None else F.lit(of == k)
        path, content = F.when(own, made[0]).otherwise(path), F.when(own, made[1]).otherwise(content)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content"))


#: What SQL expects: family, fact, name, kind, first and last line before (a) or behind (z) the text, parent, caller.
EXPECTED = [
    (0, "import", "./m{i}", "import", "z2", "z2", None, None), (0, "symbol", "C{i}", "class", "z3", "z9", None, None), (0, "symbol", "run", "function", "z4", "z8", "C{i}", None), (0, "call", "go", "call", "z7", "z7", None, "run"),
    (0, "call", "deep", "call", "z7", "z7", None, "run"), (0, "symbol", "f{i}", "symbol", "z10", "z12", None, None), (0, "call", "wait", "call", "z11", "z11", None, "f{i}"),
    (1, "import", "M{i}.Part", "import", "a1", "a1", None, None), (1, "symbol", "C{i}", "class", "a4", "z13", None, None), (1, "symbol", "Size", "property", "z7", "z7", "C{i}", None), (1, "symbol", "Run", "method", "z8", "z12", "C{i}", None),
    (1, "call", "Go", "call", "z11", "z11", None, "Run"), (2, "import", "m{i}", "import", "a2", "a2", None, None), (2, "symbol", "C{i}", "symbol", "z4", "z6", None, None), (2, "symbol", "Run", "function", "z7", "z10", None, None),
    (2, "call", "Go", "call", "z9", "z9", None, "Run"), (3, "import", "m{i}", "import", "a1", "a1", None, None), (3, "symbol", "C{i}", "class", "a2", "z7", None, None), (3, "symbol", "run", "function", "z4", "z7", "C{i}", None),
    (3, "call", "go", "call", "z7", "z7", None, "run"),
]
_EXT = ["ts", "cs", "go", "py"]


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("{i}", "' || doc_id || '") + "'"


def _line(mark: str) -> str:
    return mark[1:] if mark[0] == "a" else f"{mark[1:]} + nl"


TEXTS = "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS nl FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
FACTS = " UNION ALL ".join(
    f"SELECT 'src/a' || doc_id || '.{_EXT[k]}' AS path, '{fact}' AS fact, {_sql(label)} AS label, '{kind}' AS kind, CAST({_line(a)} AS INT) AS start_line, CAST({_line(z)} AS INT) AS end_line, {_sql(parent)} AS parent, {_sql(caller)} AS caller FROM t WHERE doc_id % 4 = {k}"
    for k, fact, label, kind, a, z, parent, caller in EXPECTED
)


@query(f"WITH t AS ({TEXTS}) SELECT * FROM ({FACTS})")
def scope_facts(spark, sf_dir):
    """Declarations, imports and calls of files that hold whole documents."""
    return ST.all_facts(files(spark, sf_dir))


_OWN = [x for x in EXPECTED if x[1] == "symbol"]


@query(
    f"WITH t AS ({TEXTS}) SELECT path, symbol, kind, parent, start_line, end_line FROM ("
    + " UNION ALL ".join(f"SELECT 'src/a' || doc_id || '.{_EXT[k]}' AS path, {_sql(label)} AS symbol, 'code_{kind}' AS kind, coalesce({_sql(parent)}, '') AS parent, CAST({_line(a)} AS INT) AS start_line, CAST({_line(z)} AS INT) AS end_line FROM t WHERE doc_id % 4 = {k}" for k, _, label, kind, a, z, parent, _ in _OWN)
    + ")"
)
def scope_chunks(spark, sf_dir):
    """Chunks of the same files: a class holds the text, its members are chunks of their own."""
    rows = files(spark, sf_dir)
    rows = rows.withColumn("facts", S.facts(F.col("path"), F.col("content")))
    found = rows.select("path", F.explode(K.scoped_ranges(F.col("content"), F.col("facts"))).alias("r"))
    return found.select("path", "r.symbol", "r.kind", "r.parent", "r.start_line", "r.end_line")


@query("""SELECT doc_id, md5('public class C' || doc_id || chr(10) || '  {' || chr(10) || '    private string held = @"' || replace(replace(coalesce(text, ''), chr(13), ' '), '"', '""') || '";' || chr(10)
 || '    public int Size => held.Length;' || chr(10) || '    public bool Run(int a,' || chr(10) || '        int b)' || chr(10) || '    {' || chr(10) || '      return Go(a, "class No { }");' || chr(10) || '    }' || chr(10) || '  }') AS body_md5 FROM documents""")
def class_bodies(spark, sf_dir):
    """The text of a C# class for each document, which holds it whole."""
    rows = files(spark, sf_dir, 1)
    rows = rows.withColumn("facts", S.facts(F.col("path"), F.col("content")))
    found = rows.select("doc_id", F.explode(K.scoped_ranges(F.col("content"), F.col("facts"))).alias("r"))
    return found.filter("r.kind = 'code_class'").select("doc_id", F.md5("r.body").alias("body_md5"))


@query(r"""SELECT page_id, label, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1), '"[^"]*"|''[^'']*''', '""', 'g'), '([A-Za-z_$][A-Za-z0-9_$]*)\(', 1)) AS label FROM pages) GROUP BY 1, 2""")
def page_script_calls(spark, sf_dir):
    """Calls in the first script of each page; what stands in its strings is none."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), X.script_body(F.col("html")).alias("content"))
    found = rows.select("page_id", F.explode(S.facts(F.col("path"), F.col("content"))).alias("f")).filter("f.fact = 'call'")
    return found.groupBy("page_id", "f.label").agg(F.count("*").alias("n"))


@query(LIKE)
def indexed_terms(spark, sf_dir):
    """The rows of ``like_terms`` through an index of trigrams over whole texts, made anew here."""
    rows = Buckets(spark, G.scratch(spark, "texts"))
    rows.replace(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", "text"), "id")
    index = Trigrams(rows, G.scratch(spark, "trigrams"), ["text", "path"])
    index.build()
    return R.top_per_key(index.search(TERMS), F.col("term"), [F.col("id")], 6).select("id", "term")


# Prompts that are typed in haste: each message behind a phrase that the rewrites know, by its place in the conversation.
HASTE = ["please maek a vidoe, ", "I need  very ", "hey bro ", "same stlye no text same character ", ""]
_HASTE = "CASE turn % 5 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HASTE)) + " END || coalesce(text, '')"
_W = r"[ \t\n\x0B\f\r]+"
_FIX = "list_transform(string_split(raw, ' '), lambda w: CASE lower(regexp_replace(w, '^[,.!?;:]+|[,.!?;:]+$', '', 'g')) " + " ".join(f"WHEN '{a}' THEN regexp_replace(w, '{a}', '{b}', 'gi')" for a, b in W.TYPOS.items()) + " ELSE w END)"
_TRIM = f"regexp_replace({{}}, '^{_W}|{_W}$', '', 'g')"
_FLAT = "list_aggregate(list_filter(list_transform(string_split({}, ' '), lambda p: " + _TRIM.format("p") + "), lambda p: p <> ''), 'string_agg', ' ')"
_SHAPE = "CASE WHEN {0} = '' THEN '' WHEN right({0}, 1) IN ('.', '!', '?') THEN upper(left({0}, 1)) || substr({0}, 2) ELSE upper(left({0}, 1)) || substr({0}, 2) || '.' END"


def _less(text: str, phrases: list[str]) -> str:
    for phrase in phrases:
        text = f"regexp_replace({text}, '{phrase}', '', 'gi')"
    return text


_VIDEO = "shaped"
for _phrase, _to in W.VIDEO:
    _VIDEO = f"regexp_replace({_VIDEO}, '{_phrase}', '{_to}', 'gi')"


@query(f"""WITH a AS (SELECT conv_id, turn, {_HASTE} AS raw FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, {_TRIM.format(f"array_to_string({_FIX}, ' ')")} AS fixed FROM a),
 c AS (SELECT *, coalesce({_FLAT.format('fixed')}, '') AS flat FROM b), d AS (SELECT *, {_SHAPE.format('flat')} AS shaped FROM c)
 SELECT conv_id, turn, action, md5(rewritten) AS rewritten_md5 FROM (SELECT conv_id, turn, unnest([{{'action': 'smart', 'rewritten': {_less('shaped', W.FILLERS)}}}, {{'action': 'optimize', 'rewritten': CASE WHEN shaped = '' THEN fixed ELSE shaped END}},
 {{'action': 'compress', 'rewritten': {_less('shaped', W.FILLERS)}}}, {{'action': 'professional', 'rewritten': {_less('shaped', [W.CASUAL])}}}, {{'action': 'direct', 'rewritten': {_less('shaped', W.FILLERS)}}},
 {{'action': 'video', 'rewritten': {_VIDEO}}}, {{'action': 'coding', 'rewritten': '{W.CODING[0]}' || shaped || '{W.CODING[1]}'}}], recursive := true) FROM d)""")
def prompt_rewrites(spark, sf_dir):
    """What each of the seven actions makes of each prompt."""
    haste = F.lit("")
    for k, h in enumerate(HASTE):
        haste = F.when(F.col("turn") % 5 == k, h).otherwise(haste)
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(haste, F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("conv_id", "turn", F.explode(W.all_rewrites(F.col("text"))).alias("r")).select("conv_id", "turn", "r.action", F.md5("r.rewritten").alias("rewritten_md5"))
