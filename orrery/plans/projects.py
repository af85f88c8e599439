"""Queries over a made-up project: each document stands for a code file, whose path and content follow from its id, so SQL can say what must be found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as K
from ..functions import code as C
from ..functions import files as P
from ..functions import text as X
from ..operators import graph as G
from ..operators import indexing as N
from ..operators import project as J
from ..operators import retrieval as RT
from ..operators import structure as ST
from .queries import documents, query, table

#: Paths of the files, by the id's remainder.
SHAPES = [
    "src/components/Box{}.tsx", "src/app/tests/t{}.py", "lib/config{}.json", "a/styles/s{}.scss", "docs/guide{}.md", "src/db/m{}.sql", "src/api/login{}.ts", "x/pages/p{}.js", "src/hooks/useIt{}.ts",
    "src/utils/u{}.cs", "bin/run{}.sh", "readme{}.txt", "src/services/auth{}.go", "web/index{}.html", "conf/app{}.yaml", "tools/spec{}.rs",
]


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``path``, ``content``, ``hash``: a file imports the next one, declares a function and a value, calls the function of another, and says why."""
    i = F.col("doc_id").cast("string")
    path = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        head, tail = shape.split("{}")
        path = F.when(F.col("doc_id") % 16 == k, F.concat(F.lit(head), i, F.lit(tail))).otherwise(path)
    own, far = (F.col("doc_id") % 40).cast("string"), ((F.col("doc_id") + 3) % 40).cast("string")
    content = F.concat(
        F.lit('import {a} from "./f'), (F.col("doc_id") + 1).cast("string"), F.lit('"\nexport function fn'), own, F.lit("(x) {\n  fn"), far, F.lit("(x);\n}\n// TODO: see "), i, F.lit("\nconst tail"), i, F.lit(" = 1\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content"), X.content_hash(content).alias("hash"))


def summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.summarized(code(spark, sf_dir))


CODE = "SELECT doc_id, CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN '{s.split('{}')[0]}' || doc_id || '{s.split('{}')[1]}'" for k, s in enumerate(SHAPES)) + " END AS path FROM documents"
_NAME, _EXT = "regexp_extract(lower(path), '([^/]*)$', 1)", "regexp_extract(lower(path), '([.][^./]*)$', 1)"


def has(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(lower(path), '{x}')" for x in parts) + ")"


def ends(*extensions: str) -> str:
    return f"{_EXT} IN (" + ", ".join(f"'{x}'" for x in extensions) + ")"


ROLE = f"""CASE WHEN regexp_matches({_NAME}, '([.]test[.]|[.]spec[.]|_test[.]|tests?[.][a-z]+$)') OR {has('/tests/', '/__tests__/', '/test/')} THEN 'Test'
 WHEN contains({_NAME}, 'config') OR {_NAME} IN ('package.json', 'tsconfig.json', 'dockerfile') OR starts_with({_NAME}, '.env') THEN 'Config'
 WHEN {ends('.css', '.scss', '.sass', '.less')} THEN 'Style' WHEN {ends('.md', '.mdx', '.txt')} OR {has('/docs/')} THEN 'Docs' WHEN {has('/prisma/', '/db/', '/database/', '/models/')} OR {ends('.sql', '.prisma')} THEN 'Database'
 WHEN {has('/api/', '/routes/')} OR starts_with({_NAME}, 'route.') THEN 'Api' WHEN {has('/pages/')} THEN 'Route' WHEN {has('/hooks/')} OR (starts_with({_NAME}, 'use') AND {ends('.ts', '.tsx', '.js', '.jsx')}) THEN 'Hook'
 WHEN {has('/components/')} OR {ends('.tsx', '.jsx', '.vue', '.svelte')} THEN 'Component' WHEN {has('/utils/', '/lib/', '/helpers/')} THEN 'Util' ELSE 'Unknown' END"""
WEIGHT = f"""CASE role WHEN 'Docs' THEN 0.95 WHEN 'Config' THEN 0.9 WHEN 'Route' THEN 0.86 WHEN 'Api' THEN 0.86 WHEN 'Component' THEN 0.78 WHEN 'Database' THEN 0.74 WHEN 'Util' THEN 0.68 WHEN 'Hook' THEN 0.68 WHEN 'Test' THEN 0.35 ELSE 0.5 END
 + CASE WHEN {has('auth', 'login')} THEN 0.12 ELSE 0 END + CASE WHEN {has('readme', 'package.json')} THEN 0.1 ELSE 0 END"""
ROLES = f"SELECT *, least(1.0, greatest(0.0, {WEIGHT})) AS importance FROM (SELECT *, {ROLE} AS role FROM ({CODE}))"
PRIORITY = f"""CASE WHEN {has('readme', 'docs/')} THEN 100 WHEN {has('config')} THEN 90 WHEN {has('src/app', 'pages/', 'routes/')} THEN 80 WHEN {has('components/')} THEN 70 WHEN {has('lib/', 'services/', 'api/')} THEN 60
 WHEN {has('schema', 'migration', 'prisma')} THEN 50 WHEN {has('test', 'spec')} THEN 30 ELSE 10 END"""
LANGUAGE = f"""CASE WHEN {ends('.ts', '.tsx')} THEN 'typescript' WHEN {ends('.js', '.jsx', '.mjs', '.cjs')} THEN 'javascript' WHEN {ends('.cs')} THEN 'csharp' WHEN {ends('.py')} THEN 'python' WHEN {ends('.json')} THEN 'json'
 WHEN {ends('.md', '.mdx')} THEN 'markdown' WHEN {ends('.css', '.scss', '.sass', '.less')} THEN 'css' WHEN {ends('.sql')} THEN 'sql' WHEN {ends('.yaml', '.yml')} THEN 'yaml' WHEN {ends('.html', '.htm')} THEN 'html' ELSE 'text' END"""
BUCKET = "CASE role WHEN 'Route' THEN 'routes' WHEN 'Component' THEN 'components' WHEN 'Hook' THEN 'utils' WHEN 'Util' THEN 'utils' WHEN 'Style' THEN 'styles' WHEN 'Api' THEN 'api' WHEN 'Database' THEN 'data' END"
LAYER = "CASE WHEN role = 'Config' THEN 'config' WHEN role IN ('Api', 'Route') THEN 'api' WHEN role IN ('Component', 'Style') THEN 'ui' WHEN role = 'Database' THEN 'data' ELSE 'core' END"
HUB_LAYER = f"""CASE WHEN role = 'Config' OR {has('appsettings', 'config')} THEN 'config' WHEN role IN ('Api', 'Route') OR {has('/api/', 'controller')} THEN 'api' WHEN role IN ('Component', 'Style') OR {has('/ui/')} OR {_EXT} = '.xaml' THEN 'ui'
 WHEN role = 'Database' OR {has('migration', 'repository')} THEN 'data' ELSE 'core' END"""
NODE_TYPE = "CASE WHEN role IN ('Route', 'Component', 'Hook', 'Api', 'Style', 'Config') THEN role ELSE 'File' END"


@query(f"SELECT doc_id, role, {LANGUAGE} AS language, {PRIORITY} AS priority, round(importance, 6) AS importance FROM ({ROLES})")
def classify_rows(spark, sf_dir):
    path = F.col("path")
    rows = code(spark, sf_dir).withColumn("role", P.role(path, F.col("content")))
    return rows.select("doc_id", "role", P.language(path).alias("language"), P.priority(path).alias("priority"), F.round(P.importance(path, F.col("role")), 6).alias("importance"))


@query(f"""SELECT doc_id, {NODE_TYPE} AS node_type, {BUCKET} AS bucket, {LAYER} AS layer, {HUB_LAYER} AS hub_layer,
 CASE WHEN {ends('.tsx')} THEN 'TSX' WHEN {ends('.ts')} THEN 'TypeScript' WHEN {ends('.js')} THEN 'JavaScript' WHEN {ends('.py')} THEN 'Python' WHEN {ends('.cs')} THEN 'CSharp' WHEN {ends('.go')} THEN 'Go' WHEN {ends('.rs')} THEN 'Rust' WHEN {ends('.sh')} THEN 'Bash'
  WHEN {ends('.json')} THEN 'JSON' WHEN {ends('.html')} THEN 'HTML' WHEN {ends('.scss')} THEN 'CSS' WHEN {ends('.sql')} THEN 'CodeQL' END AS grammar FROM ({ROLES})""")
def layer_rows(spark, sf_dir):
    path, role = F.col("path"), F.col("role")
    rows = code(spark, sf_dir).withColumn("role", P.role(path, F.col("content")))
    return rows.select("doc_id", P.node_type(role).alias("node_type"), P.bucket(role).alias("bucket"), P.layer(role).alias("layer"), P.hub_layer(path, role).alias("hub_layer"), P.grammar(path).alias("grammar"))


@query(f"SELECT bucket, count(*) AS files, min(path) AS first FROM (SELECT path, {BUCKET} AS bucket FROM ({ROLES})) WHERE bucket IS NOT NULL GROUP BY 1")
def folder_buckets(spark, sf_dir):
    rows = code(spark, sf_dir).withColumn("role", P.role(F.col("path"), F.col("content")))
    return ST.buckets(rows).select("bucket", F.size("paths").cast("long").alias("files"), F.get("paths", F.lit(0)).alias("first"))


CATEGORY = "CASE role WHEN 'Route' THEN 'pages' WHEN 'Component' THEN 'components' WHEN 'Api' THEN 'api' WHEN 'Database' THEN 'data' WHEN 'Config' THEN 'config' WHEN 'Style' THEN 'styles' END"


@query(f"SELECT category, path FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS rn FROM (SELECT path, {CATEGORY} AS category FROM ({ROLES})) WHERE category IS NOT NULL) WHERE rn <= 12")
def files_by_category(spark, sf_dir):
    return ST.by_category(code(spark, sf_dir).withColumn("role", P.role(F.col("path"), F.col("content"))))


@query("SELECT doc_id, './f' || (doc_id + 1) AS imports, 'fn' || (doc_id % 40) AS exports, 'fn' || (doc_id % 40) || ',tail' || doc_id AS symbols FROM documents")
def code_inspection(spark, sf_dir):
    rows = code(spark, sf_dir).select("doc_id", C.inspect(F.col("content")).alias("c"))
    return rows.select("doc_id", F.array_join("c.imports", ",").alias("imports"), F.array_join("c.exports", ",").alias("exports"), F.array_join("c.symbols", ",").alias("symbols"))


@query(f"SELECT path, 'fn' || (doc_id % 40) AS label, 'function' AS kind, 2 AS start_line, 5 AS end_line FROM ({CODE}) UNION ALL SELECT path, 'tail' || doc_id, 'property', 6, 7 FROM ({CODE})")
def code_symbols(spark, sf_dir):
    return ST.symbols(code(spark, sf_dir)).select("path", "label", "kind", F.col("start_line").cast("int").alias("start_line"), "end_line")


@query(f"SELECT path, 'fn' || ((doc_id + 3) % 40) AS label, 3 AS line, 'fn' || (doc_id % 40) AS caller FROM ({CODE})")
def code_calls(spark, sf_dir):
    files = code(spark, sf_dir)
    return ST.calls(files, ST.symbols(files)).select("path", "label", F.col("line").cast("int").alias("line"), "caller")


@query(f"SELECT path, 5 AS line, 'TODO' AS tag, 'see ' || doc_id AS comment, 'fn' || (doc_id % 40) AS symbol FROM ({CODE})")
def code_comments(spark, sf_dir):
    files = code(spark, sf_dir)
    return ST.comments(files, ST.symbols(files)).select("path", F.col("line").cast("int").alias("line"), "tag", "comment", "symbol")


LINKED = f"SELECT DISTINCT a.path AS a, b.path AS b FROM ({CODE}) a JOIN ({CODE}) b ON (a.doc_id + 3) % 40 = b.doc_id % 40 AND a.path <> b.path"


@query(f"SELECT 'file:' || a AS a, 'file:' || b AS b FROM ({LINKED})")
def resolved_calls(spark, sf_dir):
    """File to file calls through the extraction."""
    return G.expanded(ST.file_calls(*ST.extraction(code(spark, sf_dir), "lines")))


@query(f"""SELECT DISTINCT 'symbol:' || a.path || '#fn' || (a.doc_id % 40) AS a, 'symbol:' || b.path || '#fn' || (b.doc_id % 40) AS b FROM ({CODE}) a JOIN ({CODE}) b ON (a.doc_id + 3) % 40 = b.doc_id % 40 AND a.path <> b.path""")
def symbol_calls(spark, sf_dir):
    return ST.symbol_calls(*ST.extraction(code(spark, sf_dir), "lines"))


_FOLDERS = "string_split(regexp_extract({}, '^(.*/)?[^/]*$', 1), '/')"


@query(f"""WITH c AS (SELECT path, 'fn' || (doc_id % 40) AS own, 'fn' || ((doc_id + 3) % 40) AS far, {_FOLDERS.format('path')} AS f FROM ({CODE})),
 m AS (SELECT a.path, a.far AS label, b.path AS target, len(list_filter(range(1, 1 + least(len(a.f), len(b.f))), lambda i: a.f[1:i] = b.f[1:i] AND a.f[i] <> '')) AS deep FROM c a JOIN c b ON a.far = b.own AND a.path <> b.path)
 SELECT path, label, target, 'folder' AS how FROM (SELECT *, row_number() OVER (PARTITION BY path, label ORDER BY deep DESC, target) AS rn FROM m) WHERE rn <= 2""")
def nearest_calls(spark, sf_dir):
    """Two targets a call at most: declarations of the nearest folders, since the made-up imports lead to no file."""
    found = ST.all_facts(code(spark, sf_dir), "lines")
    none = spark.createDataFrame([], "a string, b string")
    return ST.resolve_scoped(found.filter("fact = 'call'"), found.filter("fact = 'symbol'"), none, 2)


@query(f"SELECT path, './f' || (doc_id + 1) AS label FROM ({CODE})")
def import_labels(spark, sf_dir):
    nodes, edges = ST.extraction(code(spark, sf_dir), "lines")
    return ST.import_labels(edges, nodes)


@query(f"WITH c AS ({CODE}) SELECT 'Contains' AS type, 2 * count(*) AS n FROM c UNION ALL SELECT 'Imports', count(*) FROM c UNION ALL SELECT 'Calls', count(*) FROM c UNION ALL SELECT 'RelatedTo', count(*) FROM c")
def extracted_edges(spark, sf_dir):
    edges = ST.merged(*ST.extraction(code(spark, sf_dir), "lines"))[1]
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({ROLES}) SELECT 'file:' || path AS id, {NODE_TYPE} AS type, regexp_extract(path, '([^/]*)$', 1) AS label FROM c
 UNION ALL SELECT 'symbol:' || path || '#fn' || (doc_id % 40), 'Function', 'fn' || (doc_id % 40) FROM c UNION ALL SELECT 'symbol:' || path || '#tail' || doc_id, 'Function', 'tail' || doc_id FROM c UNION ALL SELECT 'project:demo', 'Project', 'demo'""")
def file_graph_nodes(spark, sf_dir):
    return ST.file_graph(summed(spark, sf_dir), "demo")[0].select("id", "type", "label")


DEGREES = f"SELECT path, count(*) AS degree FROM (SELECT a AS path FROM ({LINKED}) UNION ALL SELECT b FROM ({LINKED})) GROUP BY 1 HAVING count(*) >= 2"


@query(f"SELECT {HUB_LAYER} AS layer, count(*) AS n FROM (SELECT path, role FROM ({DEGREES}) JOIN ({ROLES}) USING (path)) GROUP BY 1")
def hub_layers(spark, sf_dir):
    """Layers of the nodes of degree 2 or more, counted before one a file is kept."""
    files = summed(spark, sf_dir)
    return ST.hubs(ST.file_calls(*ST.extraction(files, "lines")), ST.file_graph(files, "demo")[0], files)[1]


@query(f"SELECT path, degree, {HUB_LAYER} AS layer FROM (SELECT path, degree, role FROM ({DEGREES}) JOIN ({ROLES}) USING (path)) ORDER BY degree DESC, path LIMIT 24")
def file_hubs(spark, sf_dir):
    files = summed(spark, sf_dir)
    return ST.hubs(ST.file_calls(*ST.extraction(files, "lines")), ST.file_graph(files, "demo")[0], files)[0].select("path", "degree", "layer")


@query(f"""WITH m AS (SELECT path, regexp_extract(path, '^([^/]*(/[^/]*)?)', 1) AS folder, doc_id % 5 AS g, {LAYER} AS layer, importance FROM ({ROLES})),
 s AS (SELECT g, count(*) AS size, arg_min(path, (-round(importance, 9), path)) AS seed FROM m GROUP BY 1), f AS (SELECT g, arg_min(folder, (-n, folder)) AS folder FROM (SELECT g, folder, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
 l AS (SELECT g, arg_min(layer, (-n, layer)) AS layer FROM (SELECT g, layer, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1) SELECT seed, size, folder, layer FROM s JOIN f USING (g) JOIN l USING (g)""")
def architecture_communities(spark, sf_dir):
    """Files linked to the next one of the same remainder by 5: five groups."""
    files = summed(spark, sf_dir).withColumn("importance", F.round("importance", 9))
    order = Window.partitionBy(F.col("doc_id") % 5).orderBy("doc_id")
    links = files.select(F.col("path").alias("a"), F.lead("path").over(order).alias("b")).filter("b is not null")
    return ST.communities(files, links).select("seed", "size", "folder", "layer")


@query("SELECT path, 'route' AS kind, round(0.86 + 0.05 * 0.5, 6) AS score FROM (SELECT 'web/' || doc_id || '/page.x' AS path FROM documents) ORDER BY path LIMIT 16")
def entry_routes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("web/"), F.col("doc_id").cast("string"), F.lit("/page.x")).alias("path"), F.lit(0.5).alias("importance"))
    return J.entry_points(rows).withColumn("score", F.round("score", 6))


@query(f"""SELECT path, CASE WHEN language IN ('markdown', 'json') THEN 1 ELSE 2 END AS chunks, CASE WHEN language IN ('typescript', 'javascript') THEN 'fn' || (doc_id % 40) ELSE '' END AS first FROM (SELECT *, {LANGUAGE} AS language FROM ({CODE}))
 WHERE language IN ('markdown', 'json', 'typescript', 'javascript')""")
def chunk_ranges(spark, sf_dir):
    """Chunks of the files whose language has a rule of its own that finds something here."""
    rows = code(spark, sf_dir).filter(P.language(F.col("path")).isin("markdown", "json", "typescript", "javascript"))
    found = rows.select("path", K.ranges(F.col("path"), F.col("content")).alias("r"))
    return found.select("path", F.size("r").alias("chunks"), F.get("r", F.lit(0))["symbol"].alias("first"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS place, CAST(pos AS INT) AS start_line FROM
 (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM documents)) WHERE starts_with(lines[pos], 'A')""")
def section_starts(spark, sf_dir):
    """Texts cut before the lines that begin with a capital A, as markdown is before its headings."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(K.parts_of(F.regexp_replace("text", "\r\n", "\n"), "A", 1 << 30, K.SECTION, "section", "^(A)")).alias("place", "r"))
    return rows.select("doc_id", "place", "r.start_line")


@query(f"SELECT path, role || ' file: fn' || (doc_id % 40) || ', tail' || doc_id AS summary FROM ({ROLES})")
def file_summaries(spark, sf_dir):
    return summed(spark, sf_dir).select("path", "summary")


@query("SELECT 'pnpm' AS package_manager, 'TypeScript' AS language, 'React' AS framework, 'Tailwind CSS' AS styling, 'MUI' AS ui_library, 'GSAP,Lenis' AS animations")
def stack_detection(spark, sf_dir):
    """The project with a manifest and a lock file at its root."""
    manifest = '{"dependencies": {"react": "1", "@mui/material": "2", "lenis": "1"}, "devDependencies": {"typescript": "5", "tailwindcss": "3", "gsap": "1", "express": "4"}}'
    root = spark.createDataFrame([("package.json", manifest), ("pnpm-lock.yaml", ""), ("sub/yarn.lock", "")], "path string, content string")
    out = N.stack(code(spark, sf_dir).select("path", "content").unionByName(root))
    return out.withColumn("animations", F.array_join("animations", ","))


@query(f"SELECT path, {PRIORITY} AS priority FROM ({CODE})")
def read_order(spark, sf_dir):
    return ST.prioritized(code(spark, sf_dir)).select("path", "priority")


@query("SELECT count(*) AS files, count(*) AS previews, 0 AS vectors, 'EmbeddingUnavailable' AS status, 0.0 AS progress, 'Keyword fallback' AS mode, 3 * count(*) + 1 AS nodes FROM documents")
def index_metadata(spark, sf_dir):
    files = summed(spark, sf_dir)
    chunks = N.chunked(files, "demo", by="lines").withColumn("vector", F.lit(None).cast("array<double>"))
    out = N.metadata(files, chunks, *ST.file_graph(files, "demo"))
    return out.select("files", "previews", F.col("vectors").cast("int").alias("vectors"), "status", "progress", "mode", "nodes")


@query(f"""SELECT path, round(0.5 + CASE WHEN role = 'Config' OR contains(lower(kind), 'config') THEN 0.14 ELSE 0 END + CASE WHEN role IN ('Api', 'Route') THEN 0.14 ELSE 0 END, 6) AS score
 FROM (SELECT path, role, CASE WHEN doc_id % 11 = 0 THEN 'appConfig' ELSE 'text' END AS kind FROM ({ROLES}))""")
def intent_boost(spark, sf_dir):
    files = code(spark, sf_dir).withColumn("role", P.role(F.col("path"), F.col("content")))
    rows = files.select("path", F.when(F.col("doc_id") % 11 == 0, "appConfig").otherwise("text").alias("kind"), F.lit(0.5).alias("score"))
    return RT.intent_boost(rows, "configure the endpoint", files).select("path", F.round("score", 6).alias("score"))


# --- retrieval ------------------------------------------------------------------------------------------------------------------------


ASKED = "where does the login endpoint call fn7"


@query(f"""SELECT path, round(least(0.95, 0.4 + s), 6) AS score FROM (SELECT path, CASE WHEN {has('login')} THEN 0.25 ELSE 0 END + CASE WHEN contains('fn' || (doc_id % 40) || chr(10) || 'tail' || doc_id, 'fn7') THEN 0.5 ELSE 0 END AS s FROM ({CODE})) WHERE s > 0""")
def term_files(spark, sf_dir):
    """Files by two terms; a name in the symbols is in the summary, too."""
    return RT.file_hits(["login", "fn7"], summed(spark, sf_dir)).select("path", F.round("score", 6).alias("score"))


@query(f"""SELECT path, symbol, round(score, 6) AS score FROM (SELECT path, 'fn7' AS symbol, 0.98 AS score FROM ({CODE}) WHERE doc_id % 40 = 7 ORDER BY path LIMIT 4)""")
def symbol_targets(spark, sf_dir):
    files = summed(spark, sf_dir)
    names = RT.Names([], [], [], ["fn7"])
    return RT.targets(names, files, ST.file_graph(files, "demo")[0]).select("path", "symbol", F.round("score", 6).alias("score"))


@query(f"SELECT 'file:' || path AS id FROM ({CODE}) WHERE {has('login')} UNION ALL SELECT 'symbol:' || path || '#fn' || (doc_id % 40) FROM ({CODE}) WHERE {has('login')} OR doc_id % 40 = 7 UNION ALL SELECT 'symbol:' || path || '#tail' || doc_id FROM ({CODE}) WHERE {has('login')}")
def graph_term_nodes(spark, sf_dir):
    return RT.graph_hits(["login", "fn7"], ST.file_graph(summed(spark, sf_dir), "demo")[0]).select("id")


_DULL = ", ".join(f"'{w}'" for w in RT.NOISE)


@query(rf"""SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(t, '(?:^|[^\pL\pN_])([A-Z][A-Za-z0-9_]{{2,}})(?:$|[^\pL\pN_])', 1)), lambda w: lower(w) NOT IN ({_DULL}))) AS names FROM
 (SELECT conv_id, turn, regexp_replace(text, '([^\pL\pN_])', '\1\1', 'g') AS t FROM conversations WHERE role = 'user')""")
def prompt_names(spark, sf_dir):
    """Names in capitals of a prompt, without words that name nothing."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", RT.parse(F.col("text")).alias("p"))
    own = F.filter("p.symbols", lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]{2,}$"))
    return rows.select("conv_id", "turn", F.size(own).cast("long").alias("names"))


def project_of(spark: SparkSession, sf_dir: str) -> RT.Project:
    """The made-up project with its graph; vectors by equal ids."""
    files = G.checkpoint(summed(spark, sf_dir))
    nodes, edges = ST.extraction(files)
    nodes, edges = G.checkpoint(ST.merged(nodes, edges)[0]), ST.file_calls(nodes, edges)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    chunks = N.chunked(files.drop("doc_id").withColumn("n", F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long")), "demo")
    chunks = chunks.withColumn("n", F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long")).join(vectors, F.col("n") == F.col("vec_id"), "left").drop("n", "vec_id")
    links = ST.file_links(edges, nodes)
    return RT.Project(files, nodes, edges, G.checkpoint(chunks), links, ST.hubs(edges, nodes, files)[0], J.entry_points(files), ST.communities(files, links))


def retrieved(spark: SparkSession, sf_dir: str, engine: str) -> DataFrame:
    vector = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]
    rows = RT.retrieve(ASKED, project_of(spark, sf_dir), engine, 12, vector)[0]
    return rows.select("path", "symbol", "start_line", F.round("score", 6).alias("score"), "reason")


@query()
def retrieve_rag(spark, sf_dir):
    return retrieved(spark, sf_dir, "rag")


@query()
def retrieve_ast(spark, sf_dir):
    return retrieved(spark, sf_dir, "ast")


@query()
def retrieve_hybrid(spark, sf_dir):
    return retrieved(spark, sf_dir, "hybrid")
