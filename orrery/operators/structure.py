"""A project's structure: what its files declare, import and call, the property graph of it, layers and communities.

Files are a table ``path``, ``content`` and more; graphs are tables of nodes (``id``, ``type``, ``label``, ``path``, ``start_line``, ``end_line``) and edges (``a``, ``b``, ``type``).
Files of the languages that :mod:`..functions.scopes` covers are read by tokens and scopes, once, into facts; other files line by line, by patterns. The
rest is joins and windows over a file's or a name's rows; no file's content is shuffled, only its lines' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import files as P
from ..functions import scopes as S
from . import graph as G
from . import project as J

#: Words before a bracket that are no calls; our own list.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "function", "def", "class", "using", "lock", "typeof", "sizeof", "await", "new", "super", "elif", "except", "with", "and", "or", "not", "in", "print"]
#: Node types by kind, and edge types by relation; other kinds are functions, other relations related (fixed values).
KINDS = {"file": "File", "class": "Component", "interface": "Component", "struct": "Component", "function": "Function", "method": "Function", "property": "Function", "import": "Config", "rationale": "Config"}
RELATIONS = {"imports": "Imports", "calls": "Calls", "contains": "Contains", "rationale_for": "RelatedTo"}
#: Edges that link files, and node types that a view of the graph shows (fixed values).
LINKS = ["Imports", "Calls", "DependsOn"]
FOCUS = ["Function", "Component", "Route", "Hook", "Api", "File"]
KIND = r"^[ \t]*(?:export[ \t]+|default[ \t]+|public[ \t]+|private[ \t]+|protected[ \t]+|internal[ \t]+|static[ \t]+|abstract[ \t]+|async[ \t]+)*(class|interface|struct|record|enum|type|function|def|const|let|var)\b"


def lines(files: DataFrame) -> DataFrame:
    """``path``, ``line`` from 1, ``text``."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def scoped(files: DataFrame) -> DataFrame:
    """``path``, ``facts``, ``content``: facts of each file that its tokens tell, and the content only where they don't (``facts`` is null). Written once,
    since symbols, imports, calls and chunks are all read from it."""
    read = files.select("path", "content", S.facts(F.col("path"), F.col("content")).alias("facts"))
    return G.checkpoint(read.select("path", "facts", F.when(F.col("facts").isNull(), F.col("content")).alias("content")))


def facts(read: DataFrame) -> DataFrame:
    """read: of :func:`scoped`. A row a fact."""
    return read.select("path", F.explode("facts").alias("f")).select("path", "f.*")


def facts_by_lines(files: DataFrame) -> DataFrame:
    """Facts of files by their lines: declarations, imports, and calls with the narrowest declaration around."""
    none = F.lit(None)
    declared = G.checkpoint(symbols(files))
    shape = lambda df, fact, label, kind, start, end, parent, caller: df.select("path", F.lit(fact).alias("fact"), label.alias("label"), kind.alias("kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), parent.cast("string").alias("parent"), caller.cast("string").alias("caller"))
    out = shape(declared, "symbol", F.col("label"), F.col("kind"), F.col("start_line"), F.col("end_line"), F.col("parent"), none)
    out = out.union(shape(imports(files), "import", F.col("target"), F.lit("import"), F.lit(0), F.lit(0), none, none))
    return out.union(shape(calls(files, declared), "call", F.col("label"), F.lit("call"), F.col("line"), F.col("line"), none, F.col("caller")))


def all_facts(files: DataFrame, by: str = "scopes") -> DataFrame:
    """``path``, ``fact`` (symbol, import or call), ``label``, ``kind``, ``start_line``, ``end_line``, ``parent``, ``caller``. by: ``scopes``, with lines for the files that these don't
    cover, or ``lines`` for all."""
    if by == "lines":
        return facts_by_lines(files)
    read = scoped(files)
    parent = F.when(F.col("parent") != "", F.col("parent"))
    told = facts(read).select("path", "fact", "label", "kind", "start_line", "end_line", parent.alias("parent"), "caller")
    return told.union(facts_by_lines(read.filter("facts IS NULL AND content IS NOT NULL")))


def symbols(files: DataFrame) -> DataFrame:
    """``path``, ``label``, ``kind``, ``start_line``, ``end_line``, ``parent``: declarations, each to the line before the next one that isn't deeper; the
    parent is the last class-like one above that is less deep."""
    rows = lines(files)
    word = F.regexp_extract("text", KIND, 1)
    kind = F.when(word.isin("class", "interface", "struct", "enum"), word).when(word == "record", "class").when(word == "type", "interface").when(word.isin("function", "def"), "function").otherwise("property")
    name = F.get(C.all_of(F.col("text"), C.SYMBOLS), F.lit(0))
    deep = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    found = rows.filter(word != "").select("path", name.alias("label"), kind.alias("kind"), F.col("line").alias("start_line"), deep.alias("deep")).filter("label is not null")
    sizes = files.select("path", F.size(F.split("content", "\r?\n")).alias("_lines"))
    listed = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "deep", "label", "kind"))).alias("all"))
    spans = F.transform(
        "all",
        lambda s, i: F.struct(
            s["label"].alias("label"),
            s["kind"].alias("kind"),
            s["start_line"].alias("start_line"),
            (F.coalesce(F.get(F.filter(F.slice("all", i + 2, F.size("all")), lambda n: n["deep"] <= s["deep"]), F.lit(0))["start_line"], F.col("_lines") + 1) - 1).cast("int").alias("end_line"),
            F.get(F.reverse(F.filter(F.slice(F.col("all"), F.lit(1), i), lambda n: (n["deep"] < s["deep"]) & n["kind"].isin("class", "interface", "struct"))), F.lit(0))["label"].alias("parent"),
        ),
    )
    return listed.join(sizes, "path").select("path", F.explode(spans).alias("s")).select("path", "s.*")


def imports(files: DataFrame) -> DataFrame:
    """``path``, ``target``."""
    return files.select("path", F.explode(C.all_of(F.col("content"), C.IMPORTS)).alias("target")).select("path", C.normal_import(F.col("target")).alias("target")).filter("target <> ''")


def calls(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``path``, ``label``, ``line``, ``caller``: names before a bracket, and the narrowest declaration around (null at the top of a file)."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)[ \t]*\("), F.lit(1)))
    own = F.get(C.all_of(F.col("text"), C.SYMBOLS), F.lit(0))
    found = lines(files).select("path", "line", F.explode(F.array_except(names, F.array(*(F.lit(k) for k in KEYWORDS)))).alias("label"), own.alias("own"))
    found = found.filter(F.col("own").isNull() | (F.col("own") != F.col("label"))).drop("own")
    around = G.enclosing(found.select(F.col("path").alias("file"), "line").distinct(), declared.select(F.col("path").alias("file"), F.col("label").alias("symbol"), "start_line", "end_line"))
    return found.join(around.select(F.col("file").alias("path"), "line", F.col("symbol").alias("caller")), ["path", "line"], "left").select("path", "label", "line", "caller")


def comments(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``path``, ``line``, ``tag``, ``comment``, ``symbol``: comments that say why, and the declaration around."""
    found = files.select("path", F.explode(C.rationale(F.col("content"))).alias("r")).select("path", "r.*")
    around = G.enclosing(found.select(F.col("path").alias("file"), "line").distinct(), declared.select(F.col("path").alias("file"), F.col("label").alias("symbol"), "start_line", "end_line"))
    return found.join(around.select(F.col("file").alias("path"), "line", "symbol"), ["path", "line"], "left")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, label: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), label)


def path_of(id_: Column) -> Column:
    """The path of a file's node id; null for other nodes."""
    return F.when(id_.startswith("file:"), F.substring(id_, 6, 1 << 30))


def paths_of(ids: DataFrame, nodes: DataFrame, id_: str = "id") -> DataFrame:
    """Adds ``path`` to rows of node ids: from the id itself, else from the node."""
    known = nodes.select(F.col("id").alias(id_), F.col("path").alias("_path"))
    return ids.join(known, id_, "left").withColumn("path", F.coalesce(path_of(F.col(id_)), "_path")).drop("_path")


def file_graph(files: DataFrame, project: str, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """files: ``path``, ``role``, ``symbols`` (array). Nodes and edges of a project: it contains its files, a file exports its first symbols."""
    own = F.lit(f"project:{project}")
    none = F.lit(None).cast("int")
    shape = lambda id_, type_, label, path: [id_.alias("id"), type_.alias("type"), label.alias("label"), path.alias("path"), none.alias("start_line"), none.alias("end_line")]
    named = files.select("path", "role", F.explode(F.slice("symbols", 1, most)).alias("label"))
    root = files.sparkSession.range(1).select(*shape(own, F.lit("Project"), F.lit(project), F.lit(None).cast("string")))
    nodes = root.union(files.select(*shape(file_id(F.col("path")), P.node_type(F.col("role")), P.name_of(F.col("path")), F.col("path"))))
    nodes = nodes.union(named.select(*shape(symbol_id(F.col("path"), F.col("label")), F.lit("Function"), F.col("label"), F.col("path"))).distinct())
    edges = files.select(own.alias("a"), file_id(F.col("path")).alias("b"), F.lit("Contains").alias("type"))
    return nodes, G.add_edges(edges.union(named.select(file_id(F.col("path")), symbol_id(F.col("path"), F.col("label")), F.lit("Exports"))))


def extraction(files: DataFrame, by: str = "scopes") -> tuple[DataFrame, DataFrame]:
    """What the text of files says: nodes (``id``, ``label``, ``path``, ``kind``, ``start_line``, ``end_line``) and edges (``a``, ``b``, ``relation``). by: see
    :func:`all_facts`."""
    found = G.checkpoint(all_facts(files, by))
    declared, made, called = (found.filter(F.col("fact") == f) for f in ("symbol", "import", "call"))
    why = comments(files, declared)
    node = lambda df, id_, label, kind, start, end: df.select(id_.alias("id"), label.alias("label"), F.col("path"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))
    path, label, zero = F.col("path"), F.col("label"), F.lit(0)
    import_id, call_id = F.concat(F.lit("import:"), path, F.lit("#"), label), F.concat(F.lit("call:"), path, F.lit("#"), label)
    why_id = F.concat_ws(":", F.lit("why"), path, F.col("line").cast("string"))
    nodes = node(files, file_id(path), P.name_of(path), "file", zero, zero)
    for more in (
        node(declared, symbol_id(path, label), label, F.col("kind"), F.col("start_line"), F.col("end_line")),
        node(made, import_id, label, "import", zero, zero),
        node(called, call_id, label, "call", F.col("start_line"), F.col("start_line")),
        node(why, why_id, F.concat_ws(": ", "tag", "comment"), "rationale", F.col("line"), F.col("line")),
    ):
        nodes = nodes.unionByName(more)
    edge = lambda df, a, b, relation: df.select(a.alias("a"), b.alias("b"), F.lit(relation).alias("relation"))
    caller = F.when(F.col("caller").isNotNull(), symbol_id(path, F.col("caller"))).otherwise(file_id(path))
    around = F.when(F.col("symbol").isNotNull(), symbol_id(path, F.col("symbol"))).otherwise(file_id(path))
    parent = F.when(F.col("parent").isNotNull(), symbol_id(path, F.col("parent"))).otherwise(file_id(path))
    edges = edge(declared, parent, symbol_id(path, label), "contains")
    for more in (edge(made, file_id(path), import_id, "imports"), edge(called, caller, call_id, "calls"), edge(why, why_id, around, "rationale_for")):
        edges = edges.union(more)
    return nodes, edges.filter("a <> b").distinct()


def merged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An extraction as a property graph: types by kind and relation. Of a node that comes several times the first line counts; lines are overwritten by
    later ones elsewhere (see :func:`graph.upsert_nodes`)."""
    typed = nodes.withColumn("type", P.mapped(F.col("kind"), KINDS, "Function"))
    first = F.struct(F.coalesce("start_line", F.lit(0)), "label")
    out = typed.groupBy("id").agg(*(F.min_by(c, first).alias(c) for c in ("type", "label", "path", "start_line", "end_line")))
    return out, G.add_edges(edges.select("a", "b", P.mapped(F.col("relation"), RELATIONS, "RelatedTo").alias("type")))


def merge_symbols(files: DataFrame, nodes: DataFrame, most: int = 40) -> DataFrame:
    """files: ``path``, ``symbols``, ``imports``. Where the extraction found names, they replace those of a file; the others keep theirs."""
    named = lambda kinds, c: nodes.filter(kinds).groupBy("path").agg(F.slice(F.sort_array(F.collect_set("label")), 1, most).alias(c))
    found = named(~F.col("kind").isin("file", "import", "call"), "_symbols")
    rows = files.join(found, "path", "left").join(named(F.col("kind") == "import", "_imports"), "path", "left")
    return rows.withColumns({"symbols": F.coalesce("_symbols", "symbols"), "imports": F.coalesce("_imports", "imports")}).drop("_symbols", "_imports")


def call_ends(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes, edges: an extraction. Calls (``a``, the first caller by id, ``path``, ``key``) and declarations (``b``, ``path``, ``key``), each once; they meet by key, a name in small letters."""
    called = nodes.filter("kind = 'call'").select(F.col("id").alias("call"), "path", F.lower("label").alias("key"))
    caller = edges.filter("relation = 'calls'").groupBy(F.col("b").alias("call")).agg(F.min("a").alias("a"))
    target = nodes.filter(~F.col("kind").isin("file", "import", "call", "rationale")).select(F.col("id").alias("b"), "path", F.lower("label").alias("key"))
    told = lambda rows: rows.filter("path is not null and key is not null").distinct()
    return told(called.join(caller, "call").select("a", "path", "key")), told(target)


def file_calls(nodes: DataFrame, edges: DataFrame) -> G.Bundles:
    """The file to file calls of :func:`resolve_calls`, not expanded: files' nodes by the names that they call and declare."""
    called, declared = call_ends(nodes, edges)
    source = called.select(file_id(F.col("path")).alias("a"), "key").distinct()
    return G.Bundles(G.checkpoint(source), G.checkpoint(declared.select("key", file_id(F.col("path")).alias("b")).distinct()))


def symbol_calls(nodes: DataFrame, edges: DataFrame, block: int = 4096) -> DataFrame:
    """``a``, ``b``: the symbol calls of :func:`resolve_calls`. Callers and declarations are made distinct before they meet, so that no call is shuffled; names that many files share meet in
    blocks."""
    called, declared = (G.checkpoint(rows) for rows in call_ends(nodes, edges))
    # An id tells the path and the name, so a pair comes from one name. Should an id stand for several paths, a pair counts if any two of these differ.
    ends = lambda rows, id_, p, q: rows.groupBy(id_, "key").agg(F.min("path").alias(p), F.max("path").alias(q))
    left, right = G.checkpoint(ends(called, "a", "_p", "_q")), G.checkpoint(ends(declared, "b", "_r", "_s"))
    sizes = lambda rows, n: rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    blocks = G.checkpoint(sizes(left, "_m").join(sizes(right, "_n"), "key"))
    met = G.crossed(left.join(blocks, "key"), right.join(blocks, "key"), ["key"])
    return met.filter("_p <> _r or _p <> _q or _r <> _s").select("a", "b")


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes, edges: an extraction. Calls of a symbol that another file declares under the same name, whatever the case: edges from the caller (the first that
    has the call, by id) to the symbol; and, lifted, from file to file. Their number grows with the square of the files that share a name; :func:`file_calls` has the lifted ones
    unexpanded."""
    type_ = F.lit("Calls").alias("type")
    return symbol_calls(nodes, edges).select("a", "b", type_), G.expanded(file_calls(nodes, edges)).select("a", "b", type_)


def ancestors(path: Column) -> Column:
    """A file's folders from its own to the root (an empty text): structs of ``folder`` and ``up``, how many steps it is away."""
    folders = F.split(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/")
    depth = F.size(folders) - 1
    return F.transform(F.sequence(F.lit(0), depth), lambda up: F.struct(F.array_join(F.slice(folders, F.lit(1), depth - up), "/").alias("folder"), up.alias("up")))


def resolve_scoped(called: DataFrame, declared: DataFrame, links: DataFrame, most: int = 1) -> DataFrame:
    """Which declarations calls mean, ``most`` of them a call, however many files declare the name. called: ``path``, ``label``; declared: ``path``, ``label``; links: ``a``, ``b`` paths
    of resolved imports. ``path``, ``label``, ``target``, ``how``: declarations of files that the caller imports come first (``import``); where there is none, those of the
    nearest folder around the caller (``folder``), the lesser path first. Names are compared without case, the caller's own file is no target.

    No join is on the name alone: imported files meet by path and name; otherwise each folder above a declaration keeps the first few paths of a name (limited before
    they are shuffled), and a call looks at its own folders."""
    asks = called.select("path", "label", F.lower("label").alias("key")).distinct()
    has = declared.select(F.col("path").alias("target"), F.lower("label").alias("key")).distinct()
    order = Window.partitionBy("path", "key")
    reached = asks.select("path", "key").distinct().join(links.filter("a <> b").select(F.col("a").alias("path"), F.col("b").alias("target")).distinct(), "path").join(has, ["target", "key"])
    reached = G.checkpoint(reached.withColumn("rn", F.row_number().over(order.orderBy("target"))).filter(F.col("rn") <= most).select("path", "key", "target"))
    # One more than is wanted, since one of them may be the caller's own file.
    first = Window.partitionBy("key", "folder").orderBy("target")
    held = has.select("key", "target", F.explode(ancestors(F.col("target"))).alias("x")).select("key", "target", "x.folder")
    held = held.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= most + 1).select("key", "folder", "target")
    rest = asks.select("path", "key").distinct().join(reached.select("path", "key").distinct(), ["path", "key"], "left_anti")
    around = rest.select("path", "key", F.explode(ancestors(F.col("path"))).alias("x")).select("path", "key", "x.folder", "x.up")
    near = around.join(held, ["key", "folder"]).filter("path <> target").groupBy("path", "key", "target").agg(F.min("up").alias("up"))
    near = near.withColumn("rn", F.row_number().over(order.orderBy("up", "target"))).filter(F.col("rn") <= most).select("path", "key", "target")
    found = reached.withColumn("how", F.lit("import")).unionByName(near.withColumn("how", F.lit("folder")))
    return asks.join(found, ["path", "key"]).select("path", "label", "target", "how")


def scoped_calls(nodes: DataFrame, edges: DataFrame, files: DataFrame, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """:func:`resolve_calls` with a bound: nodes, edges: an extraction; files: ``path``. Edges from the caller to the symbol of each file that :func:`resolve_scoped` names, and
    from file to file."""
    called = nodes.filter("kind = 'call'").select(F.col("id").alias("call"), "path", "label", F.lower("label").alias("key"))
    caller = edges.filter("relation = 'calls'").groupBy(F.col("b").alias("call")).agg(F.min("a").alias("a"))
    symbol = nodes.filter(~F.col("kind").isin("file", "import", "call", "rationale")).select(F.col("id").alias("b"), "path", "label")
    made = nodes.filter("kind = 'import'").select("path", F.col("label").alias("target"))
    found = resolve_scoped(called, symbol, J.resolve_imports(made, files), most).select("path", F.lower("label").alias("key"), "target").distinct()
    target = symbol.select("b", F.col("path").alias("target"), F.lower("label").alias("key")).groupBy("target", "key").agg(F.min("b").alias("b"))
    met = called.join(found, ["path", "key"]).join(target, ["target", "key"]).join(caller, "call")
    type_ = F.lit("Calls").alias("type")
    return met.select("a", "b", type_).distinct(), met.select(file_id(F.col("path")).alias("a"), file_id(F.col("target")).alias("b"), type_).distinct()


def calls_within(nodes: DataFrame) -> DataFrame:
    """``a`` (call), ``b`` (symbol): calls of a symbol of the same file, the first of its name by line."""
    called = nodes.filter("kind = 'call'").select(F.col("id").alias("a"), "path", F.lower("label").alias("key"))
    first = nodes.filter(~F.col("kind").isin("file", "import", "call")).groupBy("path", F.lower("label").alias("key")).agg(F.min_by("id", F.struct("start_line", "id")).alias("b"))
    return called.join(first, ["path", "key"]).select("a", "b").distinct()


def import_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path``, ``label`` of what each file's node imports."""
    made = edges.filter("relation = 'imports'").select(path_of(F.col("a")).alias("path"), F.col("b").alias("id"))
    return made.join(nodes.select("id", "label"), "id").select("path", "label").distinct()


def file_links(edges: DataFrame | G.Bundles, nodes: DataFrame) -> DataFrame | G.Bundles:
    """``a``, ``b``: paths of files that an edge links, through their nodes; of bundles (of :func:`file_calls`) bundles."""
    if isinstance(edges, G.Bundles):
        return G.Bundles(edges.sources.select(path_of(F.col("a")).alias("a"), "key"), edges.targets.select("key", path_of(F.col("b")).alias("b")))
    ends = edges.filter(F.col("type").isin(LINKS)).select("a", "b").distinct()
    left = paths_of(ends.withColumnRenamed("a", "id"), nodes).select(F.col("path").alias("from"), F.col("b").alias("id"))
    both = paths_of(left, nodes).select(F.col("from").alias("a"), F.col("path").alias("b"))
    return both.filter("a is not null and b is not null and a <> b").distinct()


def communities(files: DataFrame, links: DataFrame | G.Bundles, most: int = 24, listed: int = 40) -> DataFrame:
    """files: ``path``, ``role``, ``importance``; links: ``a``, ``b`` paths. ``seed`` (the most important file), ``size``, ``folder`` and ``layer`` (the most frequent ones; ties to
    the lesser name), ``file_paths`` (the most important ones): linked files, the largest groups first; a file without links is a group."""
    rows = files.select("path", C.top_folder(F.col("path")).alias("folder"), P.layer(F.col("role")).alias("layer"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    member = G.checkpoint(G.components(links, rows.select(F.col("path").alias("node"))).select(F.col("node").alias("path"), "component").join(rows, "path"))
    mode = lambda c: member.groupBy("component", c).agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
    order = Window.partitionBy("component").orderBy(F.desc("importance"), "path")
    # Only the listed ones are ranked, so tasks keep that many of a group before they are shuffled.
    ranked = member.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max(listed, 1))
    first = ranked.groupBy("component").agg(F.max(F.when(F.col("rn") == 1, F.col("path"))).alias("seed"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= listed, F.struct("rn", "path")))), lambda x: x["path"]).alias("file_paths"))
    head = member.groupBy("component").agg(F.count("*").alias("size")).join(first, "component")
    out = head.join(mode("folder"), "component").join(mode("layer"), "component").drop("component")
    return out.orderBy(F.desc("size"), "seed").limit(most)


def hubs(edges: DataFrame | G.Bundles, nodes: DataFrame, files: DataFrame, least: int = 2, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """The best hubs (``path``, ``label``, ``layer``, ``degree``), one a file, and how many nodes of each layer there were before that (``layer``, ``n``)."""
    degree = G.degree(edges).filter(F.col("degree") >= least).withColumnRenamed("node", "id")
    found = paths_of(degree, nodes).join(nodes.select("id", "label"), "id", "left").filter("path is not null").join(files.select("path", "role"), "path", "left")
    found = found.withColumn("layer", P.hub_layer(F.col("path"), F.coalesce("role", F.lit("Unknown"))))
    once = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("degree"), "id"))
    best = found.withColumn("rn", once).filter("rn = 1").select("path", "label", "layer", "degree")
    return best.orderBy(F.desc("degree"), "path").limit(most), found.groupBy("layer").agg(F.count("*").alias("n"))


def focused(nodes: DataFrame) -> DataFrame:
    """Nodes of the types that a view shows, or all if there is none of them."""
    kept = nodes.filter(F.col("type").isin(FOCUS))
    return kept if kept.limit(1).count() else nodes


def symbol_view(nodes: DataFrame, edges: DataFrame, most: int = 800) -> tuple[DataFrame, DataFrame]:
    """The nodes of a view, those of the highest degree where there are more than ``most`` (a limit of the view), and the edges between them."""
    rows = focused(nodes).join(G.degree(edges.select("a", "b")).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = rows.orderBy(F.desc("degree"), "label", "id").limit(most)
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def by_category(files: DataFrame, most: int = 12) -> DataFrame:
    """files: ``path``, ``role``. ``category``, ``path``: the first files of each of six categories."""
    rows = files.withColumn("category", P.mapped(F.col("role"), P.CATEGORIES)).filter("category is not null")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("path"))).filter(F.col("rn") <= most).select("category", "path")


def buckets(files: DataFrame) -> DataFrame:
    """``bucket``, ``paths``: a project's folder lists."""
    rows = files.withColumn("bucket", P.bucket(F.col("role"))).filter("bucket is not null")
    return rows.groupBy("bucket").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def prioritized(files: DataFrame) -> DataFrame:
    """Files in the order in which they are read: by priority, then path."""
    return files.withColumn("priority", P.priority(F.col("path"))).orderBy(F.desc("priority"), "path")


def most_important(files: DataFrame, most: int = 28) -> DataFrame:
    """files: ``path``, ``role``, ``importance``. ``label``, ``role``, ``path`` of the most important files, a list of the contract's length."""
    rows = files.orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.lower("path"), "path").limit(most)
    return rows.select(P.name_of(F.col("path")).alias("label"), "role", "path")
