"""Indexing a project: summaries and chunks of its files, its stack and rules, incremental syncs, health."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as K
from ..functions import code as C
from ..functions import files as P
from ..functions import scopes as S
from ..functions import text as X
from ..sources.files import listed, read_listed
from ..sources.tree import same_listing
from . import graph as G
from . import sync as Y

#: Package managers by files at the root, in order; frameworks, styling and libraries by dependency, in order (fixed values).
MANAGERS = [("pnpm", ["pnpm-lock.yaml"]), ("yarn", ["yarn.lock"]), ("bun", ["bun.lockb"]), ("npm", ["package-lock.json"]), ("dotnet", ["*.csproj", "*.sln"]), ("pip", ["requirements.txt", "pyproject.toml"])]
FRAMEWORKS = [("Next.js", ["next"]), ("Remix", ["@remix-run/react"]), ("Nuxt", ["nuxt"]), ("Angular", ["@angular/core"]), ("Svelte", ["svelte"]), ("Vue", ["vue"]), ("React", ["react"]), ("Node API", ["express", "fastify"])]
STYLES = [("styled-components", ["styled-components"]), ("Emotion", ["@emotion/react"]), ("Sass", ["sass"])]
LIBRARIES = [("MUI", ["@mui/material"]), ("Chakra UI", ["@chakra-ui/react"]), ("Ant Design", ["antd"]), ("Mantine", ["@mantine/core"])]
ANIMATIONS = [("GSAP", ["gsap"]), ("Lenis", ["lenis", "@studio-freight/lenis"]), ("Framer Motion", ["framer-motion"]), ("anime.js", ["animejs"])]
#: Retrieval modes by status (fixed values).
MODES = {"Ready": "Semantic + keyword", "PartialReady": "Partial semantic + keyword", "VectorStoreUnavailable": "Keyword fallback", "EmbeddingUnavailable": "Keyword fallback"}
#: Chunks of a project and texts of an embedding batch (the index's own limits).
MOST_CHUNKS, BATCH = 8000, 16


def summarized(files: DataFrame) -> DataFrame:
    """files: ``path``, ``content``. Adds ``role``, ``language``, ``importance``, ``imports``, ``exports``, ``symbols``, ``preview_chunks``, ``summary``."""
    text = F.coalesce("content", F.lit(""))
    rows = files.withColumn("role", P.role(F.col("path"), text)).withColumn("_c", C.inspect(text))
    rows = rows.withColumns({"language": P.language(F.col("path")), "importance": P.importance(F.col("path"), F.col("role")), "imports": F.col("_c.imports"), "exports": F.col("_c.exports"), "symbols": F.col("_c.symbols"), "preview_chunks": F.coalesce(X.preview_chunks(text), F.array().cast("array<string>"))})
    return rows.withColumn("summary", K.summary(text, F.col("role"), F.col("symbols"))).drop("_c")


def point_id(text: Column) -> Column:
    """A stable id: the first 16 bytes of the SHA-256, in the usual groups."""
    h = F.sha2(text.cast("binary"), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunked(files: DataFrame, project: str, most: int | None = None, by: str = "scopes") -> DataFrame:
    """files: of :func:`summarized`, with ``hash``. by: ``scopes`` cuts files at their declarations where these are known, ``lines`` by patterns. One row a chunk: ``id``, ``path``, ``file_name``, ``folder``, ``language``, ``kind``, ``symbol``, ``parent``, ``start_line``,
    ``end_line``, ``body``, ``preview``, ``imports``, ``tags``, ``file_hash``, ``hash``, ``importance``, ``metadata``. most: of a project over the limit, chunks of the most
    important files come first."""
    plain = F.transform(K.ranges(F.col("path"), F.col("content")), lambda r: r.withField("parent", F.lit("")))
    if by == "scopes":
        files = files.withColumn("_facts", S.facts(F.col("path"), F.col("content")))
        files = files.withColumn("_scoped", K.scoped_ranges(F.col("content"), F.col("_facts"))).drop("_facts")
        plain = F.when(F.size("_scoped") > 0, F.col("_scoped")).otherwise(plain)
    rows = files.select("*", F.posexplode(plain).alias("index", "r"))
    body = F.trim(F.col("r.body"))
    hash_ = X.content_hash(F.concat_ws(":", "hash", F.col("r.start_line").cast("string"), F.col("r.end_line").cast("string"), body))
    tags = F.slice(F.array_distinct(F.filter(F.array(F.lower("role"), F.col("language"), F.col("r.symbol")), lambda t: F.trim(t) != "")), 1, 16)
    meta = F.to_json(F.struct("role", F.col("index").alias("index")))
    rows = rows.select(
        point_id(F.concat_ws(":", F.lit(project), "path", F.substring(hash_, 1, 16))).alias("id"), "path", P.name_of(F.col("path")).alias("file_name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        "language", F.col("r.kind").alias("kind"), F.col("r.symbol").alias("symbol"), F.col("r.parent").alias("parent"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"),
        body.alias("body"), X.preview(body).alias("preview"), "imports", tags.alias("tags"), F.col("hash").alias("file_hash"), hash_.alias("hash"), "importance", meta.alias("metadata"),
    )
    return rows if most is None else rows.orderBy(F.desc("importance"), "path", "start_line", "id").limit(most)


def documents(files: DataFrame) -> DataFrame:
    """``id``, ``path``, ``role``, ``summary``, ``text``: files as documents of the fallback search."""
    text = F.concat_ws(" ", "path", "summary", F.array_join("symbols", " "), F.get("preview_chunks", F.lit(0)))
    return files.select(F.col("path").alias("id"), "path", "role", "summary", text.alias("text"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """manifests: ``content`` of package.json files. ``name`` of each dependency; what doesn't parse has none."""
    got = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.flatten(F.filter(F.array(F.map_keys(got["dependencies"]), F.map_keys(got["devDependencies"])), lambda k: k.isNotNull()))
    return manifests.select(F.explode(keys).alias("name")).distinct()


def stack(files: DataFrame) -> DataFrame:
    """files: ``path``, ``content``. One row: ``package_manager``, ``language``, ``framework``, ``styling``, ``ui_library``, ``animations`` (array), by files at the root and by
    dependencies; the first rule that fits counts."""
    root = files.filter(~F.contains("path", F.lit("/")))
    names = dependencies(root.filter("path = 'package.json'")).select(F.concat(F.lit("dep:"), "name").alias("x")).union(root.select(F.concat(F.lit("file:"), "path").alias("x")))
    dep = lambda n: F.col("x") == f"dep:{n}"
    file = lambda n: F.col("x").like(f"file:%{n[1:]}") if n[0] == "*" else F.col("x") == f"file:{n}"
    have: dict[str, Column] = {"any_dep": F.col("x").startswith("dep:"), "manifest": file("package.json"), "tsconfig": file("tsconfig.json") | dep("typescript"), "csproj": file("*.csproj"), "pip": file("pyproject.toml") | file("requirements.txt"), "tailwind": dep("tailwindcss") | file("tailwind.config.js") | file("tailwind.config.ts"), "radix": F.col("x").startswith("dep:@radix-ui/")}
    for what, rules, test in (("manager", MANAGERS, file), ("framework", FRAMEWORKS, dep), ("style", STYLES, dep), ("library", LIBRARIES, dep), ("animation", ANIMATIONS, dep)):
        for i, (_, any_of) in enumerate(rules):
            fits = F.lit(False)
            for n in any_of:
                fits = fits | test(n)
            have[f"{what}{i}"] = fits
    seen = names.agg(*(F.coalesce(F.max(c), F.lit(False)).alias(k) for k, c in have.items()))
    c = F.col

    def first(what: str, rules: list, before: list[tuple[str, str]] = (), after: list[tuple[str, str]] = ()) -> Column:
        pairs = [*before, *((f"{what}{i}", name) for i, (name, _) in enumerate(rules)), *after]
        return F.coalesce(*(F.when(c(k), F.lit(v)) for k, v in pairs))

    return seen.select(
        first("manager", MANAGERS, after=[("manifest", "npm")]).alias("package_manager"),
        F.when(c("tsconfig"), "TypeScript").when(c("csproj"), "C#").when(c("pip"), "Python").when(c("any_dep"), "JavaScript").alias("language"),
        first("framework", FRAMEWORKS, after=[("csproj", ".NET")]).alias("framework"),
        first("style", STYLES, before=[("tailwind", "Tailwind CSS")]).alias("styling"),
        first("library", LIBRARIES, before=[("radix", "shadcn/Radix UI")]).alias("ui_library"),
        F.array_compact(F.array(*(F.when(c(f"animation{i}"), F.lit(name)) for i, (name, _) in enumerate(ANIMATIONS)))).alias("animations"),
    )


def bullets(files: DataFrame, rule_files: list[str], most: int = 6) -> DataFrame:
    """``path``, ``line``, ``rule``: the first bullet lines of each rule file, without secrets."""
    rows = files.filter(F.col("path").isin(rule_files)).select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    rows = rows.filter(F.col("text").rlike(r"^\s*[-*] ")).withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    return rows.filter(F.col("rn") <= most).select("path", "line", X.redact(F.trim(F.regexp_replace("text", r"^\s*[-*] ", ""))).alias("rule"))


def rules(of: DataFrame, files: DataFrame, rule_files: list[str], most: int = 12) -> DataFrame:
    """of: :func:`stack`. ``place``, ``rule``: conventions that follow from the stack, from right-to-left text and from rule files, each once, ``most`` of them (the
    contract's length). The wording is our own."""
    rtl = files.agg(F.coalesce(F.max(X.rtl(F.coalesce("content", F.lit("")))), F.lit(False)).alias("rtl"))
    made = [
        F.when(F.col("language") == "TypeScript", "TypeScript: keep types explicit and accurate."),
        F.when(F.col("styling").isNotNull(), F.concat(F.lit("Styling: "), "styling", F.lit("; follow the patterns at hand."))),
        F.when(F.col("framework") == "Next.js", "Next.js: follow its routing and file conventions."),
        F.when(F.col("ui_library").isNotNull(), F.concat(F.lit("Components: reuse "), "ui_library", F.lit("."))),
        F.when(F.size("animations") > 0, F.concat(F.lit("Animation: use "), F.array_join("animations", ", "), F.lit("."))),
        F.when(F.col("rtl"), "Keep right-to-left text and its direction."),
    ]
    derived = of.join(F.broadcast(rtl)).select(F.posexplode(F.array(*made)).alias("place", "rule")).filter("rule is not null")  # one row each
    read = bullets(files, rule_files).select((F.lit(100) + F.dense_rank().over(Window.orderBy("path", "line"))).alias("place"), "rule")  # bounded: 6 rows a rule file
    return derived.union(read).groupBy("rule").agg(F.min("place").alias("place")).orderBy("place").limit(most).select("place", "rule")


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """chunks: ``id``, ``text``. ``id``, ``vector``: texts go to the model in batches, behind the mark of passages; a batch that fails has null vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            for at in range(0, len(frame), batch):
                texts = [f"passage: {t}" for t in frame["text"].iloc[at : at + batch]]
                try:
                    out += [list(map(float, v)) for v in model(texts)]
                except Exception:  # noqa: BLE001 - a model of the caller's; the failure is counted by the null vectors
                    out += [None] * len(texts)
            yield pd.DataFrame({"id": frame["id"], "vector": out})

    return chunks.select("id", "text").mapInPandas(run, "id string, vector array<double>")


def query_text(query: Column) -> Column:
    return F.concat(F.lit("query: "), query)


@dataclass
class Synced:
    """What a sync did: ``status`` (initial, unchanged or updated), counts of added, modified and removed files, of embedded and failed chunks, of files whose content
    was read and of chunk buckets that were rewritten."""

    status: str
    added: int = 0
    modified: int = 0
    removed: int = 0
    embedded: int = 0
    failed: int = 0
    read: int = 0
    buckets: int = 0


def sync(collections, name: str, files: DataFrame, project: str, model: Callable | None = None, force: bool = False, most: int | None = MOST_CHUNKS, again: Callable[[], Synced] | None = None) -> Synced:
    """Brings a collection up to date with files (``path``, ``content``, ``hash`` and more). Nothing is read beyond the hashes where none changed. Else only new and changed files are
    summarised, chunked and embedded, and only the buckets of their paths and of removed ones are rewritten, in the collection's tables (chunks, ``<name>.files``), which are kept
    in buckets by path. Vectors of another length than before make all files new (``again`` is then called, where the given files don't hold all contents). most: new chunks fill what the kept ones leave of it, the most important files first."""
    known = collections.read(f"{name}.files")
    spark = files.sparkSession
    before = known.select("path", "hash") if known is not None else spark.createDataFrame([], "path string, hash string")
    status = G.checkpoint(Y.changes(files.select("path", "hash"), before))
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # four rows at most
    done = Synced("initial" if known is None else "updated", n.get("added", 0), n.get("modified", 0), n.get("removed", 0))
    if known is not None and not force and not (done.added or done.modified or done.removed):
        return Synced("unchanged")
    whole = force or known is None
    gone = status.filter("status <> 'unchanged'").select("path") if not whole else status.select("path")
    new = status.filter("status <> 'removed'" if whole else "status IN ('added', 'modified')").select("path")
    summed = G.checkpoint(summarized(files.join(new, "path", "left_semi")))
    old = collections.read(name)
    room = most
    if most is not None and not whole:
        room = max(0, most - old.join(gone, "path", "left_anti").count())
    chunks = G.checkpoint(chunked(summed, project, room))
    text = K.embedded({c: F.col(c) for c in ("path", "language", "kind", "symbol", "parent", "imports", "body")})
    vectors = embed(chunks.select("id", text.alias("text")), model) if model else chunks.select("id", F.lit(None).cast("array<double>").alias("vector"))
    vectors = G.checkpoint(vectors.dropDuplicates(["id"]))
    done.embedded, done.failed, size = vectors.agg(F.count("vector"), F.count("*") - F.count("vector"), F.max(F.size("vector"))).first()
    if not whole and done.embedded and (was := old.agg(F.max(F.size("vector"))).first()[0]) not in (None, -1, size):
        return again() if again else sync(collections, name, files, project, model, True, most)
    rows, summed = chunks.join(vectors, "id", "left"), summed.drop("content")
    if whole:
        collections.write(name, rows, "path")
        collections.write(f"{name}.files", summed, "path")
        return done
    done.buckets = collections.merge(name, rows, gone)
    collections.merge(f"{name}.files", summed, gone)
    return done


def sync_tree(collections, name: str, spark: SparkSession, root: str, project: str, model: Callable | None = None, force: bool = False, most: int | None = MOST_CHUNKS, max_files: int = 1500, max_bytes: int = 200 << 10) -> Synced:
    """:func:`sync` with a folder tree. Folders are listed; of the files, only those are opened whose size or time is not the known one."""
    now = G.checkpoint(listed(spark, root, max_files, max_bytes))
    known = collections.read(f"{name}.files")
    if known is None or force:
        asked, kept = now, None
    else:
        kept = G.checkpoint(same_listing(known, now))
        asked = now.join(kept, "path", "left_anti")
    read = G.checkpoint(read_listed(asked, root))
    files = read if kept is None else read.unionByName(known.join(kept, "path", "left_semi").select(*(F.col(c) if c in known.columns else F.lit(None).cast(read.schema[c].dataType).alias(c) for c in read.columns)))
    done = sync(collections, name, files, project, model, force, most, lambda: sync_tree(collections, name, spark, root, project, model, True, most, max_files, max_bytes))
    if kept is not None and done.status != "initial":
        # Files that were written again with the same text keep their row, but for size and time, so that they aren't read the next time.
        seen = read.select("path", "hash", "size_bytes", "modified_at")
        again = G.checkpoint(known.drop("size_bytes", "modified_at").join(seen, ["path", "hash"]))
        collections.merge(f"{name}.files", again, again.select("path"))
    done.read = done.read or asked.count()
    return done


def not_embedded(chunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """``path``, ``reason``: skipped files, and files with a chunk that has no vector; by path."""
    bare = chunks.filter("vector is null").select("path").distinct().select("path", F.lit("not embedded").alias("reason"))
    return skipped.select("path", "reason").unionByName(bare).orderBy("path", "reason")


def metadata(files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on an index: counts, the vectors' length, the status (Ready, PartialReady, EmbeddingUnavailable or Empty) and what part is embedded, 0 to 100."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("preview_chunks")), F.lit(0)).alias("previews"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"))
    rows = f.join(F.broadcast(c)).join(F.broadcast(nodes.agg(F.count("*").alias("nodes")))).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    status = F.when(F.col("chunks") == 0, "Empty").when(F.col("vectors") == F.col("chunks"), "Ready").when(F.col("vectors") > 0, "PartialReady").otherwise("EmbeddingUnavailable")
    part = F.when(F.col("chunks") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.col("vectors") / F.col("chunks")))).otherwise(0.0)
    return rows.withColumn("status", status).withColumn("progress", part).withColumn("mode", P.mapped(F.col("status"), MODES, "No brain"))


def file_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.lower("path").alias("path")).agg(F.min("file_hash").alias("hash"))


def health(of: DataFrame, embedder: bool) -> DataFrame:
    """of: :func:`metadata`. ``check``, ``ok``, ``detail``."""
    checks = [
        ("index", F.col("files") > 0, F.concat(F.col("files").cast("string"), F.lit(" files"))),
        ("vectors", F.col("vectors") > 0, F.concat(F.col("vectors").cast("string"), F.lit(" of "), F.col("chunks").cast("string"), F.lit(" chunks"))),
        ("graph", F.col("nodes") > 0, F.concat(F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("edges").cast("string"), F.lit(" edges"))),
        ("embedder", F.lit(embedder), F.lit("reachable" if embedder else "unavailable")),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("check"), ok.alias("ok"), detail.alias("detail")) for k, ok, detail in checks))
    return of.select(F.explode(rows).alias("c")).select("c.*")


def status_payload(of: DataFrame) -> DataFrame:
    """The index's row as one JSON text."""
    return of.select(F.to_json(F.struct(*of.columns)).alias("json"))


def view_payload(nodes: DataFrame, edges: DataFrame, legend: DataFrame) -> DataFrame:
    """A bounded view (see :func:`structure.symbol_view`) as one JSON text."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    rows = listed(nodes, "nodes").join(F.broadcast(listed(edges, "edges"))).join(F.broadcast(listed(legend, "legend")))  # one row each
    return rows.select(F.to_json(F.struct("nodes", "edges", "legend")).alias("json"))


def first_named(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that isn't blank, and the label of its source."""
    kept = [(label, F.when(~X.blank(c), F.trim(c))) for label, c in sources]
    return F.coalesce(*(c for _, c in kept)), F.coalesce(*(F.when(c.isNotNull(), label) for label, c in kept))


def recent(rows: DataFrame, ts: str, now: Column, hours: int = 6) -> DataFrame:
    return rows.filter((F.col(ts) >= now - F.expr(f"interval {hours} hours")) & (F.col(ts) <= now))


def counters(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def indexed_projects(spark: SparkSession, pattern: str) -> DataFrame:
    """``root`` of the projects whose JSON snapshots a path pattern finds, each once; what doesn't parse is left out."""
    rows = spark.read.schema("root string, name string, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(pattern)
    return rows.filter("root is not null").select("root").distinct().orderBy(F.lower("root"))


def clamp(settings: dict[str, float], bounds: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Settings within their bounds; those without one stay."""
    return {k: min(max(v, bounds[k][0]), bounds[k][1]) if k in bounds else v for k, v in settings.items()}
