"""Roles, languages, priorities and layers of files by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension (fixed values).
LANGUAGES = {
    "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "csharp": [".cs"],
    "xml": [".csproj", ".sln", ".props", ".targets", ".resx", ".config", ".xaml"], "python": [".py"], "json": [".json"],
    "markdown": [".md", ".mdx"], "css": [".css", ".scss", ".sass", ".less"], "sql": [".sql"], "yaml": [".yaml", ".yml"], "toml": [".toml"],
    "html": [".html", ".htm"], "powershell": [".ps1", ".psm1", ".psd1"], "ini": [".editorconfig", ".ini"],
}
#: Importance by role, and additions by path (fixed values).
IMPORTANCE = {"Docs": 0.95, "Config": 0.9, "Route": 0.86, "Api": 0.86, "Component": 0.78, "Database": 0.74, "Util": 0.68, "Hook": 0.68, "Test": 0.35}


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def any_in(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def role(path: Column, content: Column) -> Column:
    """The first rule that fits names the role; folder rules ask for a leading slash."""
    low = F.lower(F.translate(path, "\\", "/"))
    name, ext = name_of(low), extension_of(low)
    test = name.rlike(r"(\.test\.|\.spec\.|_test\.|tests?\.[a-z]+$)") | any_in(low, ["/tests/", "/__tests__/", "/test/"])
    config = name.isin("package.json", "tsconfig.json", "dockerfile") | F.contains(name, F.lit("config")) | name.startswith(".env")
    style = ext.isin(".css", ".scss", ".sass", ".less")
    docs = ext.isin(".md", ".mdx", ".txt") | F.contains(low, F.lit("/docs/"))
    database = any_in(low, ["/prisma/", "/db/", "/database/", "/models/"]) | ext.isin(".sql", ".prisma")
    api = any_in(low, ["/api/", "/routes/"]) | name.startswith("route.") | any_in(content, ["export async function GET", "createServer"])
    route = F.contains(low, F.lit("/pages/")) | (F.contains(low, F.lit("/app/")) & name.rlike(r"^(page|layout)\."))
    hook = F.contains(low, F.lit("/hooks/")) | (name.startswith("use") & ext.isin(".ts", ".tsx", ".js", ".jsx"))
    component = F.contains(low, F.lit("/components/")) | ext.isin(".tsx", ".jsx", ".vue", ".svelte")
    util = any_in(low, ["/utils/", "/lib/", "/helpers/"])
    out = F.lit("Unknown")
    for what, rule in reversed([("Test", test), ("Config", config), ("Style", style), ("Docs", docs), ("Database", database), ("Api", api), ("Route", route), ("Hook", hook), ("Component", component), ("Util", util)]):
        out = F.when(F.coalesce(rule, F.lit(False)), what).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext, out = extension_of(path), F.when(F.lower(name_of(path)) == "dockerfile", "dockerfile").otherwise("text")
    for what, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts), what).otherwise(out)
    return out


def priority(path: Column) -> Column:
    low = F.lower(path)
    steps = [
        (100, any_in(low, ["readme", "docs/"])), (90, any_in(low, ["config"]) | low.isin("package.json", "tsconfig.json")),
        (80, any_in(low, ["src/app", "pages/", "routes/"])), (70, any_in(low, ["components/"])), (60, any_in(low, ["lib/", "services/", "api/"])),
        (50, any_in(low, ["schema", "migration", "prisma"])), (30, any_in(low, ["test", "spec"])),
    ]
    out = F.lit(10)
    for value, rule in reversed(steps):
        out = F.when(rule, value).otherwise(out)
    return out


def importance(path: Column, of_role: Column) -> Column:
    low = F.lower(path)
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in IMPORTANCE.items() for x in kv))[of_role], F.lit(0.5))
    more = F.when(any_in(low, ["auth", "login"]), 0.12).otherwise(0.0) + F.when(any_in(low, ["readme", "package.json"]), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + more))


#: Node types by role; all other roles are files (fixed values).
NODE_TYPES = {"Route": "Route", "Component": "Component", "Hook": "Hook", "Api": "Api", "Style": "Style", "Config": "Config"}
#: Lists of a project's folders by role (fixed values).
BUCKETS = {"Route": "routes", "Component": "components", "Hook": "utils", "Util": "utils", "Style": "styles", "Api": "api", "Database": "data"}
#: Layers by role (fixed values).
LAYERS = {"Config": "config", "Api": "api", "Route": "api", "Component": "ui", "Style": "ui", "Database": "data"}
#: Grammars by extension (fixed values).
GRAMMARS = {
    "TSX": [".tsx"], "TypeScript": [".ts"], "JavaScript": [".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro"], "Python": [".py"],
    "CSharp": [".cs", ".razor", ".cshtml"], "Go": [".go"], "Rust": [".rs"], "Java": [".java", ".kt"], "Ruby": [".rb"], "PHP": [".php"], "Swift": [".swift"],
    "Scala": [".scala"], "Bash": [".sh", ".bash"], "JSON": [".json"], "HTML": [".html", ".htm"], "CSS": [".css", ".scss", ".sass", ".less"],
    "TOML": [".toml"], "CodeQL": [".sql"],
}
#: Categories of a project's overview, by role; our own names.
CATEGORIES = {"Route": "pages", "Component": "components", "Api": "api", "Database": "data", "Config": "config", "Style": "styles"}


def mapped(key: Column, table: dict[str, str], other: str | None = None) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], F.lit(other))


def node_type(of_role: Column) -> Column:
    return mapped(of_role, NODE_TYPES, "File")


def bucket(of_role: Column) -> Column:
    """The folder list that a file belongs to; null for none."""
    return mapped(of_role, BUCKETS)


def grammar(path: Column) -> Column:
    """The grammar that reads a file; null for none."""
    return mapped(extension_of(path), {e: g for g, exts in GRAMMARS.items() for e in exts})


def layer(of_role: Column) -> Column:
    return mapped(of_role, LAYERS, "core")


def hub_layer(path: Column, of_role: Column) -> Column:
    """Layer by role or by words in the path, the first that fits."""
    low = F.lower(path)
    return (
        F.when((of_role == "Config") | any_in(low, ["appsettings", "config"]), "config")
        .when(of_role.isin("Api", "Route") | any_in(low, ["/api/", "controller"]), "api")
        .when(of_role.isin("Component", "Style") | low.endswith(".xaml") | any_in(low, ["/ui/"]), "ui")
        .when((of_role == "Database") | any_in(low, ["migration", "repository"]), "data")
        .otherwise("core")
    )
