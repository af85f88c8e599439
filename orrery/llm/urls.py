"""URL filters by a path-template tree.

The urls of each host form a tree of path segments. Variable parts of a segment (numbers, long hexadecimal strings) become
wildcards; below a node with many different children, rare children become one wildcard child. Children whose share of bad labelled
pages doesn't differ significantly from that of their siblings (two-proportion z-test) are merged into one branch. What is left is a
template; a template is rejected if its purity, the share of good pages among its labelled ones, smoothed towards that of all labelled
pages, falls below a threshold. Rules come before the tree: the longest rule that fits decides.

DataFrame functions only. The tree works on distinct generalised paths with counts, combined before each shuffle; joins on hosts or
paths are sort-merge joins, whose hot partitions adaptive execution splits. Nothing is collected.

Every segment of a path is a level, however deep; a level takes one round, and only hosts with longer paths stay in the rounds. The SQL
spells out ``DEPTH`` levels, which is all that the tables at hand have; deeper paths it ends in ``**``.

Cases: a null url, or one without ``://``, has an empty host and path, which form a template like any other; pages whose label is null or missing count as unlabelled; repeated rows count each; a null page id joins no label;
without any label no template is rejected; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DEPTH, CHILDREN, RARE, Z, PRIOR, PURITY = 3, 32, 0.05, 1.96, 8.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict; both null where none fits. rules: (verdict, host and path) pairs, a list of a size that a
    plan can hold."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest is asked first; of equal length, the one with the longer host.
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[0])):
        own, _, tail = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{tail}"))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def generalised(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9a-f]{16,}", "#"), r"[0-9]+", "#")


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """labels: ``label_id``, ``quality``, ``toxic``; a page is bad if its quality is 0 or toxic is 1. Returns for each row ``page_id``,
    ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` (smoothed)."""
    host, path = host_path(pages[url])
    rows = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    # The wildcards never span a slash.
    rows = rows.withColumn("general", generalised(F.regexp_replace("path", "^/", "")))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.filter("quality is not null or toxic is not null").groupBy(labels[label_id].alias("_id")).agg(F.max(bad.cast("int")).alias("bad"))
    keys = ["host", "general"]
    counted = rows.join(known, F.col("page_id") == F.col("_id"), "left")
    tree = counted.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialize(tree.select("*", F.split("general", "/", -1).alias("segments"), F.lit("").alias("prefix")), "paths")
    tree = materialize(tree.join(tree.groupBy("host").agg(F.max(F.size("segments")).alias("deepest")), "host"), "tree")
    done, seg = [], "segment"
    depth = tree.agg(F.max("deepest")).first()[0] or 0
    for i in range(depth):
        done.append(tree.filter(F.col("deepest") <= i))
        tree = tree.filter(F.col("deepest") > i).withColumn(seg, F.coalesce(F.get("segments", F.lit(i)), F.lit("")))
        child = tree.groupBy("host", "prefix", seg).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        parent = child.groupBy("host", "prefix").agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")))
        both = child.join(parent, ["host", "prefix"])
        l, m = F.col("labelled").cast("double"), (F.col("all_labelled") - F.col("labelled")).cast("double")
        p = F.col("all_bad") / F.col("all_labelled").cast("double")
        gap = F.abs(F.col("bad") / l - (F.col("all_bad") - F.col("bad")) / m)
        differs = F.when((l > 0) & (m > 0), gap > Z * F.sqrt(p * (1 - p) * (1 / l + 1 / m))).otherwise(False)
        rare = (F.col("kids") > CHILDREN) & (F.col("n") < RARE * F.col("all_n"))
        made = F.when(F.col(seg) == "", "").when(F.coalesce(differs, F.lit(False)), F.concat(F.lit("/"), F.col(seg))).when(rare, "/*").otherwise("/+")
        named = both.select("host", "prefix", seg, F.concat("prefix", made).alias("next"))
        tree = materialize(tree.join(named, ["host", "prefix", seg]).drop("prefix", seg).withColumnRenamed("next", "prefix"), f"tree{i}")
    tree = reduce(DataFrame.unionByName, done, tree).withColumnRenamed("prefix", "template")
    whole = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    rate = (whole["b"] or 0) / whole["l"] if whole["l"] else 0.0
    pure = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pure = pure.withColumn("purity", 1 - (F.col("b") + PRIOR * rate) / (F.col("l") + PRIOR)).select("host", "template", "purity")
    found = tree.join(pure, ["host", "template"]).select(*keys, "template", "purity")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return rows.join(found, keys).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "template", "purity")


def oracle(rules=RULES, depth: int = DEPTH) -> str:
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    order = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[0]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in order) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in order) + " END"
    g = [f"g{i}" for i in range(depth)]
    gen = lambda i: f"coalesce(regexp_replace(regexp_replace(parts[{i + 1}], '[0-9a-f]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g'), '') AS g{i}"
    out = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
sp AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM hp),
rw AS (SELECT page_id, host, path, {', '.join(map(gen, range(depth)))}, CASE WHEN len(parts) > {depth} THEN '/**' ELSE '' END AS tail FROM sp),
kn AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
t0 AS (SELECT host, {', '.join(g)}, tail, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS prefix FROM rw LEFT JOIN kn ON page_id = doc_id GROUP BY ALL)"""
    for i in range(depth):
        out += f""",
c{i} AS (SELECT host, prefix, g{i}, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM t{i} GROUP BY ALL),
p{i} AS (SELECT host, prefix, count(*) AS kids, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM c{i} GROUP BY ALL),
z{i} AS (SELECT *, CAST(labelled AS DOUBLE) AS l, CAST(all_labelled - labelled AS DOUBLE) AS m, all_bad / CAST(all_labelled AS DOUBLE) AS p FROM c{i} JOIN p{i} USING (host, prefix)),
n{i} AS (SELECT host, prefix, g{i}, prefix || CASE WHEN g{i} = '' THEN ''
  WHEN CASE WHEN l > 0 AND m > 0 THEN abs(bad / l - (all_bad - bad) / m) > {Z} * sqrt(p * (1 - p) * (1 / l + 1 / m)) ELSE false END THEN '/' || g{i}
  WHEN kids > {CHILDREN} AND n < {RARE} * all_n THEN '/*' ELSE '/+' END AS next FROM z{i}),
t{i + 1} AS (SELECT t.* EXCLUDE (prefix), n.next AS prefix FROM t{i} t JOIN n{i} n USING (host, prefix, g{i}))"""
    return out + f""",
tt AS (SELECT *, prefix || tail AS template FROM t{depth}),
w AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / CAST(sum(labelled) AS DOUBLE) ELSE 0 END AS rate FROM tt),
pu AS (SELECT host, template, 1 - (sum(bad) + {PRIOR} * max(rate)) / (sum(labelled) + {PRIOR}) AS purity FROM tt, w GROUP BY ALL),
f AS (SELECT tt.*, purity FROM tt JOIN pu USING (host, template))
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM rw JOIN f USING (host, {', '.join(g)}, tail)
"""
