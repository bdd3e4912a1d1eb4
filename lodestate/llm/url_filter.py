"""URL filters by rules and by a path-template tree with smoothed labelled purity, in DataFrame operations only.

Templates are learned level by level. At each node (host, template of the parent) a segment is variable, and becomes `*`,
when it holds a digit or when the node has more than `max_children` children and the segment has fewer than
`min_support` urls. Then statistically similar branches merge, twice: a child whose labelled bad rate does not differ from the
node's pooled rate (two-proportion z below `z`) joins the branch `*`; and children that do differ from it merge with each other
when they have the same shape (levels below them) and the same bad rate, smoothed towards the node's, in steps of `RATE_STEP`. A
branch of one child is `/segment`, one of several is `//` and their smallest segment. A template's purity is its bad rate smoothed
towards its parent template, `(bad + prior_weight * parent) / (labelled + prior_weight)`, from the root (the host) down; the root
is smoothed towards the rate of all labels, one half at most, so no host is rejected without labels of its own. A url is rejected
when its deepest template's purity exceeds `reject_above`.

Everything learned is grouped by (host, template) and never by url, pre-aggregated before each shuffle. Urls and branches meet the
groups in `join_groups`: nodes with one in HEAVY of all rows are broadcast (at most HEAVY of them), so that a hot host or branch
does not shuffle. The tree has as many levels as the longest path has segments. Each level holds only the urls that have a segment
there; a url's walk ends with its last segment, so a rare long path costs little.

Defined cases: a null url, or one without `://`, has an empty host and path and is allowed unless a rule fits; without
any label every url is allowed; repeated rows are judged alike; urls of any length are judged whole; of rules that fit equally long
the last given wins; a bad rate of just `reject_above` is allowed; an empty table gives an empty result; columns other than page_id
and url are not read, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize

MAX_CHILDREN = 50
MIN_SUPPORT = 20
PRIOR_WEIGHT = 5.0
REJECT_ABOVE = 0.6
Z = 1.96
#: Branches of one node whose smoothed bad rates round to the same multiple of this are similar.
RATE_STEP = 0.1

#: Rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    mark = F.instr(url, F.lit("://"))
    rest = F.substring(url, mark + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    there = F.coalesce(mark > 0, F.lit(False))
    return F.when(there, lower).otherwise(""), F.when(there, path).otherwise("")


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host columns `host`, `path`), and its verdict; null where none fits. One flat CASE, longest first."""
    rule = verdict = None
    for host, path, says in sorted(reversed(rules), key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = ((F.when if c is None else c.when)(fits, F.lit(v)) for c, v in ((rule, host + path), (verdict, says)))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _segments() -> Column:
    return F.filter(F.split("path", "/"), lambda s: s != "")


def learn_templates(labelled: DataFrame, max_children: int, min_support: int, prior_weight: float, z: float) -> list[tuple[DataFrame, DataFrame]]:
    """Two tables for each level: the segments with a branch of their own (host, parent, seg, node, purity, rows), and what any other
    segment gets (host, parent, rest_node, rest_purity, rows); rows counts the labelled rows that are looked up there. The first
    level holds the hosts. labelled: host, path and bad (1.0, 0.0 or null where unlabelled)."""
    urls = labelled.groupBy("host", _segments().alias("segs")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.count("bad").alias("known"))
    urls = materialize(urls.fillna(0.0, ["bad"]), "urls")
    overall = urls.agg(F.try_divide(F.sum("bad"), F.sum("known")).alias("p"), F.max(F.size("segs")).alias("longest")).first()
    prior = F.lit(min(0.5, overall["p"] or 0.0))
    smooth = lambda parent, bad="bad", known="known": (F.col(bad) + prior_weight * parent) / (F.col(known) + prior_weight)
    hosts = urls.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.sum("n").alias("rows"))
    root = materialize(hosts.select("host", smooth(prior).alias("purity"), F.lit("").alias("node"), "rows"), "level")
    levels, parents, at = [(root, root)], root.select("host", "node", "purity"), urls.withColumn("node", F.lit(""))
    for level in range(overall["longest"] or 0):
        here = at.where(F.size("segs") > level).withColumn("seg", F.element_at("segs", level + 1))
        kids = here.groupBy("host", "node", "seg").agg(
            F.count(F.lit(1)).alias("urls"), F.max(F.size("segs")).alias("deepest"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known")
        )
        kids = materialize(kids, "kids")
        pooled = kids.groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("children"), F.sum("n").alias("rows"), F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known")
        )
        nodes = materialize(pooled.join(parents.withColumnRenamed("purity", "up"), ["host", "node"]), "nodes")
        rate, p = F.try_divide("bad", "known"), F.try_divide("all_bad", "all_known")
        far = F.abs(rate - p) > z * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), "known") - F.try_divide(F.lit(1.0), "all_known")))
        variable = F.col("seg").rlike("[0-9]") | ((F.col("children") > max_children) & (F.col("n") < min_support))
        own = F.coalesce(~variable & (F.col("known") > 0) & far, F.lit(False))
        alike = F.struct("deepest", F.round(smooth(F.col("up")) / RATE_STEP).cast("int"))
        kids = join_groups(kids, nodes, ["host", "node"], "children", kids.count()).withColumn("alike", F.when(own, alike))
        merged = kids.groupBy("host", "node", "alike").agg(
            F.min("seg").alias("least"), F.count(F.lit(1)).alias("merged"), F.first("up").alias("up"), F.first("rows").alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known")
        )
        name = F.when(F.col("alike").isNull(), "/*").when(F.col("merged") > 1, F.concat(F.lit("//"), "least")).otherwise(F.concat(F.lit("/"), "least"))
        merged = merged.select("host", F.col("node").alias("parent"), "alike", F.concat("node", name).alias("node"), smooth(F.col("up")).alias("purity"), "rows", "n")
        merged = materialize(merged, "branches")
        named = kids.where("alike is not null").select("host", F.col("node").alias("parent"), "alike", "seg", F.col("n").alias("seg_rows"), "urls")
        named = named.join(merged.select("host", "parent", "alike", "node", "purity"), ["host", "parent", "alike"])
        named = materialize(named.select("host", "parent", "seg", "node", "purity", F.col("seg_rows").alias("rows"), "urls"), "level")
        rest = merged.where("alike is null").select("host", "parent", F.col("node").alias("rest_node"), F.col("purity").alias("rest_purity"), "rows")
        levels.append((named, rest))
        parents = merged.select("host", "node", "purity")
        step = named.select("host", F.col("parent").alias("node"), "seg", F.col("node").alias("into"), "urls")
        at = join_groups(here, step, ["host", "node", "seg"], "urls", here.count(), "left")
        at = materialize(at.select("host", "segs", "n", "bad", "known", F.coalesce("into", F.concat("node", F.lit("/*"))).alias("node")), "at")
    return levels


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    max_children: int = MAX_CHILDREN,
    min_support: int = MIN_SUPPORT,
    prior_weight: float = PRIOR_WEIGHT,
    reject_above: float = REJECT_ABOVE,
    z: float = Z,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row. The urls that a rule judges are the labelled ones."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_columns(rules)
    judged = materialize(judged.withColumns({"rule": rule, "ruled": says}), "judged")
    bad = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double"))
    levels = learn_templates(judged.select("host", "path", bad.alias("bad")), max_children, min_support, prior_weight, z)
    total = judged.count()
    shapes = judged.where("ruled is null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("copies"))
    shapes = materialize(shapes.withColumn("segs", _segments()), "shapes")
    shapes = join_groups(shapes, levels[0][0], ["host"], "rows", total, "left")
    done = lambda some: some.select("host", "path", F.col("node").alias("template"), "purity", "copies")
    ended = [done(shapes.where(F.size("segs") == 0))]
    for level, (named, rest) in enumerate(levels[1:]):
        shapes = shapes.where(F.size("segs") > level).select("host", "path", "copies", "segs", "node", "purity", F.element_at("segs", level + 1).alias("seg"))
        exact = named.select("host", F.col("parent").alias("node"), "seg", F.col("node").alias("own_node"), F.col("purity").alias("own_purity"), "rows")
        other = rest.withColumnRenamed("parent", "node")
        shapes = join_groups(join_groups(shapes, exact, ["host", "node", "seg"], "rows", total, "left").drop("rows"), other, ["host", "node"], "rows", total, "left")
        node = F.coalesce("own_node", "rest_node", F.concat("node", F.lit("/*")))
        shapes = materialize(shapes.select("host", "path", "copies", "segs", node.alias("node"), F.coalesce("own_purity", "rest_purity", "purity").alias("purity")), "shapes")
        ended.append(done(shapes.where(F.size("segs") == level + 1)))
    found = materialize(functools.reduce(DataFrame.unionByName, ended), "found")
    learned = F.when(F.col("purity") > reject_above, "block").otherwise("allow")
    open_rows = join_groups(judged.where("ruled is null"), found, ["host", "path"], "copies", total, "left").withColumn("verdict", learned)
    ruled = judged.where("ruled is not null").withColumns({"template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double"), "verdict": F.col("ruled")})
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    return open_rows.select(columns).unionByName(ruled.select(columns))
