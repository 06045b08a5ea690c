"""URL filtering by rules and, where none fits, by a path-template tree.

Per host, the segments of a path form a tree. Digits and long hexadecimal runs in a segment become
wildcards at once. Going down level by level to the last segment, branches are merged by what their
labels say: a labelled branch joins the wildcard branch /* if its block rate doesn't differ
significantly from its parent's, and unlabelled branches that have no label on any host either join
the branch /?, as nothing tells them apart. Other branches keep their names.

A template is rejected if its purity, its smoothed share of block labels, is over a half. It is
smoothed towards two estimates, which back off step by step where there are no labels:

* kin: the global share, then the hosts of the same site (last two parts of the name), then the
  branches beside it at each level of its host's tree. A branch or host counts as one observation of
  its rate, beside KIN of the step before.
* shape: the same path on all hosts. The global share, then the rate of the pages that share the path's
  first segment, first two segments and so on, beside PRIOR labels of the step before.

Labels are the rules' own verdicts, unless a label column is given. Pages are first counted by distinct
generalised path; the tree works on that small table only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import UPPER, join_sized, materialize

#: Verdict and rule; a rule is a host, then the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Segments that the registered SQL goes down; the operator goes down to the last.
DEPTH = 5
#: Standard errors within which a branch's block rate equals its parent's.
Z = 1.96
#: Labels that an estimate counts for in the next, and branches or hosts that it counts for.
PRIOR, KIN = 2.0, 4.0
#: Decimals of rates that are compared or passed on.
DIGITS = 9

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), UPPER, UPPER.lower()), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (verdict, rule); null if none fits."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _general(path: Column) -> Column:
    """The path's segments with wildcards, joined by /."""
    general = F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{12,}", "{h}"), "[0-9]+", "{n}")
    return F.array_join(F.filter(F.split(general, "/", -1), lambda x: x != ""), "/")


def _smoothed(total: Column, n: Column, before: Column, weight: float) -> Column:
    return F.round((total + F.lit(weight) * before) / (n + F.lit(weight)), DIGITS)


def templates(counted: DataFrame, z: float = Z, prior: float = PRIOR, kin: float = KIN) -> DataFrame:
    """counted (host, general, lab, blk) with template, purity and judged."""
    total = counted.agg(F.sum("lab"), F.sum("blk")).first()
    share = round(total[1] / total[0], DIGITS) if total[0] else 0.0
    names = counted.columns
    # hosts of a site
    site = F.array_join(F.slice(F.split("host", r"\.", -1), -2, 2), ".")
    site = F.when(F.size(F.split("host", r"\.", -1)) < 2, F.col("host")).otherwise(site)
    hosts = counted.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("blk").alias("h_blk"), F.count(F.lit(1)).alias("h_rows"))
    hosts = materialize(hosts.withColumn("site", site), "hosts")
    rate = F.when(F.col("h_lab") > 0, F.round(F.col("h_blk") / F.col("h_lab"), DIGITS))
    sites = materialize(hosts.groupBy("site").agg(F.sum(rate).alias("rates"), F.count(rate).alias("rated"), F.count(F.lit(1)).alias("hosts")), "sites")
    near = join_sized(hosts, sites, "site", "hosts").select("host", "h_rows", _smoothed(F.coalesce("rates", F.lit(0.0)), F.col("rated"), F.lit(share), kin).alias("kin"))
    parts = F.when(F.col("general") == "", F.array().cast("array<string>")).otherwise(F.split("general", "/", -1))
    t = join_sized(counted, materialize(near, "near"), "host", "h_rows").drop("h_rows")
    t = t.withColumns({"parts": parts, "template": F.lit(""), "shape": F.lit(share), "path": F.lit(""), "node": F.col("host")})
    ready, d = [], 0
    while True:
        # `path` and `node` name a page's place on all hosts and in its host's tree
        t = t.withColumn("s", F.coalesce(F.get("parts", F.lit(d)), F.lit("")))
        t = materialize(t.withColumns({"path": F.concat_ws("/", "path", "s"), "kid": F.concat_ws("/", "node", "s")}), "places")
        paths = t.groupBy("path").agg(F.sum("lab").alias("s_lab"), F.sum("blk").alias("s_blk"), F.count(F.lit(1)).alias("s_rows"))
        kids = t.groupBy("kid", "node").agg(F.sum("lab").alias("c_lab"), F.sum("blk").alias("c_blk"), F.count(F.lit(1)).alias("c_rows"))
        kids = materialize(kids, "kids")
        r = F.when(F.col("c_lab") > 0, F.round(F.col("c_blk") / F.col("c_lab"), DIGITS))
        nodes = kids.groupBy("node").agg(F.sum("c_lab").alias("p_lab"), F.sum("c_blk").alias("p_blk"), F.sum("c_rows").alias("p_rows"), F.sum(r).alias("rates"), F.count(r).alias("rated"))
        t = join_sized(t, materialize(paths, "paths"), "path", "s_rows").drop("s_rows")
        t = join_sized(t, kids.drop("node"), "kid", "c_rows").drop("c_rows")
        t = join_sized(t, materialize(nodes, "nodes"), "node", "p_rows")
        p, q = F.col("c_blk") / F.nullif("c_lab", F.lit(0)), F.col("p_blk") / F.nullif("p_lab", F.lit(0))
        alike = F.coalesce(F.round(F.abs(p - q), DIGITS) <= F.round(F.lit(z) * F.sqrt(q * (1 - q) / F.col("c_lab")), DIGITS), F.lit(False))
        step = F.when(F.col("s") == "", F.lit("")).when(alike, F.lit("/*"))
        # no segment has a ?
        step = step.when((F.col("c_lab") == 0) & (F.col("s_lab") == 0), F.lit("/?")).otherwise(F.concat(F.lit("/"), "s"))
        # a path alone in its branch has no more to be compared with
        alone, last = F.col("p_rows") == 1, F.size("parts") <= d
        rest = F.slice("parts", d + 1, F.greatest(F.size("parts") - d, F.lit(0)))
        rest = F.array_join(F.transform(rest, lambda x: F.concat(F.lit("/"), x)), "")
        t = t.withColumns({
            "template": F.concat("template", F.when(alone, rest).otherwise(step)),
            "shape": F.when(last, F.col("shape")).otherwise(_smoothed(F.col("s_blk"), F.col("s_lab"), F.col("shape"), prior)),
            "kin": F.when(last, F.col("kin")).otherwise(_smoothed(F.coalesce("rates", F.lit(0.0)), F.col("rated"), F.col("kin"), kin)),
            "over": alone | last,
        })
        t = materialize(t.select(*names, "parts", "template", "shape", "kin", "path", F.concat("host", "template").alias("node"), "over"), "level")
        ready.append(t.where("over").select(*names, "template", "shape", "kin"))
        t, d = t.where(~F.col("over")).drop("over"), d + 1
        if t.isEmpty():
            break
    t = materialize(reduce(DataFrame.unionByName, ready).withColumn("place", F.concat("host", "template")), "templates")
    pure = t.groupBy("place").agg(F.sum("lab").alias("t_lab"), F.sum("blk").alias("t_blk"), F.avg("shape").alias("t_shape"), F.max("kin").alias("t_kin"), F.count(F.lit(1)).alias("t_rows"))
    pure = pure.select("place", "t_rows", _smoothed(F.col("t_blk"), F.col("t_lab"), (F.col("t_shape") + F.col("t_kin")) / 2, prior).alias("purity"))
    judged = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    return join_sized(t, materialize(pure, "purities"), "place", "t_rows").select(*names, "template", "purity", judged.alias("judged"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template (of the tree).

    label_col, if given, is a boolean: true is a block label, null no label. A null url, or one
    without ://, has empty host and path and no rule. Null ids stay null, repeated rows are each
    returned and counted, other columns aren't read, an empty table gives no rows. A path with many
    pages is joined to its verdict by a broadcast, the others by a shuffle.
    """
    host, path = split_url(F.col(url_col))
    label = F.col(label_col).cast("boolean") if label_col else F.lit(None).cast("boolean")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("label"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("label", F.coalesce("label", F.col("found.verdict") == "block") if label_col else F.col("found.verdict") == "block")
    keys = ["host", "general"]
    rows = rows.withColumn("general", _general(F.col("path")))
    counted = rows.groupBy(*keys).agg(F.count("label").alias("lab"), F.count_if(F.col("label")).alias("blk"), F.count(F.lit(1)).alias("pages"))
    judged = materialize(templates(materialize(counted, "paths"), **how).select(*keys, "pages", "template", "judged"), "verdicts")
    # no host has a /
    place = F.concat_ws("/", *keys)
    judged = judged.select(place.alias("place"), "pages", "template", "judged")
    out = join_sized(rows.withColumn("place", place), judged, "place", "pages")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "judged").alias("verdict"), "template")
