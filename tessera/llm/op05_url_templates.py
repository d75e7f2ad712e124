"""URL filters from a path-template tree.

Each URL is cut into host and path; the first fitting rule by length gives its verdict.  URLs that a rule
judged are also labels for the rest.  Per host a tree of path segments is built from counts, level by
level: a segment that looks like a number, date, hash or long token becomes a wildcard at once; below a
parent with many children the rare ones become a wildcard too; children whose labels do not differ from
their siblings' by a two-proportion test are merged to one branch.  The leaves are templates.

A template's purity is its labelled share of blocks, smoothed: by that of the same path shape on all hosts of the domain above, and this by
that of the next domain up to that of all hosts, and this by a fixed prior.  So a template with labels is judged by them, and one without by what the shape
is elsewhere, the nearest hosts first; a shape without labels anywhere keeps the prior, and is allowed.  A template
is rejected where its purity reaches a threshold; a URL
that no rule fits is blocked if its template is rejected.

The tree is made from counts per distinct (host, generalised path), never from rows, so a host that holds
a third of all pages weighs no more than its distinct paths.

Defined cases: null URLs and those without ``://`` have an empty host and path, no rule, and are allowed; an
empty table gives no rows; repeated rows give repeated rows, and count as often; a null id stays null; a path of more than DEPTH segments, however
long, has its rest as one wildcard; shares that tie with the threshold reject; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

#: Fixed by the contract: verdict and rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree; what is deeper is one wildcard.  Labels of the widest to the narrowest domain that evidence is shared in.
DEPTH, LEVELS = 4, 2
#: A parent with more children than this has its rare ones (below the share) made a wildcard.
MANY, RARE = 16, 0.05
#: Below this the labels of two branches do not differ (two-sided 5 %).
Z = 1.96
#: Prior: so many labels, of which, for all hosts, so many blocks; and the purity that rejects a template.
PRIOR_LABELS, PRIOR_BLOCKS, REJECT = 4.0, 0.8, 0.8
_VARIABLE = r"^(?:[0-9][0-9._-]*(?:\.[a-z]{2,5})?|[0-9a-f]{8,}|[0-9a-f-]{32,}|[^/]{40,}|(?=[^/]*[0-9])[a-z0-9_-]{12,}(?:\.[a-z]{2,5})?)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as a (verdict, rule) struct; null where none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """The path's segments, at most DEPTH of them, with variable ones as ``*``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH)
    return F.transform(parts, lambda p: F.when(F.translate(p, UPPER, LOWER).rlike(_VARIABLE) | p.contains("/"), F.lit("*")).otherwise(p))


def template_tree(scratch: Scratch, urls: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, label): label is 1 for a block, 0 for an allow, else null."""
    leaves = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocks"))
    leaves = scratch.table(leaves.withColumn("template", F.array().cast("array<string>")), "leaves")
    for depth in range(DEPTH):
        here = leaves.withColumn("seg", F.get("shape", F.lit(depth)))
        child = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocks")])
        child = scratch.table(child, f"child{depth}")
        parent = child.groupBy("host", "template").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocks")])
        # Two proportions: this branch against its siblings, pooled.
        others, other_blocks = F.col("all_labelled") - F.col("labelled"), F.col("all_blocks") - F.col("blocks")
        pooled = F.col("all_blocks") / F.col("all_labelled")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others))
        differs = (F.col("labelled") > 0) & (others > 0) & (F.abs(F.try_divide(F.col("blocks"), F.col("labelled")) - F.try_divide(other_blocks, others)) > Z * spread)
        plain = (F.col("labelled") > 0) & (others > 0)
        name = (
            F.when(F.col("seg") == "*", F.lit("*"))
            .when((F.col("kinds") > MANY) & (F.col("n") < RARE * F.col("all_n")), F.lit("*"))
            .when(plain, F.when(differs, F.col("seg")).otherwise(F.lit("+")))
            .otherwise(F.col("seg"))
        )
        named = child.join(parent, ["host", "template"]).select("host", "template", "seg", name.alias("name"))
        keys = [here[c].eqNullSafe(named[c]) if c == "seg" else here[c] == named[c] for c in ("host", "template", "seg")]
        grown = here.join(named, keys, "left").select(here["host"], here["shape"], "n", "labelled", "blocks", F.when(F.col("name").isNull(), here["template"]).otherwise(F.concat(here["template"], F.array("name"))).alias("template"))
        leaves = scratch.table(grown, f"leaves{depth}")
    by_template = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocks").alias("blocks"))
    above = shape_purity(scratch, leaves.select("host", "shape", "labelled", "blocks"))
    tree = leaves.select("host", "shape", "template").join(by_template, ["host", "template"]).join(above, ["host", "shape"])
    purity = smoothed(F.col("labelled"), F.col("blocks"), F.col("above"))
    return tree.select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), purity.alias("purity"))


def smoothed(labelled: Column, blocks: Column, above: Column) -> Column:
    return (blocks + PRIOR_LABELS * above) / (labelled + PRIOR_LABELS)


def shape_purity(scratch: Scratch, counts: DataFrame) -> DataFrame:
    """(host, shape, above): the purity of a shape on all hosts of the host's domain, by way of the domains above that.

    Domains are suffixes of the host of up to LEVELS labels; '' is that of all hosts.  ``counts`` has one row per host and shape.
    """
    labels = F.split("host", r"\.")
    known = F.least(F.size(labels), F.lit(LEVELS))
    domains = F.transform(F.sequence(F.lit(0), known), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    each = scratch.table(counts.withColumn("domains", domains), "domains")
    by = each.withColumn("domain", F.explode(F.array_distinct("domains"))).groupBy("domain", "shape").agg(F.sum("labelled").alias("labelled"), F.sum("blocks").alias("blocks"))
    by = scratch.table(by, "by_domain")
    out = each.select("host", "shape", "domains").withColumn("above", F.lit(PRIOR_BLOCKS / PRIOR_LABELS))
    for k in range(LEVELS + 1):
        level = by.withColumnRenamed("domain", "of")
        here = out.withColumn("of", F.get("domains", F.lit(k))).join(level, ["of", "shape"], "left")
        out = here.select("host", "shape", "domains", F.coalesce(smoothed(F.col("labelled"), F.col("blocks"), F.col("above")), "above").alias("above"))
    return out.select("host", "shape", "above")


def judge(scratch: Scratch, pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """Per (page_id, url): host, path, rule, template, purity and verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.withColumn("shape", shapes(F.col("path"))).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    cut = scratch.table(cut, "cut", keep=True)
    label = F.when(F.col("by_rule.verdict") == "block", 1).when(F.col("by_rule.verdict") == "allow", 0)
    tree = template_tree(scratch, cut.where("host <> ''").select("host", "shape", label.alias("label")))
    tree = scratch.table(tree, "tree", keep=True)
    out = cut.join(tree, ["host", "shape"], "left")
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its host, path, fitting rule and verdict, and the template's purity."""
    with Scratch(spark) as s:
        return judge(s, table(spark, sf_dir, "pages").select("page_id", "url"))
