"""Secret scans with an incremental blob ledger.

Every historical version of every path is content-addressed by the SHA-256 of its text.  A ledger
holds the (blob, rule, rule version) triples that were scanned before, and their findings; a scan reads the text of each
unseen blob once, whatever the number of paths that hold it, and runs only the rules that the ledger
lacks for it.  Findings are rows per blob and are joined back to all paths.

A finding bears the rule version that made it, and only those of the rule versions that are asked for are answers; so a rule that was narrowed,
widened or taken away leaves nothing of what it once found.

A ``Ledger`` is a folder of runs.  A run writes what it found and what it scanned, and counts once its name stands in the
commits; a run that was cut short is never read, and its blobs are scanned again.  The query and the stage take a ledger's folder; without one they
keep their own for the call, so that a result never rests on an unnamed earlier run.

Only DataFrame expressions are used.  Positions come from two built-ins: ``split`` by a rule's pattern
gives the text between matches and ``regexp_extract_all`` the matches, so that a running sum of their
lengths is each match's start.

Defined cases: a null id stays null; a null text is the empty text; an empty table gives no rows; repeated rows (of one id and text) give repeated
rows, which are scanned each and found once; a path with many versions has a row for each; very long texts are scanned whole; spans of two kinds may overlap, and all are kept, ordered by
start and then as the kinds are listed; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, given, held, table, unused


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and without overlap; a match counts if ``group`` has ``at_least`` characters.

    ``hint``: a cheaper pattern that every text with a counting match has; only such texts are cut by ``pattern``.
    """

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    version: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, hint=r"""[dDtTnNyY]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def content_address(paths: DataFrame, key: str, text: str) -> DataFrame:
    """(path, blob): the digest of each path's text."""
    return paths.select(held(key).alias("path"), F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias("blob"))


def _cuts(text: Column, rule: Rule) -> Column:
    """For each match of a rule: its number, the length of the text before it since the last match, its length, whether it counts."""
    groups = [0] if rule.group == 0 else [0, rule.group]
    found = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in groups]
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found[0].alias("all"), found[-1].alias("part"))
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.key).alias("rule"),
            i.alias("nth"),
            F.length(z["gap"]).alias("gap"),
            F.length(z["all"]).alias("len"),
            (F.length(z["part"]) >= rule.at_least).alias("counts"),
        ),
    )
    return F.filter(rows, lambda r: r["len"].isNotNull())


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, rule, start, end) for ``blobs`` (blob, text, todo: keys of the rules to run on it)."""
    empty = F.array().cast("array<struct<kind:string,rule:string,nth:int,gap:int,len:int,counts:boolean>>")
    per_rule = [F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.hint or r.pattern), _cuts(F.col("text"), r)).otherwise(empty) for r in rules]
    # A blob may come more than once: sums run within a row.
    cut = blobs.withColumn("row", F.monotonically_increasing_id()).select("blob", "row", F.explode(F.concat(*per_rule)).alias("c")).select("blob", "row", "c.*")
    so_far = Window.partitionBy("blob", "row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(so_far)
    return cut.withColumn("end", end).where("counts").select("blob", "kind", "rule", (F.col("end") - F.col("len")).alias("start"), "end").distinct()


class Ledger:
    """Findings (blob, kind, rule, start, end) and scanned pairs (blob, rule) in a shared folder, by committed runs."""

    FOUND, SCANNED, COMMITS = "blob string, kind string, rule string, start long, end long, run string", "blob string, rule string, run string", "run string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{run}" for run in runs])

    def runs(self) -> list[str]:
        """Names of the committed runs, one each: a bounded list, whatever the corpus's size."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(r["run"] for r in self.spark.read.schema(self.COMMITS).parquet(f"{self.folder}/commits").collect())

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, kind, start, end) that these versions of rules have found, in any run."""
        return self._read("found", self.FOUND).where(F.col("rule").isin([r.key for r in rules])).select("blob", "kind", "start", "end").distinct()

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED).drop("run")

    def add(self, found: DataFrame, scanned: DataFrame) -> str:
        """Writes one run and commits it."""
        run = uuid.uuid4().hex
        found.withColumn("run", F.lit(run)).write.option("compression", "zstd").parquet(f"{self.folder}/found/{run}")
        scanned.withColumn("run", F.lit(run)).write.option("compression", "zstd").parquet(f"{self.folder}/scanned/{run}")
        self.spark.createDataFrame([(run,)], self.COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return run


def scan_history(spark: SparkSession, paths: DataFrame, key: str, text: str, ledger: Ledger, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger lacks, and adds it there.

    ``paths`` has one row per version of a path.  Returns the addresses (path, blob) and, from the ledger, all findings
    (blob, kind, start, end) of ``rules``.
    """
    scratch = scratch or Scratch(spark)
    address = scratch.table(content_address(paths, key, text), "address", keep=True)
    # One path stands for each blob: the texts are shuffled once, by path and blob, and only unseen ones are scanned.
    todo = address.groupBy("blob").agg(F.min("path").alias("path")).withColumn("todo", F.array(*[F.lit(r.key) for r in rules]))
    if ledger.runs():
        seen = ledger.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
    todo = scratch.table(todo.select("path", "blob", "todo"), "todo")
    texts = paths.select(held(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    # Equal rows of one path and blob are scanned alike, and counted once.
    unseen = texts.join(todo, ["path", "blob"])
    ledger.add(scan(unseen.select("blob", "text", "todo"), rules), todo.select("blob", F.explode("todo").alias("rule")))
    return address, ledger.findings(rules)


def query(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        address, found = scan_history(spark, docs, "doc_id", "text", Ledger(spark, ledger or s.path("ledger")), scratch=s)
        rank = F.array_position(F.array(*[F.lit(r.kind) for r in RULES]), F.col("kind"))
        by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("all"))
        by_blob = s.table(by_blob, "spans", keep=True)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == kind))

    spans = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"))
    out = address.join(by_blob, "blob", "left").withColumn("all", spans)
    counts = [of_kind(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = joined(F.filter("all", lambda x: x["rank"] <= len(BASE)))
    return out.select(given("path").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Pipeline stage: every span of a finding is replaced by ``[kind]``; all documents stay.

    Spans that overlap are joined to one, which bears the name of the first.  A null text stays null; columns of any other names are kept.
    """
    key, of, all_, own = unused(docs, "hit_id", "hit_blob", "hit_spans", "own_blob")
    with Scratch(spark) as s:
        address, found = scan_history(spark, docs, "doc_id", "text", Ledger(spark, ledger or s.path("ledger")), scratch=s)
        order = Window.partitionBy("blob").orderBy("start", "end", "kind")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        merged = found.withColumn("reach", reach).withColumn("island", island).groupBy("blob", "island")
        merged = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
        spans = merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(all_))
        hit = s.table(address.join(spans, "blob").select(F.col("path").alias(key), F.col("blob").alias(of), all_).distinct(), "hit", keep=True)
    text = F.col("text")

    def piece(x: Column, i: Column) -> Column:
        at = F.coalesce(F.get(all_, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")), F.lit("["), x["kind"], F.lit("]"))

    rest = F.substring(text, (F.element_at(all_, -1)["end"] + 1).cast("int"), F.lit(2147483647))
    cleaned = F.concat(F.array_join(F.transform(all_, piece), ""), rest)
    keyed = docs.withColumn(own, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    out = keyed.join(hit, (held("doc_id") == F.col(key)) & (F.col(own) == F.col(of)), "left")
    return out.withColumn("text", F.when(F.col(all_).isNotNull(), cleaned).otherwise(text)).select(docs.columns)
