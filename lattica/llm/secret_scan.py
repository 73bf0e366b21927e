"""Incremental secret scan over content-addressed blobs, with DataFrame functions only.

A blob is a text, addressed by its SHA-256; many paths and versions may have the same blob. The ledger has the (blob,
rule version) pairs that were scanned before and their findings. A scan looks only at pairs that the ledger hasn't,
each blob once, and joins the findings back to all paths.

Spans come from two functions that match alike: split gives what stands between the matches and regexp_extract_all the
matches, so the running sum of their lengths gives each match's place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm._common import join_hot, stage, unstage

#: Tasks that the copies of one blob are dealt to where a ledger is carried on.
SALTS = 8


@dataclass(frozen=True)
class Rule:
    """kind and version address a rule; if group is given, matches whose group is shorter than least are dropped. Kinds
    with equal starts are told in the rules' order."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values. For access and hex, runs that are too short are left to the pattern: as a run is matched whole, the same
#: matches come out as when it is matched and then dropped.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds of secrets.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("issued", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"),
)


def matches_of(text: Column, rule: Rule) -> Column:
    """Array of a rule's (between, length, keep): code points between the match before and this one, and of the match.
    The last is the text's end and has nulls for a match."""
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    return F.arrays_zip(between.alias("between"), lengths.alias("length"), kept.alias("keep"))


@dataclass
class Ledger:
    """scanned (blob, kind, version) and findings (blob, kind, version, spans), staged; both may be None at first."""

    scanned: DataFrame | None = None
    findings: DataFrame | None = None


def _unseen(blobs: DataFrame, rules: tuple[Rule, ...], ledger: Ledger) -> DataFrame:
    """(blob, orders) of blobs with pairs that the ledger hasn't, and the numbers of those rules."""
    told = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("order")) for i, r in enumerate(rules)))
    pairs = blobs.select("blob", F.explode(told).alias("rule")).select("blob", "rule.*")
    if ledger.scanned is not None:
        pairs = pairs.join(ledger.scanned, ["blob", "kind", "version"], "left_anti")
    return pairs.groupBy("blob").agg(F.collect_set("order").alias("orders"))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *MORE), ledger: Ledger | None = None, path_col: str = "doc_id",
    text_col: str = "text",
) -> Ledger:
    """The ledger with docs' unseen pairs scanned; docs (path, text) has every historical version as a row.

    A null text is the empty blob. Rows that repeat a path are versions of it; of rows with equal texts, whatever their
    paths, one is scanned. An empty table adds nothing. A text's matches are rows of their own while they are counted, so
    a very long text with many takes time in proportion. Copies of one text meet map-side, and where the ledger has some
    blobs already, only texts of others are shuffled for the scan. Other columns of docs are not read.
    """
    ledger = ledger or Ledger()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"), F.xxhash64(F.col(path_col)).alias("salt"))
    whole = F.array(*(F.lit(i) for i in range(len(rules))))
    if ledger.scanned is None:
        todo = rows.groupBy("blob").agg(F.max("text").alias("text")).withColumn("orders", whole)
    else:
        unseen = stage(_unseen(rows.select("blob").distinct(), rules, ledger), "unseen")
        # Copies of one blob are dealt to SALTS tasks until they are one.
        salted = unseen.select("blob", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        new = rows.withColumn("salt", F.pmod("salt", F.lit(SALTS)).cast("int")).join(salted, ["blob", "salt"], "left_semi")
        todo = new.groupBy("blob").agg(F.max("text").alias("text")).join(unseen, "blob")
    each = []
    for i, r in enumerate(rules):
        matches = F.when(F.array_contains("orders", i) & F.col("text").rlike(r.pattern), matches_of(F.col("text"), r))
        each.append(F.struct(F.lit(i).alias("order"), matches.alias("matches")))
    todo = stage(todo.select("blob", "orders", F.filter(F.array(*each), lambda x: x["matches"].isNotNull()).alias("found")), "scans")
    found = todo.select("blob", F.explode("found").alias("f")).select("blob", "f.order", F.posexplode("f.matches").alias("at", "match"))
    found = found.select("blob", "order", "at", "match.*")
    before = Window.partitionBy("blob", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("between") + F.col("length")).over(before)
    spans = found.withColumn("end", end).where("keep").groupBy("blob", "order")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("length")).alias("start"), "end"))).alias("spans"))
    name, version = (F.get(F.lit([getattr(r, c) for r in rules]), F.col("order")).alias(c) for c in ("kind", "version"))
    findings = spans.select("blob", name, version, "spans")
    scanned = todo.select("blob", F.explode("orders").alias("order")).select("blob", name, version)
    if ledger.scanned is not None:
        scanned, findings = scanned.unionByName(ledger.scanned), findings.unionByName(ledger.findings)
    out = Ledger(stage(scanned, "scanned"), stage(findings, "findings"))
    unstage(todo, *([unseen] if ledger.scanned is not None else []))
    return out


def findings_by_path(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = (*BASE, *MORE), path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, spans) for each row of docs: spans (start, order, end, kind) by start, then the rules' order, then end.

    A null text is the empty blob, and has no spans, like a text that the ledger doesn't know. Rows that repeat a path are
    told each.
    """
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)))
    own = ledger.findings.withColumn("order", order[F.concat_ws(":", "kind", "version")]).where("order is not null")
    each = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.col("order"), x["end"].alias("end"), F.col("kind")))
    by_blob = own.select("blob", each.alias("s")).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stage(docs.select(F.col(path_col).alias(path_col), F.sha2(text, 256).alias("blob")), "paths")
    none = F.array().cast(by_blob.schema["spans"].dataType)
    copies = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    table = by_blob.join(copies, "blob")
    told = join_hot(rows, table, ["blob"], "copies", rows.count(), F.col(path_col), "left")
    return told.select(path_col, "blob", F.coalesce("spans", none).alias("spans"))
