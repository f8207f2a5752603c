"""Secret scans with an incremental ledger of contents, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, per content and version of a
rule, the spans found there, also where there are none. A scan takes the contents that lack an entry for some rule, runs
only those rules, and joins the findings of the whole ledger back to all paths. Copies are merged within tasks before
their text is moved, so a text that fills a third of the corpus is scanned once.

Positions follow from the lengths of the pieces between matches. Null text is empty; repeated rows are each returned.
The ledger keeps with each span the version of its rule, and findings are those of the versions asked for, so that a new
version of a rule takes the place of the older one. Findings add ``blob`` and ``spans`` to the path columns; a path
column that has one of these names gets underscores at its end until it is free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern that cannot match an empty text. With ``group``, that group needs ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


#: The base rules. Runs of one class are greedy, so a least length in the pattern finds the same runs.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

LEDGER = "blob binary, rules array<string>, spans array<struct<start: int, rule: string, end: int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob``, ``text`` and ``rules``: the distinct contents with the rule versions that the ledger lacks."""
    wanted = F.array(*(F.lit(rule.key) for rule in rules))
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.select("blob", "text", wanted.alias("rules"))
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "text", left.alias("rules")).filter(F.size("rules") > 0)


def scanned(pending: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger entries of pending contents: one row per content, with the rules run and what they found."""
    def matches(rule: Rule) -> Column:
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
        asked = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern)
        between = F.split("text", rule.pattern, -1)
        found = F.arrays_zip(F.transform(between, F.length).alias("before"), F.transform(hits, F.length).alias("hit"),
                             F.transform(group, lambda x: F.length(x) >= rule.least).alias("right"))
        return F.when(asked, F.struct(F.lit(rule.key).alias("rule"), F.lit(rules.index(rule)).alias("at"), found.alias("found")))

    kinds = pending.select("blob", "rules", F.array_compact(F.array(*map(matches, rules))).alias("kinds"))
    each = kinds.select("blob", "rules", F.explode_outer("kinds").alias("kind"))
    each = each.select("blob", "rules", "kind.rule", "kind.at", F.posexplode_outer("kind.found").alias("pos", "m"))
    so_far = F.sum(F.col("m.before") + F.coalesce("m.hit", F.lit(0))).over(
        Window.partitionBy("blob", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.select("blob", "rules", "rule", "at", "m.right", F.col("m.hit").alias("hit"), so_far.cast("int").alias("end"))
    span = F.when(F.col("right") & F.col("hit").isNotNull(), F.struct(
        (F.col("end") - F.col("hit")).alias("start"), "at", "rule", "end"))
    spans = F.transform(F.array_sort(F.collect_list(span)), lambda x: F.struct(x.start.alias("start"), x.rule.alias("rule"), x.end.alias("end")))
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), spans.alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` but their text, with the ``spans`` that the given rules have for their content."""
    known = F.array(*(F.lit(rule.key) for rule in rules))
    per_blob = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    held = F.transform(F.filter("spans", lambda x: F.array_contains(known, x.rule)), lambda x: F.struct(
        x.start.alias("start"), F.regexp_replace(x.rule, ":[0-9]+$", "").alias("rule"), x.end.alias("end")))
    none = F.array().cast("array<struct<start: int, rule: string, end: int>>")
    paths = [name for name in versions.columns if name != "text"]
    shown, taken = {}, {"blob", "spans", *(name.lower() for name in paths)}
    for name in paths:
        shown[name] = name
        if name.lower() in ("blob", "spans"):
            while shown[name].lower() in taken:
                shown[name] += "_"
            taken.add(shown[name].lower())
    addressed = versions.select(*(F.col(f"`{name}`").alias(f"path {k}") for k, name in enumerate(paths)), blob_of(F.col("text")).alias("blob"))
    joined = addressed.join(per_blob, "blob", "left")
    return joined.select(*(F.col(f"path {k}").alias(shown[name]) for k, name in enumerate(paths)), "blob", F.coalesce(held, none).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans what is new in ``versions`` (a text column ``text`` and any path columns): findings and new entries.

    Append the entries to the stored ledger before the next scan.
    """
    plain = versions.withColumn("text", F.coalesce("text", F.lit("")))
    fresh = scanned(unseen(plain, ledger, rules), rules)
    return findings(plain, fresh if ledger is None else ledger.unionByName(fresh), rules), fresh


def number_of(rule: Rule) -> Column:
    return F.size(F.filter("spans", lambda x: x.rule == rule.name))


def rendered(spans: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """``rule:start:end`` of the spans, of some rules or all, by start and then in the order of ``RULES``."""
    order = F.array(*(F.lit(rule.name) for rule in RULES))
    if rules is not None:
        names = F.array(*(F.lit(rule.name) for rule in rules))
        spans = F.filter(spans, lambda x: F.array_contains(names, x.rule))
    sorted_ = F.array_sort(F.transform(spans, lambda x: F.struct(
        x.start.alias("start"), F.array_position(order, x.rule).alias("at"), x.rule.alias("rule"), x.end.alias("end"))))
    return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x.rule, x.start.cast("string"), x.end.cast("string"))), ",")
