"""Prompt tables: what the model is asked, per table and per batch of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip, tokens
from ..schemas import TABLE_TARGET
from .profile import VERBOSE_FIELDS, VOLATILE_FIELDS
from .skew import number_by_ordinal

# Batch size, budgets and the default comment template.
COLUMNS_PER_PROMPT = 25
FALLBACK_LENGTH = 500
SUMMARY_RULES = (
    "Condense the context notes that follow. Keep every name of a table or column, key, join condition, unit and code "
    "meaning; drop repetition. Answer with the condensed notes only."
)
TABLE_REQUIRED = ("purpose", "business_definition", "grain", "primary_keys", "join_keys")
TABLE_RECOMMENDED = (
    "technical_owner", "data_owner", "freshness_sla", "source_systems", "downstream_consumers",
    "known_business_rules", "known_quality_issues", "common_join_patterns", "related_tables",
    "sensitivity", "example_questions", "use_cases", "caveats",
)
COLUMN_REQUIRED = ("definition",)
# field -> (condition, rule)
COLUMN_CONDITIONAL = {
    "units": ("numeric_measure", "the unit of every number that measures something"),
    "allowed_values": ("enum", "for a short list of codes, what each code stands for"),
    "null_meaning": ("nullable", "where values can be missing, what a missing one says"),
    "fk_reference": ("fk", "for a reference, the full name of the column it points to"),
    "derivation": ("computed", "for a calculated value, how it comes about"),
    "sensitivity": ("pii", "for personal data, which kind it is"),
}
CONDITIONS = ("numeric_measure", "enum", "nullable", "fk", "computed", "pii", "always")
WEIGHT_TOLERANCE = 1e-6

GROUNDING = (
    "Use the evidence below and nothing else. Leave out, or call unknown, whatever it does not show. "
    "Name the evidence you used in evidence_refs. Where an approved library comment fits the data, "
    "keep its wording. Answer with one JSON object only."
)
TABLE_RULES = (
    "Write the comment of a table for its data stewards, in plain sentences of at most 900 words. "
    f"Cover: {', '.join(TABLE_REQUIRED)}. If known also: {', '.join(TABLE_RECOMMENDED)}. {GROUNDING} "
    'Shape: {"proposed_comment", "rationale", "tags": [], "facts": {"owner", "freshness", "grain", '
    '"keys", "sensitivity"}, "evidence_refs": [], "self_confidence"}'
)
COLUMN_RULES = (
    "Write a comment of at most 150 words for each column listed: its business meaning, not its name "
    f"again. Where they apply also: {'; '.join(rule for _, rule in COLUMN_CONDITIONAL.values())}. {GROUNDING} "
    'Shape: {"columns": [{"name", "proposed_comment", "rationale", "tags": [], "conditional_fields": {}, '
    '"evidence_refs": [], "self_confidence"}]}'
)

CONTEXT_LIST = "array<struct<source:string,text:string>>"


def column_batches(columns: DataFrame, size: int = COLUMNS_PER_PROMPT) -> DataFrame:
    """Columns with the number of their batch within the table, in ordinal order."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    numbered = number_by_ordinal(columns, ["table_ref"], "ordinal", [F.col("name")], "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def context_lists(snippets: DataFrame) -> DataFrame:
    """Ranked snippets as one list per table; the token budget bounds its length."""
    items = F.array_sort(F.collect_list(F.struct(
        (-F.col("relevance")).alias("key"), "provider_seq", "seq", "text", "source", "informs", "relevance")))
    return snippets.groupBy("table_ref").agg(items.alias("items")).select(
        "table_ref",
        F.transform("items", lambda s: F.struct(
            s["text"].alias("text"), s["source"].alias("source"), s["informs"].alias("informs"),
            s["relevance"].alias("relevance"))).alias("context"))


def schema_meta(keys: DataFrame, foreign: DataFrame) -> DataFrame:
    """Declared primary and foreign keys of each table as JSON."""
    primary = keys.filter(F.col("constraint_type") == "PRIMARY KEY").groupBy("table_ref").agg(
        F.array_sort(F.collect_list(F.struct("pos", "column"))).alias("pk"))
    declared = foreign.groupBy("table_ref", "constraint_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "column", "ref_table", "ref_column"))).alias("parts"))
    references = declared.groupBy("table_ref").agg(
        F.array_sort(F.collect_list(F.struct("constraint_name", "parts"))).alias("fk"))
    return primary.join(references, "table_ref", "full_outer").select(
        "table_ref",
        F.to_json(F.struct(
            F.transform("pk", lambda c: c["column"]).alias("primary_key"),
            F.transform("fk", lambda k: F.struct(
                F.transform(k["parts"], lambda p: p["column"]).alias("columns"),
                k["parts"][0]["ref_table"].alias("referenced_table"),
                F.transform(k["parts"], lambda p: p["ref_column"]).alias("referenced_columns"),
            )).alias("foreign_keys"))).alias("schema_meta"))


def _lines(context: Column) -> Column:
    return F.array_join(F.transform(context, lambda c: F.concat(
        F.lit("- ("), F.coalesce(c["source"], F.lit("context")), F.lit(") "), F.coalesce(c["text"], F.lit("")))), "\n")


def _short_context(context: Column) -> Column:
    listed = F.coalesce(context, F.array().cast("array<struct<text:string,source:string,informs:array<string>,relevance:double>>"))
    return F.transform(listed, lambda c: F.struct(c["source"].alias("source"), c["text"].alias("text")))


def table_prompts(tables: DataFrame, contexts: DataFrame) -> DataFrame:
    """One prompt per table."""
    profile = F.to_json(F.struct(F.struct(*[c for c in tables.columns if c not in VOLATILE_FIELDS]).alias("table")))
    return tables.select("table_ref", "existing_comment", profile.alias("profile")).join(
        contexts, "table_ref", "left").select(
        F.concat_ws("|", "table_ref", F.lit(TABLE_TARGET)).alias("prompt_id"), "table_ref",
        F.lit(None).cast("int").alias("batch"), "existing_comment", F.lit(TABLE_RULES).alias("system"),
        _short_context(F.col("context")).alias("context"),
        "profile", F.col("profile").alias("brief_profile"), F.lit("Draft the table comment.").alias("instruction"))


def _in_place(listed: Column, columns: DataFrame) -> Column:
    """The listed columns by ordinal and name; fields that cannot be compared, as maps, take no part."""
    if not any("map<" in kind or "variant" in kind for _, kind in columns.dtypes):
        return F.sort_array(listed)
    at = lambda c: F.struct(c["ordinal"], c["name"])
    return F.array_sort(listed, lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0))


def column_prompts(columns: DataFrame, contexts: DataFrame, meta: DataFrame, table_comments: DataFrame,
                   size: int = COLUMNS_PER_PROMPT) -> DataFrame:
    """One prompt per batch of columns, grounded in the table comment where there is one.

    ``table_comments`` has ``table_ref, comment``. A batch lists at most ``size`` columns.
    """
    shown = [c for c in columns.columns if c != "table_ref"]
    brief = [c for c in shown if c not in VERBOSE_FIELDS]
    # Each column travels once; the texts are made of it when the batch is together.
    place = ["ordinal", "name", "data_type", "existing_comment"]
    listed = F.collect_list(F.struct(*place, *[c for c in shown if c not in place]))
    batches = column_batches(columns, size).groupBy("table_ref", "batch").agg(_in_place(listed, columns).alias("cols"))
    asked = F.transform("cols", lambda c: F.struct(
        c["name"].alias("name"), c["ordinal"].alias("ordinal"), c["data_type"].alias("data_type"),
        c["existing_comment"].alias("current_comment")))

    def profile(fields: list[str]) -> Column:
        bodies = F.array_join(F.transform("cols", lambda c: F.to_json(F.struct(*[c[f].alias(f) for f in fields]))), ",")
        return F.concat(F.lit('{"columns":['), bodies, F.lit('],"schema_meta":'),
                        F.coalesce("schema_meta", F.lit("{}")), F.lit("}"))

    names = F.array_join(F.transform("cols", lambda c: c["name"]), ", ")
    ask = F.concat(F.lit("Draft comments for columns: "), names, F.lit("."))
    comments = table_comments.filter(~is_blank(F.col("comment"))).select("table_ref", strip(F.col("comment")).alias("_comment"))
    grounded = F.when(F.col("_comment").isNotNull(), F.concat(
        F.lit("The table comment, just drafted:\n"), F.col("_comment"), F.lit("\n\n"), ask)).otherwise(ask)
    joined = batches.join(contexts, "table_ref", "left").join(meta, "table_ref", "left").join(comments, "table_ref", "left")
    return joined.select(
        F.concat_ws("|", "table_ref", F.col("batch").cast("string")).alias("prompt_id"), "table_ref", "batch",
        asked.alias("asked"), F.lit(COLUMN_RULES).alias("system"),
        _short_context(F.col("context")).alias("context"),
        profile(shown).alias("profile"), profile(brief).alias("brief_profile"), grounded.alias("instruction"))


def prompt_cost(system: Column, context: Column, profile: Column, instruction: Column) -> Column:
    context_cost = F.when(F.size(context) > 0, tokens(F.concat(F.lit("CONTEXT:\n"), _lines(context)))).otherwise(0)
    return tokens(system) + context_cost + tokens(F.concat(F.lit("PROFILE:\n"), profile)) + tokens(instruction)


def _halved() -> Column:
    size = F.size("context")
    half = F.when(size > 0, F.slice("context", F.lit(1), F.greatest(F.lit(1), F.floor(size / 2).cast("int"))))
    return F.coalesce(half, F.col("context"))


def summary_requests(prompts: DataFrame, budget: int) -> DataFrame:
    """What a summarising model is asked, for the prompts that half their context leaves over budget: ``prompt_id, messages``."""
    steps = prompts.withColumn("_half", _halved()).filter(F.size("context") > 0)
    over = prompt_cost(F.col("system"), F.col("_half"), F.col("profile"), F.col("instruction")) > budget
    listed = F.array(F.struct(F.lit("system").alias("role"), F.lit(SUMMARY_RULES).alias("content")),
                     F.struct(F.lit("user").alias("role"), _lines(F.col("_half")).alias("content")))
    return steps.filter(over).select("prompt_id", F.to_json(listed).alias("messages"))


def fit_prompts(prompts: DataFrame, budget: int | None, summary: Callable[[Column], Column] | None = None,
                summaries: DataFrame | None = None, fallback_length: int = FALLBACK_LENGTH) -> DataFrame:
    """Prompts within the budget, made smaller step by step: half the context, a summary, a brief profile.

    The summary is an expression over the halved context, or the replies to ``summary_requests``
    (``prompt_id, reply, failure``); the first ``fallback_length`` characters stand in only where that
    call failed. With neither, the context stays halved. ``actions`` names the steps that made a prompt
    smaller. One still too large after all of them is sent as it is then, with ``within_budget`` false.
    """
    if budget is None:
        return prompts.withColumns({
            "actions": F.array().cast("array<string>"), "within_budget": F.lit(True),
            "tokens": prompt_cost(F.col("system"), F.col("context"), F.col("profile"), F.col("instruction"))})
    steps = prompts.withColumn("_half", _halved())
    whole = _lines(F.col("_half"))
    if summaries is not None:
        told = summaries.select("prompt_id", F.when(F.col("failure").isNull() & ~is_blank(F.col("reply")), F.col("reply")).alias("_told"))
        steps = steps.join(told, "prompt_id", "left")
        text = F.coalesce("_told", F.left(whole, F.lit(fallback_length)))
    else:
        text = summary(whole) if summary else F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("summary").alias("source"), text.alias("text"))).cast(CONTEXT_LIST)
    steps = steps.withColumn("_short", F.when((F.size("context") > 0) & text.isNotNull(), one).otherwise(F.col("_half")))

    def cost(context: str, profile: str) -> Column:
        return prompt_cost(F.col("system"), F.col(context), F.col(profile), F.col("instruction"))

    steps = steps.withColumns({
        "_t0": cost("context", "profile"), "_t1": cost("_half", "profile"),
        "_t2": cost("_short", "profile"), "_t3": cost("_short", "brief_profile")})
    rung = F.lit(3)
    for i in (2, 1, 0):
        rung = F.when(F.col(f"_t{i}") <= budget, i).otherwise(rung)
    steps = steps.withColumn("_rung", rung)
    labels = ("trim_context", "summarize_context", "reduce_profile")
    taken = [F.when((F.col("_rung") > i) & (F.col(f"_t{i + 1}") < F.col(f"_t{i}")), F.lit(label))
             for i, label in enumerate(labels)]
    used = F.element_at(F.array("_t0", "_t1", "_t2", "_t3"), F.col("_rung") + 1)
    return steps.withColumns({
        "actions": F.array_compact(F.array(*taken)), "tokens": used, "within_budget": used <= budget,
        "context": F.when(F.col("_rung") == 0, F.col("context")).when(F.col("_rung") == 1, F.col("_half")).otherwise(F.col("_short")),
        "profile": F.when(F.col("_rung") == 3, F.col("brief_profile")).otherwise(F.col("profile")),
    }).drop("_half", "_short", "_told", "_t0", "_t1", "_t2", "_t3", "_rung")


def messages() -> Column:
    """The chat messages of a prompt as a JSON list."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    context = F.when(F.size("context") > 0, message("user", F.concat(F.lit("CONTEXT:\n"), _lines(F.col("context")))))
    listed = F.array(message("system", F.col("system")), context,
                     message("user", F.concat(F.lit("PROFILE:\n"), F.col("profile"))),
                     message("user", F.col("instruction")))
    return F.to_json(F.array_compact(listed))


def field_signals(columns: DataFrame, foreign: DataFrame) -> DataFrame:
    """Which template conditions hold for each profiled column."""
    declared = foreign.select("table_ref", F.col("column").alias("name")).distinct().withColumn("_fk", F.lit(True))
    numeric = F.col("type_class").isin("integer", "decimal")
    return columns.join(declared, ["table_ref", "name"], "left").select(
        "table_ref", "name",
        F.create_map(
            F.lit("numeric_measure"), numeric & (F.coalesce("cardinality_ratio", F.lit(0.0)) < 0.98) & F.col("_fk").isNull(),
            F.lit("enum"), F.coalesce("is_enum_candidate", F.lit(False)),
            F.lit("nullable"), F.coalesce("nullable", F.lit(False)),
            F.lit("fk"), F.coalesce("_fk", F.lit(False)),
            F.lit("computed"), F.lit(False),
            F.lit("pii"), F.coalesce(F.col("pii.detected"), F.lit(False)),
        ).alias("signals"))


def applicable_fields(columns: DataFrame, required: tuple[str, ...] = COLUMN_REQUIRED,
                      conditional: dict[str, tuple[str, str]] = COLUMN_CONDITIONAL) -> DataFrame:
    """Template fields of each column: the required ones, and those whose condition its signals meet."""
    listed = [F.struct(F.lit(n).alias("field"), F.lit("required").alias("requirement"), F.lit("always").alias("when"),
                       F.lit(None).cast("string").alias("rule")) for n in required]
    listed += [F.struct(F.lit(n).alias("field"), F.lit("conditional").alias("requirement"), F.lit(w).alias("when"),
                        F.lit(r).cast("string").alias("rule")) for n, (w, r) in conditional.items()]
    meets = F.filter(F.array(*listed), lambda f: (f["when"] == "always") | F.coalesce(
        F.try_element_at(F.col("signals"), f["when"]), F.lit(False)))
    return columns.select("table_ref", "name", F.inline(meets))


def template_errors(rubric: DataFrame, fields: DataFrame) -> DataFrame:
    """Templates that cannot be used: ``template, message`` rows; none for valid ones.

    ``rubric`` has ``template, dim, weight``; ``fields`` has ``template, scope, field, requirement, when``.
    """
    weights = rubric.groupBy("template").agg(F.sum("weight").alias("total"))
    off = weights.filter(F.abs(F.col("total") - 1) > WEIGHT_TOLERANCE).select(
        "template", F.lit("rubric weights must sum to 1").alias("message"))
    missing = rubric.filter(F.col("weight").isNull()).select(
        "template", F.lit("rubric dimension without a weight").alias("message")).distinct()
    needed = fields.select("template").unionByName(rubric.select("template")).distinct()
    per_template = fields.groupBy("template").agg(
        F.count_if((F.col("scope") == "column") & (F.col("requirement") == "required") & (F.col("field") == "definition")).alias("definition"),
        F.count_if((F.col("scope") == "table") & (F.col("requirement") == "required")).alias("table_required"),
        F.count_if((F.col("requirement") == "conditional") & ~F.coalesce("when", F.lit("always")).isin(*CONDITIONS)).alias("unknown"))
    checked = needed.join(per_template, "template", "left").join(weights.select("template", F.lit(1).alias("scored")), "template", "left")
    found = F.array_compact(F.array(
        F.when(F.coalesce("definition", F.lit(0)) == 0, F.lit("column fields must require a definition")),
        F.when(F.coalesce("table_required", F.lit(0)) == 0, F.lit("table fields must not be empty")),
        F.when(F.coalesce("unknown", F.lit(0)) > 0, F.lit("unknown condition")),
        F.when(F.col("scored").isNull(), F.lit("rubric must not be empty"))))
    return off.unionByName(missing).unionByName(checked.select("template", F.explode(found).alias("message")))
