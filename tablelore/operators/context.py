"""Context of a table: providers side by side, ranked and cut to a token budget."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.loose_json import result_texts
from ..functions.text import is_blank, strip, tokens
from ..schemas import SNIPPET
from ..session import cut_lineage
from .library import reusable
from .lineage import snippet_fields
from .skew import prefix_within_budget, top_per_key

# Budgets, caps and relevance of snippets.
CONTEXT_BUDGET = 4000
SNIPPETS_PER_PROVIDER = 8
TERMS_SEARCHED = 25
LIBRARY_SOURCE = "comment_library"
LIBRARY_TABLE_RELEVANCE, LIBRARY_COLUMN_RELEVANCE = 0.82, 0.85
RESULT_RELEVANCE = 0.6


def library_text(subject: Column) -> Column:
    """Approved wording offered for reuse; NULL where the entry has no comment."""
    uses = F.col("usage_count")
    suffix = F.when(uses.isNotNull(), F.format_string(" [approved, used %dx]", uses)).otherwise(" [approved]")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" tags: "), F.array_join("tags", ", "), F.lit("."))).otherwise("")
    # The wording of a reuse snippet.
    text = F.concat(
        F.lit("Previously-approved canonical comment for "), subject,
        F.lit(" — REUSE this wording if it fits this table's evidence; adapt or ignore it if the data "
              "differs (do not copy blindly)"),
        suffix, F.lit(': "'), strip(F.col("canonical_comment")), F.lit('".'), tags)
    return F.when(~is_blank(F.col("canonical_comment")), text)


def library_snippets(library: DataFrame, columns: DataFrame) -> DataFrame:
    """Approved comments of the table itself and of columns with the same name."""
    tables = columns.select("table_ref").distinct()
    of_table = reusable(library, "table", tables.select(F.col("table_ref").alias("match_key")))
    table_rows = of_table.withColumnRenamed("match_key", "table_ref").select(
        "table_ref", *snippet_fields(library_text(F.lit("this table")), LIBRARY_SOURCE, LIBRARY_TABLE_RELEVANCE, 0))
    named = columns.filter(F.coalesce(F.col("name"), F.lit("")) != "").select(
        "table_ref", F.col("name").alias("match_key")).distinct()
    of_column = reusable(library, "column", named.select("match_key"))
    subject = F.concat(F.lit("a column named `"), F.col("match_key"), F.lit("`"))
    column_rows = named.join(of_column, "match_key").select(
        "table_ref", *snippet_fields(library_text(subject), LIBRARY_SOURCE, LIBRARY_COLUMN_RELEVANCE, 1,
                                     F.array("match_key")))
    return table_rows.unionByName(column_rows).filter(F.col("text").isNotNull())


def search_texts(columns: DataFrame, template: str = "{full_name}: {column_terms}", terms_searched: int = TERMS_SEARCHED) -> DataFrame:
    """The search text of each table, naming its first columns."""
    first = top_per_key(columns, ["table_ref"], [F.col("ordinal"), F.col("name")], terms_searched, ["name"])
    named = first.groupBy("table_ref").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("c"))
    terms = F.array_join(F.transform("c", lambda x: x["name"]), ", ")
    text = F.lit(template)
    for slot, value in (("{full_name}", F.col("table_ref")), ("{column_terms}", terms)):
        text = F.replace(text, F.lit(slot), value)
    return named.select("table_ref", text.alias("query"))


def allowed_tools(tools: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Tools on the list; all of them where the list is empty."""
    return tools.filter(F.col("tool").isin(*allowed)) if allowed else tools


def result_snippets(results: DataFrame, limit: int = SNIPPETS_PER_PROVIDER) -> DataFrame:
    """Texts of tool results, the first few per table and provider.

    ``results`` has ``table_ref, provider, call, payload``; ``call`` numbers a provider's results.
    """
    texts = results.select(
        "table_ref", "provider", "call", F.posexplode(result_texts(F.col("payload"))).alias("item", "text"))
    order = [F.col("call"), F.col("item"), F.col("text")]
    first = top_per_key(texts, ["table_ref", "provider"], order, limit, ["call", "item"])
    return first.select("table_ref", *snippet_fields(F.col("text"), F.col("provider"), RESULT_RELEVANCE, F.col("rank")))


def ranking() -> tuple[list[Column], list[Column]]:
    """Most relevant first, without relevance last; then in order of provider and place within the provider; then by text."""
    place = [F.col("relevance").isNull(), -F.col("relevance"), F.col("provider_seq"), F.col("seq")]
    return place, [F.col("text"), F.col("source")]


def with_token_cost(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("cost", tokens(F.col("text")))


def within_budget(snippets: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Snippets of each table from the most relevant on, as long as they fit the budget together."""
    priced = with_token_cost(snippets)
    kept = prefix_within_budget(priced, ["table_ref"], *ranking(), "cost", budget, ["text", "source"])
    return kept.drop("cost")


@dataclass(frozen=True)
class Context:
    snippets: DataFrame
    warnings: list[str]


def gather(providers: Mapping[str, Callable[[DataFrame], DataFrame]], targets: DataFrame,
           budget: int = CONTEXT_BUDGET) -> Context:
    """Snippets of every provider that answers; one that fails leaves a warning instead."""
    spark = targets.sparkSession
    frames, warnings = [], []
    for place, (name, provide) in enumerate(providers.items()):
        try:
            rows = provide(targets).select(*SNIPPET.names).withColumn("provider_seq", F.lit(place))
            frames.append(cut_lineage(rows))
        except Exception as failure:  # a provider that is down must not stop the others
            warnings.append(f"{name}: unavailable ({str(failure).splitlines()[0]})")
    empty = spark.createDataFrame([], SNIPPET).withColumn("provider_seq", F.lit(0))
    everything = reduce(DataFrame.unionByName, frames) if frames else empty
    return Context(within_budget(everything, budget), warnings)
