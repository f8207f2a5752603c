"""The queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import circulant, disclosure, divergence, flatgraph, language, ledger, lexicon, outliers, packing, tokens, toxicity, tries, whitening
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.toxicity(documents(spark, folder), labels).select("doc_id", "held_out", "score", "predicted")


@_query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return tries.exact_duplicates(documents(spark, folder))


ORACLES["op2_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@_query
def op4_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    spans = disclosure.private_spans(documents(spark, folder))
    counts = (disclosure.number_of(kind).alias(f"n_{kind}") for kind in disclosure.BASE)
    return spans.select("doc_id", *counts, F.sha2(disclosure.rendered(F.col("spans"), disclosure.BASE), 256).alias("base_sha256"),
                        disclosure.rendered(F.col("spans")).alias("spans"))


@_query
def op5_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return circulant.near_duplicates(documents(spark, folder), words=3, percent=85)


ORACLES["op5_circulant_minhash"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
k AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""


@_query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder))


@_query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder))


@_query
def op10_transducer_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = lexicon.encode(documents(spark, folder))
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op3_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.outlying(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op8_sparse_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.predicted(docs, language.fit(docs))


@_query
def op9_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = ledger.scan(documents(spark, folder).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    counts = (ledger.number_of(rule).cast("bigint").alias(f"n_{rule.name}") for rule in ledger.BASE)
    return found.select("doc_id", *counts, F.sha2(ledger.rendered(F.col("spans"), ledger.BASE), 256).alias("base_sha256"),
                        ledger.rendered(F.col("spans")).alias("spans"))


def _ledger_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = "\nUNION ALL\n".join(
        f"SELECT r, {k} AS k, '{x.name}' AS rule, string_split_regex(t, {quoted(x.pattern)}) AS parts, "
        f"regexp_extract_all(t, {quoted(x.pattern)}) AS hits, "
        + (f"regexp_extract_all(t, {quoted(x.pattern)}, {x.group})" if x.group else "regexp_extract_all(t, " + quoted(x.pattern) + ")")
        + f" AS g, {x.least} AS least FROM d" for k, x in enumerate(ledger.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
each_rule AS ({each}),
m AS (SELECT r, k, rule, least, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS before, unnest(g) AS g,
             generate_subscripts(hits, 1) AS pos FROM each_rule WHERE len(hits) > 0),
p AS (SELECT r, k, rule, length(hit) AS n, length(g) >= least AS fine,
             sum(length(before) + length(hit)) OVER (PARTITION BY r, k ORDER BY pos) AS e FROM m),
f AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(rule || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) AS spans,
             string_agg(rule || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) FILTER (k < 3) AS base
      FROM p WHERE fine GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)
"""


ORACLES["op9_blob_ledger"] = _ledger_sql()


@_query
def op11_pair_merge(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(documents(spark, folder))


ORACLES["op11_pair_merge"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             (1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v))::BIGINT AS p
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
lt AS (SELECT lang, sum(n) AS total FROM lc GROUP BY lang),
q AS (SELECT lang, term, (1 + (1000000000 * (n + 2)) // (total + 2 * v))::BIGINT AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q)
      FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 10
"""


@_query
def op12_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    return flatgraph.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op12_pruned_graph"] = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT r, label, len(v) AS size, list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) AS v
      FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NOT NULL AND isfinite(c))) = len(v)
          AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.size = b.size AND a.r <> b.r
      WHERE list_dot_product(a.v, b.v) >= 0.98),
reach(r, node) AS (SELECT r, r FROM e UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.node GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e LEFT JOIN n USING (r) JOIN c USING (r)
"""


@_query
def op13_secular_whitening(spark: SparkSession, folder: str) -> DataFrame:
    made = whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
