import datetime
import re

import pytest
from pyspark.sql import functions as F, types as T

from tablelore.functions.columns import share_label, type_class, type_class_of
from tablelore.operators.profile import (
    WARN_EMPTY, WARN_SAMPLED, ProfileOptions, _exact_distinct, accept_versions, column_stats, merge_batches, profile_table,
    profile_tables, scan_for_private_values, table_block,
)
from tablelore.sources.sampling import Sample, apply_sample

EXACT = ProfileOptions(exact=True)


@pytest.fixture(scope="module")
def orders(spark):
    status = F.when(F.col("id") < 60, "F").when(F.col("id") < 90, "O").otherwise("P")
    ssn = F.when(F.col("id") < 90, F.when(F.col("id") % 2 == 0, "123-45-6789").otherwise("987-65-4321"))
    return spark.range(1, 101).select(
        F.col("id").alias("o_orderkey"), status.alias("o_orderstatus"), ssn.alias("ssn"))


@pytest.fixture(scope="module")
def columns(orders):
    return {r.name: r for r in profile_table(orders, "samples.tpch.orders", EXACT).columns.collect()}


def test_key_column(columns):
    key = columns["o_orderkey"]
    assert (key.cardinality_ratio, key.is_enum_candidate, key.top_k, key.min, key.max) == (1.0, False, None, "1", "100")


def test_enum_values_in_order_of_frequency(columns):
    status = columns["o_orderstatus"]
    assert [v.value for v in status.top_k] == ["F", "O", "P"] and not status.pii.detected and status.pii.action == "none"


def test_personal_values_are_masked(columns):
    ssn = columns["ssn"]
    assert ssn.pii.classes == ["ssn"] and ssn.pii.action == "masked"
    assert {v.value for v in ssn.top_k} == {"12•••••••••", "98•••••••••"}
    assert abs(ssn.null_fraction - 0.11) < 1e-9


def test_range_of_a_flagged_column_is_masked_unless_switched_off(spark):
    rows = spark.range(1000, 1060).select(F.col("id").alias("phone"))
    assert profile_table(rows, "a.b.c").columns.first().min == "10••"
    assert profile_table(rows, "a.b.c", ProfileOptions(mask_range=False)).columns.first().min == "1000"


def test_empty_table(spark, orders):
    made = profile_table(orders.filter("o_orderkey < 0"), "a.b.c", EXACT)
    block = made.tables.first()
    assert block.row_count == 0 and block.warnings == [WARN_EMPTY]
    assert all(r.null_fraction is None and not r.is_enum_candidate for r in made.columns.collect())


def test_structure_only_columns_are_listed_and_not_read(spark):
    rows = spark.range(5).select(F.struct("id").alias("s"), F.array("id").alias("a"), F.lit(b"x").alias("b"), F.col("id").alias("odd`name's"))
    made = {r.name: r for r in profile_table(rows, "a.b.c", EXACT).columns.collect()}
    assert made["s"].type_class == "complex" and made["s"].null_fraction is None and made["s"].pii.action == "none"
    assert made["b"].type_class == "binary" and made["odd`name's"].distinct_count == 5


def test_ranges_are_iso_text(spark):
    rows = spark.createDataFrame(
        [(datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5)), (datetime.date(2024, 3, 1), datetime.datetime(2024, 1, 2, 3, 4, 5, 60))],
        T.StructType([T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType())]))
    made = {r.name: r for r in column_stats(rows, "a.b.c", EXACT).collect()}
    assert (made["d"].min, made["d"].max) == ("2024-01-02", "2024-03-01")
    assert (made["t"].min, made["t"].max) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000060")


@pytest.mark.parametrize("declared, expected", [
    ("bigint", "integer"), ("DECIMAL(10,2)", "decimal"), ("timestamp", "temporal"), ("interval day to second", "string"),
    ("timestamp_ltz", "string"), ("array<int>", "complex"), ("binary", "binary"), ("boolean", "boolean"), ("variant", "string"), (None, "string")])
def test_type_classes(spark, declared, expected):
    row = spark.createDataFrame([(declared,)], "t string").select(type_class(F.col("t")).alias("c")).first()
    assert row.c == expected


def test_type_class_of_schema_types():
    assert type_class_of(T.DecimalType(10, 2)) == "decimal" and type_class_of(T.MapType(T.StringType(), T.StringType())) == "complex"


def test_wide_table_in_batches(spark):
    wide = spark.range(30).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(120)])
    rows = column_stats(wide, "a.b.c", ProfileOptions(exact=True, batch_size=50)).collect()
    assert [r.ordinal for r in sorted(rows, key=lambda r: r.ordinal)] == list(range(1, 121))
    assert all(r.distinct_count == min(30, int(r.name[1:]) + 1) for r in rows)


def test_exact_counts_shuffle_one_value_a_row(spark):
    kinds = ("bigint", "double", "string", "date", "boolean", "int")
    wide = spark.range(40).selectExpr(*(
        f"cast({'timestamp_seconds(id * 86400)' if k == 'date' else 'id % 7'} AS {k}) AS {k}_{n}" for k in kinds for n in range(2)))
    shuffled = _exact_distinct(wide, list(enumerate(wide.schema.fields)))
    assert {r.ordinal: r.found for r in shuffled.collect()} == dict(enumerate([7, 7, 7, 7, 7, 7, 40, 40, 2, 2, 7, 7]))
    keys = re.findall(r"Aggregate \[(ordinal[^\]]*)\]", shuffled._jdf.queryExecution().optimizedPlan().toString())
    assert max(len(k.split(",")) for k in keys) == 2


def test_merged_batches_keep_first_columns_and_all_warnings(spark, orders):
    def batch(n, names):
        return (column_stats(orders, "a.b.c", EXACT, names).withColumn("batch", F.lit(n)),
                table_block(orders, "a.b.c", n == 1, 99).withColumn("batch", F.lit(n)))

    (c0, t0), (c1, t1) = batch(0, ["o_orderkey", "ssn"]), batch(1, ["ssn", "o_orderstatus"])
    columns, tables = merge_batches(c0.unionByName(c1), t0.unionByName(t1))
    assert sorted(r.name for r in columns.collect()) == ["o_orderkey", "o_orderstatus", "ssn"]
    assert tables.first().column_count == 3 and tables.first().warnings == [WARN_SAMPLED]
    with pytest.raises(Exception, match="without a name"):
        merge_batches(c0.withColumn("name", F.lit("")), t0)[0].collect()


def test_versions(spark):
    stored = spark.createDataFrame([("a", "1.0"), ("b", "1.9"), ("c", "2.0"), ("d", None), ("e", "x.1")], "table_ref string, profile_version string")
    good, bad = accept_versions(stored)
    assert sorted(r.table_ref for r in good.collect()) == ["a", "b"] and sorted(r.table_ref for r in bad.collect()) == ["c", "d", "e"]
    assert accept_versions(stored, minimum="1.5")[0].count() == 1


def test_one_failing_table_leaves_the_others(spark, orders, tmp_path):
    def gone():
        raise PermissionError("no grant")

    folder = str(tmp_path / "profiles")
    odd = "a.b.x=y z"
    assert profile_tables(spark, {odd: lambda: orders}, options=EXACT, out=folder).tables.first().table_ref == odd
    for out in (None, folder):
        made = profile_tables(spark, {"a.b.orders": lambda: orders, "a.b.gone": gone}, options=EXACT, out=out)
        assert [(r.table_ref, r.message) for r in made.errors.collect()] == [("a.b.gone", "no grant")]
        assert made.columns.count() == 3 and made.tables.first().row_count == 100
        assert {r.table_ref for r in made.columns.collect()} == {"a.b.orders"}


@pytest.mark.parametrize("mode, value", [("some", None), ("rows", None), ("percent", None), ("percent", 101), ("percent", -1)])
def test_bad_samples(mode, value):
    with pytest.raises(ValueError):
        Sample(mode, value)


def test_samples(spark, orders):
    assert apply_sample(orders, Sample("rows", 7)).count() == 7
    assert apply_sample(orders, Sample("percent", 0)).count() == 100
    made = profile_table(orders, "a.b.c", EXACT, sample=Sample("rows", 40))
    block = made.tables.first()
    assert (block.row_count, block.sampled, block.row_count_is_estimate, block.warnings) == (40, True, True, [WARN_SAMPLED])


def test_scan_of_every_value(spark):
    rows = spark.range(500).select(F.concat(F.lit("user"), "id", F.lit("@x.org")).alias("contact"), F.lit("plain").alias("other"))
    hits = {r.name: r.email_values for r in scan_for_private_values(rows, "a.b.c").collect()}
    assert hits == {"contact": 500, "other": 0}


@pytest.mark.parametrize("ratio, label", [
    (0.0015, "0.1% unique"), (0.0025, "0.3% unique"), (0.0075, "0.8% unique"), (0.125, "13% unique"), (1.0, "100% unique"), (0.5, "50% unique")])
def test_share_labels(spark, ratio, label):
    assert spark.createDataFrame([(ratio,)], "r double").select(share_label(F.col("r")).alias("s")).first().s == label


@pytest.mark.parametrize("exact", [False, True])
def test_values_without_order_or_equality_are_profiled(spark, exact):
    rows = spark.sql("""SELECT parse_json(concat('{"a":', id % 3, '}')) AS v, make_interval(0, CAST(id % 4 AS INT)) AS i, id
                        FROM range(60) UNION ALL SELECT NULL, NULL, 60""")
    made = profile_table(rows, "c.s.t", ProfileOptions(exact=exact))
    found = {r.name: r for r in made.columns.collect()}
    assert (found["v"].distinct_count, found["i"].distinct_count, found["id"].distinct_count) == (3, 4, 61 if exact else found["id"].distinct_count)
    assert found["i"].min is None and found["i"].max is None and found["id"].max == "60"
    assert {x["count"] for x in found["v"].top_k} == {20} and found["v"].top_k[0]["value"] == '{"a":0}'
    assert made.tables.first().row_count == 61


def test_values_are_counted_in_the_pass_of_the_statistics(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).select(
        "id", (F.col("id") % 40).alias("forty"), (F.col("id") % 75).alias("more"), F.expr("IF(id % 3 = 0, NULL, id % 2 = 0)").alias("flag"),
        F.expr("cast(id % 4 AS decimal(6,2)) / 4").alias("part"), F.expr("date_add(DATE'2024-01-01', cast(id % 3 AS int))").alias("day"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id % 2) / 2)").alias("at"),
        F.expr("make_dt_interval(0, cast(id % 2 AS int))").alias("span"), F.expr("make_ym_interval(1, cast(id % 2 AS int))").alias("months"),
        F.expr("concat(repeat('long', 200), id % 5)").alias("text")).write.parquet(path)
    rows = spark.read.parquet(path)
    stats = column_stats(rows, "a.b.c", EXACT, with_values=True)
    assert str(column_stats(rows, "a.b.c", with_values=True)._jdf.queryExecution().optimizedPlan()).count("Relation") == 1
    for made in (stats, profile_table(rows, "a.b.c").columns):
        found = {r.name: r.top_k and [(v.value, v["count"]) for v in r.top_k] for r in made.collect()}
        assert found["id"] is None and found["more"] is None and len(found["forty"]) == 20
        assert found["forty"] == sorted(((str(k), 75) for k in range(40)))[:20]
        assert found["flag"] == [("false", 1000), ("true", 1000)] and found["day"][0] == ("2024-01-01", 1000)
        assert found["at"] == [("2024-01-01T00:00:00", 1500), ("2024-01-01T00:00:00.500000", 1500)]
        assert [v for v, _ in found["part"]] == sorted(v for v, _ in found["part"]) and len(found["part"]) == 4
        assert len(found["span"]) == len(found["months"]) == 2 and found["text"][0] == ("long" * 200 + "0", 600)


def test_small_tables_share_jobs(spark, tmp_path, monkeypatch):
    from tablelore.operators import profile

    paths = {f"a.b.t{k}": str(tmp_path / f"t{k}") for k in range(30)}
    for k, path in enumerate(paths.values()):
        spark.range(k + 1).select("id", (F.col("id") % 3).cast("string").alias("few")).coalesce(1).write.parquet(path)
    loaders = {ref: (lambda path=path: spark.read.parquet(path)) for ref, path in paths.items()}
    packs, own = [], profile.measured_tables

    def counted(tables, *args):
        packs.append(len(tables))
        return own(tables, *args)
    monkeypatch.setattr(profile, "measured_tables", counted)
    for out in (None, str(tmp_path / "out")):
        packs.clear()
        made = profile_tables(spark, loaders, options=EXACT, out=out, describe=lambda ref: {"comment": f"about {ref}"})
        assert packs == [30] and {(r.table_ref, r.row_count, r.existing_comment) for r in made.tables.collect()} == {
            (f"a.b.t{k}", k + 1, f"about a.b.t{k}") for k in range(30)}
        assert made.columns.count() == 60 and made.errors.count() == 0
    monkeypatch.setattr(profile, "PACK_COLUMNS", 20)
    packs.clear()
    profile_tables(spark, loaders)
    assert packs == [10, 10, 10]
    loaders |= {"a.b.bad": lambda: spark.read.parquet(paths["a.b.t1"]).select(F.raise_error(F.lit("broken")).alias("x"), "id"),
                "a.b.none": lambda: spark.range(7).select(), "a.b.gone": lambda: spark.read.parquet(str(tmp_path / "nowhere"))}
    found = profile_tables(spark, loaders)
    assert {r.table_ref for r in found.errors.collect()} == {"a.b.bad", "a.b.gone"}
    assert found.tables.count() == 31 and {r.row_count for r in found.tables.filter("table_ref = 'a.b.none'").collect()} == {7}
