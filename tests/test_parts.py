import pytest
from pyspark.sql import functions as F

from tablelore.operators import parts
from tablelore.operators.profile import ProfileOptions, profile_table
from tablelore.sources.versions import Moved, Versions

REF, FIELDS = "a.b.c", ("ordinal", "data_type", "type_class", "null_fraction", "min", "max", "is_enum_candidate")


def rows(spark, first, last, day):
    return spark.range(first, last).select(
        "id", F.expr("IF(id % 4 = 0, NULL, cast(id % 7 AS string))").alias("few"), (F.col("id") / 8).alias("part_of"),
        F.expr("cast(id AS decimal(12,3)) / 7").alias("dec"), F.expr("date_add(DATE'2024-01-01', cast(id % 400 AS int))").alias("d"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 3)").alias("at"),
        F.array("id").alias("list"), F.expr("concat(id, '@x.org')").alias("email"), F.lit(day).alias("day"))


def stored(spark, path, first, last, day):
    rows(spark, first, last, day).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def same(merged, whole):
    found, expected = ({r.name: r for r in p.columns.collect()} for p in (merged, whole))
    assert found.keys() == expected.keys()
    for name, row in expected.items():
        assert [found[name][f] for f in FIELDS] == [row[f] for f in FIELDS], name
        assert found[name].top_k == row.top_k and found[name].pii == row.pii, name
        if row.distinct_count:
            assert abs(found[name].distinct_count - row.distinct_count) <= 0.08 * row.distinct_count, name
    one, two = merged.tables.first(), whole.tables.first()
    assert (one.row_count, one.column_count, one.warnings) == (two.row_count, two.column_count, two.warnings)


def files_read(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def test_new_parts_are_measured_alone_and_merged(spark, tmp_path):
    path, options = str(tmp_path / "t"), ProfileOptions(exact=True)
    profiles = parts.PartProfiles(spark, str(tmp_path / "store"))
    table = stored(spark, path, 0, 3000, "2024-01-01")
    assert profiles.refresh(table, REF, "day") == ["2024-01-01"]
    same(profiles.profile(REF), profile_table(table, REF, options))
    table = stored(spark, path, 2000, 5000, "2024-01-02")
    plan = parts.measure(table, REF, "day", parts=["2024-01-02"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "2024-01-02" in text and "2024-01-01" not in text
    assert profiles.refresh(table, REF, "day") == ["2024-01-02"] and profiles.refresh(table, REF, "day") == []
    same(profiles.profile(REF), profile_table(table, REF, options))


def test_parts_that_changed_or_went(spark, tmp_path):
    profiles = parts.PartProfiles(spark, str(tmp_path / "store"))
    old = rows(spark, 0, 100, "a").union(rows(spark, 0, 50, "b"))
    profiles.refresh(old, REF, "day")
    new = rows(spark, 0, 100, "a").union(rows(spark, 500, 900, "b"))
    assert profiles.refresh(new, REF, "day") == [] and profiles.refresh(new, REF, "day", again=["b"]) == ["b"]
    same(profiles.profile(REF), profile_table(new, REF, ProfileOptions(exact=True)))
    only = rows(spark, 0, 100, "a")
    assert profiles.refresh(only, REF, "day") == []
    same(profiles.profile(REF), profile_table(only, REF, ProfileOptions(exact=True)))


def test_null_parts_other_tables_and_new_columns(spark, tmp_path):
    profiles = parts.PartProfiles(spark, str(tmp_path / "store"))
    table = spark.createDataFrame([(1, None, "x"), (2, "p", None), (3, None, "y")], "id int, day string, v string")
    assert set(profiles.refresh(table, REF, "day")) == {None, "p"}
    same(profiles.profile(REF), profile_table(table, REF, ProfileOptions(exact=True)))
    profiles.refresh(rows(spark, 0, 10, "z"), "other.t.x", "day")
    assert profiles.profile(REF).tables.first().row_count == 3
    wider = spark.createDataFrame([(9, "q", "z", 5)], "id int, day string, v string, more int").unionByName(table, allowMissingColumns=True)
    assert profiles.refresh(wider, REF, "day") == ["q"]
    more = {r.name: r for r in profiles.profile(REF).columns.collect()}["more"]
    assert more.ordinal == 4 and more.min == "5" and more.null_fraction == 0.75
    with pytest.raises(ValueError, match="no part"):
        profiles.profile("not.there.yet")


def test_a_table_refreshed_twice_at_once_is_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    profiles, other = parts.PartProfiles(spark, folder), parts.PartProfiles(spark, folder)
    own, first = Versions.write, []

    def late(self, part, made, key):
        if not first:
            first.append(True)
            other.refresh(rows(spark, 0, 5, "x"), REF, "day")
        return own(self, part, made, key)
    monkeypatch.setattr(Versions, "write", late)
    with pytest.raises(Moved):
        profiles.refresh(rows(spark, 0, 5, "x"), REF, "day")
    assert profiles.profile(REF).tables.first().row_count == 5


def test_no_rows(spark):
    made = parts.merge(parts.measure(rows(spark, 0, 0, "a"), REF, "day"))
    assert made.count() == 0
