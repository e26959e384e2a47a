"""Profiles of streams: equal to that of the whole table, with repeats, late rows and restarts."""

import pytest

from furrow import model as M
from furrow.streaming import profile as P

SCHEMA = "id long, ts timestamp, value double, kind string"
COLUMNS = ["id", "ts", "value", "kind"]


def events(spark, ids, day="2024-01-01"):
    return spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(
        "id", f"timestamp '{day}' + make_interval(0, 0, 0, 0, 0, id) ts",
        "if(id % 5 = 0, null, id / 4D) value", "concat('k', id % 7) kind")


def run(spark, folder, delay="2 hours"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    P.profile_stream(stream, COLUMNS, f"{folder}/out", f"{folder}/marks", "id", "ts",
                     delay).awaitTermination()
    return {r["column"]: r for r in P.stream_profile(spark, f"{folder}/out").collect()}


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_equals_the_whole_table_and_goes_on_after_a_restart(spark, tmp_path):
    add(events(spark, range(0, 40)), tmp_path)
    add(events(spark, [*range(30, 60), 59, 59]), tmp_path)
    first = run(spark, tmp_path)
    assert first["id"]["rows"] == 60
    add(events(spark, range(50, 100)), tmp_path)
    got = run(spark, tmp_path)
    again = run(spark, tmp_path)
    assert again == got
    want = {r["column"]: r for r in P.merge_parts(P.profile_parts(events(spark, range(100)), COLUMNS)).collect()}
    for name in COLUMNS:
        exact = [got[name][c] for c in ("rows", "missing", "low", "high")]
        assert exact == [want[name][c] for c in ("rows", "missing", "low", "high")]
        assert got[name]["about_distinct"] == pytest.approx(want[name]["about_distinct"], rel=0.03)
    assert (got["value"]["missing"], got["kind"]["about_distinct"], got["kind"]["low"]) == (20, 7, None)


def test_late_rows_are_left_out(spark, tmp_path):
    add(events(spark, range(10), "2024-01-05"), tmp_path)
    run(spark, tmp_path)
    add(events(spark, [500], "2024-01-05"), tmp_path)
    add(events(spark, range(20, 25), "2024-01-01"), tmp_path)
    got = run(spark, tmp_path)
    assert got["id"]["rows"] == 11 and got["id"]["high"] == 500


def test_no_rows_and_no_columns(spark):
    empty = P.merge_parts(P.profile_parts(events(spark, []), COLUMNS)).collect()
    assert {(r["rows"], r["missing"], r["low"], r["about_distinct"]) for r in empty} == {(0, 0, None, 0)}
    with pytest.raises(M.PreparationError, match="no such column"):
        P.profile_parts(events(spark, []), ["other"])
