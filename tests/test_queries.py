"""Each registered query against its SQL."""

import pytest
from helpers import DATA, rows_of

from pathloom.queries import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    found, wanted = rows_of(QUERIES[name](spark, DATA).toPandas()), rows_of(duck.execute(SQL[name]).df())
    assert found == wanted


def test_queries_without_sql(spark):
    rest = sorted(set(QUERIES) - set(SQL))
    assert rest == ["cfg_loop_mark"]
    for name in rest:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 76
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tables_are_files_or_folders(spark, tmp_path):
    from pathloom.sources import scans

    spark.range(4).write.parquet(str(tmp_path / "x.parquet" / "a" / "orders.parquet"))
    spark.range(4).repartition(3).write.parquet(str(tmp_path / "x.parquet" / "a" / "events.parquet"))
    part = next((tmp_path / "x.parquet" / "a" / "orders.parquet").glob("part-*.parquet"))
    (tmp_path / "x.parquet" / "a" / "region.parquet").write_bytes(part.read_bytes())
    (tmp_path / "x.parquet" / "a" / "notes.txt").write_text("no table")
    for path in (tmp_path / "x.parquet" / "a", f"file://{tmp_path}/x.parquet/a/"):
        assert sorted(r.name for r in QUERIES["scan_files"](spark, str(path)).collect()) == ["events.parquet", "orders.parquet", "region.parquet"]
