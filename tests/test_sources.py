from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeward.sources import files, generated, jdbc, tables

PEOPLE = "id,name,age,city\n1,Alice,25,New York\n2,Bob,30,London\n3,Charlie,35,Paris\n4,David,28,Tokyo\n5,Eve,32,Sydney\n"


@pytest.fixture
def write(tmp_path):
    def make(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(text.encode(encoding))
        return str(path)

    return make


def test_csv_with_inferred_types(spark, write):
    df = files.read_csv(spark, write("people.csv", PEOPLE))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("age", "bigint"), ("city", "string")]
    assert df.count() == 5
    assert rows(files.read_csv_inferred(spark, write("p.csv", PEOPLE)), "age") == [(25,), (28,), (30,), (32,), (35,)]


def test_csv_missing_tokens(spark, write):
    text = "id,v,w\n1,NULL,a\n2,NA,NaN\n3,,n/a\n4,null,None\n5,7,b\n"
    df = files.read_csv(spark, write("na.csv", text))
    assert dict(df.dtypes)["v"] == "bigint"
    assert rows(df, "v", "w") == sorted([(None, "a"), (None, None), (None, None), (None, None), (7, "b")], key=repr)
    own = files.read_csv(spark, write("own.csv", "v\n-\n3\n"), na_values=["-"])
    assert rows(own) == [(3,), (None,)]


def test_csv_separator_encoding_and_no_header(spark, write):
    path = write("semi.csv", "1;Zoë\n2;José\n", "latin-1")
    df = files.read_csv(spark, path, schema="id int, name string", separator=";", encoding="iso-8859-1", header=False)
    assert rows(df) == [(1, "Zoë"), (2, "José")]
    with pytest.raises(ValueError, match="declared"):
        files.read_csv(spark, path, schema="id int", separator=";", header=False)


def test_csv_quotes_and_line_breaks(spark, write):
    path = write("quoted.csv", 'id,t\n1,"say ""hi"", you"\n2,"two\nlines"\n')
    df = files.read_csv(spark, path, multiline=True)
    assert rows(df) == [(1, 'say "hi", you'), (2, "two\nlines")]


def test_csv_kinds_narrow_to_what_fits(spark, write):
    text = "a,b,c,d,e\n1,1.5,true,x,\n2,2,FALSE,3,\n"
    assert dict(files.read_csv(spark, write("k.csv", text)).dtypes) == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string",
    }


def test_parquet_columns_are_pruned(spark, small):
    df = files.read_parquet(spark, small.path("orders"), ["o_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_check_source(spark, small, write, tmp_path):
    assert files.check_source(spark, small.path("orders"), "parquet") == (True, "")
    assert files.check_source(spark, write("p.csv", PEOPLE), "csv") == (True, "")
    assert not files.check_source(spark, str(tmp_path / "gone.csv"), "csv")[0]
    (tmp_path / "empty").mkdir()
    assert not files.check_source(spark, str(tmp_path / "empty"), "csv")[0]
    ok, why = files.check_source(spark, write("bad.parquet", "no parquet"), "parquet")
    assert not ok and "unreadable" in why


def test_file_sizes(spark, small):
    sizes = files.file_sizes(spark, small.folder)
    assert sizes.count() == 14
    assert sizes.filter("length <= 0").count() == 0


@pytest.mark.parametrize(
    "config, url",
    [
        ({"type": "mysql", "host": "h", "database": "d"}, "jdbc:mysql://h:3306/d"),
        ({"type": "postgresql", "database": "d"}, "jdbc:postgresql://localhost:5432/d"),
        ({"type": "sqlserver", "host": "h", "port": 9, "database": "d"}, "jdbc:sqlserver://h:9;databaseName=d"),
        ({"type": "sqlite", "database": "/x/y.db"}, "jdbc:sqlite:/x/y.db"),
    ],
)
def test_jdbc_urls(config, url):
    assert jdbc.jdbc_url(config) == url


def test_jdbc_options():
    config = {"type": "mysql", "user": "u", "password": "p", "database": "d"}
    options = jdbc.jdbc_options(
        config, query="select 1", chunk_size=500, split_on="id", bounds=(0, 100), splits=8
    )
    assert options["dbtable"] == "(select 1) source_query"
    assert (options["fetchsize"], options["partitionColumn"], options["numPartitions"]) == ("500", "id", "8")
    assert jdbc.jdbc_options(config, table="t")["dbtable"] == "t"
    with pytest.raises(ValueError, match="query or table"):
        jdbc.jdbc_options(config)
    with pytest.raises(ValueError, match="bounds"):
        jdbc.jdbc_options(config, table="t", split_on="id")
    with pytest.raises(ValueError, match="unsupported"):
        jdbc.jdbc_url({"type": "oracle"})


def test_scan_limit_and_parameters(spark, namespace):
    spark.range(10).write.saveAsTable(f"{namespace}.numbers")
    assert tables.scan(spark, f"{namespace}.numbers", limit=3).count() == 3
    query = f"select id from {namespace}.numbers where id > :low"
    found = tables.scan(spark, "numbers", query=query, args={"low": 7})
    assert rows(found) == [(8,), (9,)]
    # A value cannot change the statement.
    text = tables.scan(spark, "numbers", query="select :t as t", args={"t": "1 or 1=1"})
    assert rows(text) == [("1 or 1=1",)]


def test_views_follow_tables(spark, namespace):
    spark.range(2).write.saveAsTable(f"{namespace}.a")
    assert tables.reflect_views(spark, namespace, "v_") == ["v_a"]
    spark.range(3).write.saveAsTable(f"{namespace}.b")
    assert tables.reflect_views(spark, namespace, "v_") == ["v_a", "v_b"]
    assert spark.table("v_b").count() == 3


def test_schema_of_a_query_runs_nothing(spark):
    schema = tables.schema_of(spark, "select 1 as a, raise_error('never') as b")
    assert schema.names == ["a", "b"]


def test_series_and_samples(spark):
    patients = generated.local_patients(generated.series(spark, 1000))
    first = patients.orderBy(F.length("patient_id"), "patient_id").first()
    assert tuple(first) == ("P1", "Cold", 21, "Female", "Negative")
    assert patients.agg(F.min("age"), F.max("age")).first()[:] == (20, 69)
    now = dt.datetime(2024, 2, 10)
    sample = generated.sample_patients(spark.range(500), 42, now)
    assert rows(sample) == rows(generated.sample_patients(spark.range(500).repartition(3), 42, now))
    ages = sample.select(F.get_json_object("demographics", "$.age").cast("int").alias("a"))
    low, high = ages.agg(F.min("a"), F.max("a")).first()
    assert 18 <= low < high <= 79
    assert sample.filter((F.col("recorded_at") > now) | (F.col("recorded_at") <= now - dt.timedelta(days=30))).count() == 0


def test_values_in_batches(spark, namespace):
    spark.sql(f"CREATE TABLE {namespace}.v (id INT, t STRING) USING parquet")
    data = [(i, f"t{i}") for i in range(25)]
    assert generated.insert_values(spark, f"{namespace}.v", data, "id int, t string") == 3
    assert rows(spark.table(f"{namespace}.v")) == sorted(data, key=repr)


def test_seed_replaces(spark, namespace, write):
    path = write("seed.csv", "source_name,refresh_interval\nrev,1h\n")
    for _ in range(2):
        seeded = tables.seed(spark, path, "source_name string, refresh_interval string", f"{namespace}.seeds")
    assert rows(seeded) == [("rev", "1h")]


def test_types_come_from_all_rows(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(500)) + "word,7\n")
    assert files.csv_schema(spark, str(path)) == {"a": "string", "b": "bigint"}
