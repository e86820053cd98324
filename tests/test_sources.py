import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import PlanError, Table
from millrace.sources import infer, readers, writers
from millrace.streaming import events

ROW = {"id": "int", "name": "string", "score": "float?", "day": "date?"}


@pytest.fixture
def table(spark):
    rows = [(1, 'quote " and, comma', 1.5, dt.date(2024, 1, 2)), (2, "", None, None), (3, "ไทย|é", -0.25, dt.date(1999, 12, 31))]
    return Table.from_rows(spark, [dict(zip(ROW, r, strict=True)) for r in rows], "id bigint, name string, score double, day date")


def test_round_trips(spark, table, tmp_path):
    want = table.to_rows()
    writers.write_csv(table, str(tmp_path / "t.csv"))
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), ROW).sort("id").to_rows() == want
    writers.write_parquet(table, str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), ROW).sort("id").to_rows() == want
    writers.write_orc(table, str(tmp_path / "o"))
    assert readers.read_orc(spark, str(tmp_path / "o"), ROW).sort("id").to_rows() == want
    writers.write_json(table, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j"), ROW).sort("id").to_rows() == want
    writers.write_sql(table, str(tmp_path / "d.db"), "people")
    writers.write_sql(table, str(tmp_path / "d.db"), "people")
    assert readers.read_sql(spark, str(tmp_path / "d.db"), "SELECT * FROM people ORDER BY id", ROW).sort("id").to_rows() == want
    writers.write_excel(table, str(tmp_path / "b.xlsx"), "Sheet One")
    got = readers.read_excel(spark, str(tmp_path / "b.xlsx"), {"id": "int", "name": "string?", "score": "float?", "day": "date?"}, sheet="Sheet One").sort("id").to_rows()
    assert [r["score"] for r in got] == [1.5, None, -0.25] and got[0]["day"] == dt.date(2024, 1, 2) and got[2]["name"] == "ไทย|é"


def test_csv_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("report\nmade today\nid;extra;units\n1;x;5\n2;y;NA\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), {"units": "int?", "id": "int"}, delimiter=";", skip=2, nulls=["NA"]).sort("id").to_rows()
    assert rows == [{"units": 5, "id": 1}, {"units": None, "id": 2}]
    (tmp_path / "b.csv").write_text("1,a\n2,b\n")
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), {"id": "int", "name": "string"}, header=False).sort("id").to_rows()[1] == {"id": 2, "name": "b"}
    (tmp_path / "l.csv").write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "l.csv"), {"id": "int", "name": "string"}, encoding="ISO-8859-1").to_rows()[0]["name"] == "café"


def test_strict_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,x\n2,\n")
    with pytest.raises(Exception, match="missing value|CAST"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), {"id": "int", "n": "int"}).to_rows()
    with pytest.raises(PlanError, match="no column"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), {"other": "int"})
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none*.csv"), {"id": "int"})


def test_globs_and_json_arrays(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"log{i}.csv").write_text(f"hits\n{i}\n")
    rows = readers.read_csv(spark, str(tmp_path / "log*.csv"), {"hits": "int"}, file_name="file").sort("hits").to_rows()
    assert [r["hits"] for r in rows] == [1, 2] and rows[0]["file"].endswith("log1.csv")
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "tags": [1]}, {"id": 2, "name": 'x"y'}]))
    assert [r["name"] for r in readers.read_json(spark, str(tmp_path / "a.json"), {"id": "int", "name": "string?"}).sort("id").to_rows()] == [None, 'x"y']


def test_inference(spark, table, tmp_path):
    writers.write_csv(table, str(tmp_path / "t.csv"), delimiter=";")
    row, delimiter = infer.infer_csv(str(tmp_path / "t.csv"))
    assert delimiter == ";" and row == {"id": "int", "name": "string?", "score": "float?", "day": "date?"}
    assert infer.kind_of(["007", "12"]) == "string" and infer.kind_of(["true", ""]) == "bool?"
    writers.write_parquet(table, str(tmp_path / "p"))
    assert infer.infer_parquet(spark, str(tmp_path / "p"))["day"] == "date?"


def test_reports(table, tmp_path):
    assert writers.to_markdown(table).splitlines()[1] == "| ---: | --- | ---: | --- |"
    assert "ไทย\\|é" in writers.to_markdown(table) and "&quot;" in writers.to_html(table)
    shown = writers.to_text(table, rows=2)
    assert "null" in shown and shown.splitlines()[-1] == "... only the first 2 rows"
    writers.write_html(table, str(tmp_path / "t.html"))
    writers.write_markdown(table, str(tmp_path / "t.md"))
    assert (tmp_path / "t.md").read_text() == writers.to_markdown(table)


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = events.bucketed(stream, "ts", "1 day", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("buckets").agg(F.sum("n")).first()[0] == source.count()
    assert events.sessions(source, "ts", "1 hour", ["user_id"]).agg(F.sum("n")).first()[0] == source.count()
    assert events.sliding(source, "ts", "2 days", "1 day", []).agg(F.sum("n")).first()[0] == 2 * source.count()
