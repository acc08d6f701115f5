"""Readers, checks, writers and streams on files in a temporary folder."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkqual.operators import mdm, quality
from sparkqual.sources import readers, validate, writers
from sparkqual.streaming import arrivals, windowed


def test_csv_delimiter_and_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id;name\n1;x,y\n2;z\n")
    assert readers.find_delimiter(spark, str(path)) == ";"
    path.write_text("id,name\n1,x\n2,z\n")
    assert readers.find_delimiter(spark, str(path)) == ","
    df = readers.read_path(spark, str(path))
    assert df.dtypes == [("id", "int"), ("name", "string")]
    with pytest.raises(ValueError):
        readers.read_path(spark, "a.xlsx")


def test_json_with_root_key_is_refused(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('\n [{"a": 1}, {"a": 2}]')
    bad.write_text(json.dumps({"rows": [{"a": 1}]}))
    assert readers.read_json(spark, str(good)).count() == 2
    with pytest.raises(ValueError, match="root key"):
        readers.read_json(spark, str(bad))


def test_xml(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text("<all><row><a>1</a></row><row><a>2</a></row></all>")
    assert sorted(r["a"] for r in readers.read_path(spark, str(path)).collect()) == [1, 2]


def test_reference_registry(spark, tmp_path):
    path = tmp_path / "gender.csv"
    path.write_text("Gender,Symbol\nMale,M\nNone,F\n")
    registry = [{"name": "gender", "path": str(path)}]
    assert {r["Gender"] for r in readers.read_reference(spark, registry, "gender").collect()} == {"Male", None}
    with pytest.raises(KeyError):
        readers.read_reference(spark, registry, "other")


def test_header_checks(spark):
    assert validate.accepted_file("A.CSV") and not validate.accepted_file("a.exe")
    assert validate.header_problems(["a", "_c1"]) == ["column 2 has no name"]
    assert validate.header_problems(["b", "a"], ["a", "b"])
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert validate.upload_problems(df, ["a", "b"]) == ["column b is empty"]


def test_row_ids_are_stable_and_without_gaps(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.rand(1))
    numbered = readers.with_row_id(df)
    assert sorted(r[0] for r in numbered.select("row_id").collect()) == list(range(1000))
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, numbered.collect()))


def test_overwrite_guard(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    writers.write_csv(spark.range(2), path)
    with pytest.raises(AnalysisException):
        writers.write_csv(spark.range(2), path)
    writers.write_csv(spark.range(3), path, overwrite=True)
    assert readers.read_path(spark, path).count() == 3


def test_cache_follows_the_source(spark, tmp_path):
    source, root, runs = str(tmp_path / "src"), str(tmp_path / "cache"), []

    def compute():
        runs.append(1)
        return spark.read.parquet(source).agg(F.count(F.lit(1)).alias("n"))

    spark.range(3).write.parquet(source)
    for _ in range(2):
        assert writers.cached_result(spark, root, "count", source, compute).first()["n"] == 3
    assert len(runs) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert writers.cached_result(spark, root, "count", source, compute).first()["n"] == 5


def test_rows_to_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id int, s string")
    assert json.loads(writers.rows_to_json(df).first()["record"]) == {"id": 1, "s": None}
    assert writers.rows_to_json(df, "id").first().asDict() == {"id": 1, "record": '{"s":null}'}


def test_standardised_file_to_file(spark, tmp_path):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out.csv")
    writers.write_csv(spark.createDataFrame([(" a ",)], "s string"), source)
    rules = [{"column": "s", "rules": [{"rule": "Format", "operator": "toUpperCase"}, {"rule": "Format", "operator": "trim"}]}]
    mdm.standardise_file(spark, source, target, rules)
    assert readers.read_path(spark, target).first()["s"] == "A"


RULES = [{"column": "v", "rules": [{"rule": "Value", "value": "5", "operator": "lessthan"}]}]


def test_arriving_files_are_scored_once_each(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = spark.createDataFrame([], "id bigint, v int").schema

    def run():
        arrivals.score_arrivals(
            spark, source, schema, lambda b: quality.rule_scores(b, RULES), target, checkpoint
        ).awaitTermination()
        return {r["batch"]: (r["checked"], r["failed"]) for r in arrivals.stored_scores(spark, target).collect()}

    spark.createDataFrame([(1, 1), (2, 9)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {0: (2, 1)}
    assert run() == {0: (2, 1)}
    spark.createDataFrame([(3, 7)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {0: (2, 1), 1: (1, 1)}


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    source, target = str(tmp_path / "ev"), str(tmp_path / "win")
    events = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 9).cast("int").alias("v")
    )
    events.write.parquet(source)
    table = {r["start"]: (r["rows"], r["validity"]) for r in windowed.windowed_quality(events, "ts", RULES).collect()}
    stream = windowed.windowed_quality(spark.readStream.schema(events.schema).parquet(source), "ts", RULES)
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "ck2"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = {r["start"]: (r["rows"], r["validity"]) for r in spark.read.parquet(target).collect()}
    assert closed and closed.items() <= table.items()
    # Only the window the watermark has not passed is missing.
    assert len(table) - len(closed) == 1
