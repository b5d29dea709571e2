"""Sources, routes, the report and the registered queries."""

import json
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe import registry
from tallyframe.plans.policies import BINARY, REGRESSION
from tallyframe.plans.report import executive_report
from tallyframe.plans.routes import analyze, execute
from tallyframe.sources import tables
from tallyframe.streaming.running import running_statistics

SF = "/root/testdata/sf0.001"


def test_delimited_text(spark, tmp_path):
    text = '﻿a;b;a;;c\r\n 1 ;"x; ""y""";3;4;5\r\n\r\n;;;;\r\n"two\nlines";q\r\n1;2;3;4;5;6\r\n'
    assert tables.detect_delimiter(text) == ";" and tables.detect_delimiter("abc") == "," and tables.detect_delimiter("\n\na\tb") == "\t"
    assert tables.normal_headers(["A", "A", "A_2", "", "A"]) == ["A", "A_2", "A_2_2", "Variable_4", "A_3"]
    want = [("1", 'x; "y"', "3", "4", "5"), ("two\nlines", "q", None, None, None), ("1", "2", "3", "4", "5")]
    pasted = tables.from_text(spark, text)
    assert pasted.columns == ["a", "b", "a_2", "Variable_4", "c"] and [tuple(r) for r in pasted.collect()] == want
    (tmp_path / "x.csv").write_bytes(text.encode())
    read = tables.read_delimited(spark, str(tmp_path / "x.csv"))
    assert read.columns == pasted.columns and [tuple(r) for r in read.collect()] == want
    with pytest.raises(ValueError):
        tables.from_rows(spark, [["only"]])


def test_upload_and_sink(spark, tmp_path):
    (tmp_path / "u.csv").write_text("x,y\n1,a\nNA,NULL\n2.5,b\n")
    df = tables.read_upload(spark, str(tmp_path / "u.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string"] and [tuple(r) for r in df.collect()] == [(1.0, "a"), (None, None), (2.5, "b")]
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_upload(spark, str(tmp_path / "out")).count() >= 2


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>n</t></si><si><t>ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4</v></c></row></sheetData></worksheet>')
    df = tables.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["name", "n"] and tuple(df.first()) == ("ann", "4")


def test_reports():
    found = executive_report({"route": "segmentation", "status": "COMPLETE", "method": {"algorithm": "KMeans"}, "evidence": {"silhouette": 0.3, "pca_variance": 0.91, "nested": {}}, "findings": {"0": {"high": ["A"], "low": ["B"], "size_pct": 60.0}}, "warnings": ["w"]})
    assert found["findings"][0]["title"] == "Segment 1" and found["findings"][0]["subtitle"] == "60.0% of observations"
    assert [x["label"] for x in found["evidence"]] == ["Silhouette", "Variance retained"] and found["evidence"][1]["value"] == "91.0%"
    assert "WARNINGS / GUARDRAILS" in found["text"] and "Higher: A" in found["text"]
    listed = executive_report({"route": "association", "evidence": {"tests_run": 10}, "findings": [{"relationship": "A ↔ B", "effect": 0.8}] * 12})
    assert len(listed["findings"]) == 10 and listed["evidence"][0]["label"] == "Tests run" and listed["overview"][1]["value"] == "Not applicable"


def test_unsupervised_routes(spark):
    part = tables.table(spark, SF, "part").drop("p_partkey", "p_name")
    result, artifacts = execute(part, " EDA ")
    assert result["status"] == "COMPLETE" and result["evidence"]["association_pairs"] == artifacts["associations"].count()
    told = json.loads(analyze(part, "association analysis"))
    assert told["report"]["route"] == "association" and told["result"]["evidence"]["tests_run"] > 0
    result, _ = execute(part, "clustering")
    assert set(result["findings"]) == {"0", "1"} and result["evidence"]["pca_dimensions"] >= 1


def test_supervised_routes(spark):
    rows = spark.createDataFrame([(float(i), "ab"[i % 2], float(i % 5), int(i % 40 > 19)) for i in range(200)], "x double, c string, z double, t int")
    result, artifacts = execute(rows, "classification", "t", policy=replace(BINARY, trees=3, folds=2, inner_folds=2))
    assert result["route"] == "classification" and artifacts["oof"].count() == 200 and 0 <= result["evidence"]["roc_auc"] <= 1
    assert result["analysis_type"] == "binary" and result["readiness"] == "FAST_PARITY_VALIDATED" and result["dataset"] == {"rows": 200, "columns": 4}
    assert {"feature_engineering", "model", "calibration", "threshold_policy", "threshold", "selection_source"} <= set(result["method"])
    assert artifacts["class_mapping"] == {0: 0, 1: 1} and {"uncalibrated", "score", "prediction"} <= set(artifacts["oof"].columns)
    result, _ = execute(rows, "regression", "x", policy=replace(REGRESSION, trees=3, folds=2))
    assert result["evidence"]["mae"] > 0
    for intent, target, error in (("regression", None, ValueError), ("nothing", None, ValueError), ("binary", "missing", ValueError)):
        with pytest.raises(error):
            execute(rows, intent, target)
    with pytest.raises(NotImplementedError):
        execute(rows, "eda", mode="deep")


def test_stream_equals_batch(spark, tmp_path):
    events = tables.table(spark, SF, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{SF}/event*.parquet")
    q = running_statistics(source, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("running").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect()}
    assert got == {(r["window_start"], r["event_type"]): r["n"] for r in running_statistics(events, "ts", "event_type", "value").collect()}


@pytest.mark.parametrize("name", ["descriptives", "anova", "spearman", "chi_square_cells", "assoc_mixed", "metrics_binary"])
def test_registered_queries_run(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and name in registry.SQL
    assert df.select(*[F.count(c) for c in df.columns]).first()
