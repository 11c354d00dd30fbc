"""Files of a report, byte for byte."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from corpusmill.plans import catalogue, catalogue_reports
from corpusmill.sources import report

SF = "/root/testdata/sf0.001"


def test_bytes_of_a_report(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    rows = spark.createDataFrame([(2, "=SUM(A1)", "x;y"), (10, 'say "no"', "a\r\nb"), (1, None, "é"), (3, "-7", "plain")], "n long, a string, b string").repartition(3)
    table = lambda name: report.lines(rows, name, {"Numéro": F.col("n"), "A": F.col("a"), "B;b": F.col("b")}, [F.col("n")])
    report.write(table("second").union(report.lines(rows.limit(0), "empty", {"X": F.col("n")}, [F.col("n")])), path)
    report.write(table("first").union(report.lines(rows.limit(0), "empty", {"X": F.col("n")}, [F.col("n")])), path)
    want = "﻿Numéro;A;\"B;b\"\r\n1;;é\r\n2;'=SUM(A1);\"x;y\"\r\n3;'-7;plain\r\n10;\"say \"\"no\"\"\";\"a\r\nb\"\r\n"
    assert (tmp_path / "report" / "first.csv").read_bytes() == want.encode()
    assert (tmp_path / "report" / "empty.csv").read_bytes() == "﻿X\r\n".encode()
    assert sorted(p.name for p in (tmp_path / "report").iterdir()) == ["empty.csv", "first.csv"]


def test_parts_of_a_large_table_are_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("(id * 7919) % 3000 AS n")
    report.write(report.lines(rows, "t", {"n": F.col("n")}, [F.col("n")]).union(report.lines(rows, "u", {"n": -F.col("n")}, [-F.col("n")])), f"file://{tmp_path}/r")
    read = lambda name: list(csv.reader(io.StringIO((tmp_path / "r" / name).read_bytes().decode("utf-8-sig"), newline=""), delimiter=";"))
    assert read("t.csv") == [["n"], *[[str(i)] for i in range(3000)]]
    assert [x.lstrip("'") for (x,) in read("u.csv")[1:]] == [str(-i) for i in range(2999, -1, -1)]


def test_a_failed_write_leaves_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n long, a string")
    report.write(report.lines(rows, "t", {"a": F.col("a")}, [F.col("n")]), path)
    broken = report.lines(rows, "t", {"a": F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("a"))}, [F.col("n")])
    with pytest.raises(Exception, match="lost"):
        report.write(broken, path)
    assert (tmp_path / "report" / "t.csv").read_bytes() == b"\xef\xbb\xbfa\r\na\r\nb\r\n"
    assert [p.name for p in (tmp_path / "report").iterdir()] == ["t.csv"]


def test_report_of_the_tables(spark, tmp_path):
    """What is read back from the files is what the query gives."""
    report.write(catalogue_reports.report(spark, SF), f"file://{tmp_path}/r")
    files = {p.name: p.read_bytes().decode("utf-8-sig") for p in (tmp_path / "r").iterdir()}
    assert sorted(files) == sorted(f"{n}.csv" for n in catalogue_reports.TABLES) and len(files) == 8
    want = {}
    for r in catalogue.QUERIES["report_tables"](spark, SF).collect():
        want.setdefault(f"{r.name}.csv", []).append(r.line)
    for name, text in files.items():
        assert sorted(text.split("\r\n")[:-1]) == sorted(want[name]), name
    places = [int(x.split(";")[0]) for x in files["alerts.csv"].split("\r\n")[1:-1]]
    assert places == sorted(places) and places
