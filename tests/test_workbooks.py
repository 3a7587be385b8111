"""Workbooks: cells by kind, headers of price histories, sheets by name, files that are none."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewell.sources import files, workbooks

HEAD = list(files.RAW)
ROW = ["Shell A", "1 Main St NSW 2750", "Penrith", 2750, "Shell", "E10", dt.datetime(2020, 5, 14, 9, 30), 150.5]


def test_cells_by_kind():
    content = workbooks.workbook([["a < b & c", 1, 2.5, dt.datetime(2020, 2, 29, 23, 59, 59), None, " é "], None, [None, None, "x"]])
    assert list(workbooks.rows_of(content)) == [(1, ["a < b & c", "1", "2.5", "2020-02-29T23:59:59", None, " é "]), (3, [None, None, "x"])]
    assert list(workbooks.rows_of(content, "Other")) == []
    assert [len(c) for _, c in workbooks.rows_of(workbooks.workbook([["x"] * 30]))] == [30]


@pytest.mark.parametrize(
    ("top", "skipped"),
    [([], 1), ([HEAD], 2), ([None], 2), ([HEAD, HEAD], 3), ([[None, "note"], HEAD], 3), ([HEAD, HEAD, HEAD], 3)],
)
def test_header_rows(spark, top, skipped):
    content = workbooks.workbook([HEAD, *top, ROW, [None] * 7, ROW])
    cells = workbooks.sheet_cells(spark.createDataFrame([("f", bytearray(content))], "file string, content binary"))
    got = sorted(r.line for r in workbooks.history_rows(cells).collect())
    assert got == [n for n in (*range(2, len(top) + 2), len(top) + 2, len(top) + 4) if n > skipped and (n != 4 or len(top) != 3 or top[2] is not None)]


def test_histories_and_files_that_are_no_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook([HEAD, HEAD, ROW]))
    (tmp_path / "b.xlsx").write_bytes(b"<html>")
    (tmp_path / "c.xlsx").write_bytes(workbooks.workbook([]))
    clean = workbooks.read_history(spark, str(tmp_path), [("shell", "Shell")]).collect()
    assert [(r.name, r.fuel_code, r.postcode, r.price_date, float(r.price)) for r in clean] == [("Shell A", "E10", "2750", dt.date(2020, 5, 14), 150.5)]
    bad = workbooks.read_cells(spark, str(tmp_path)).where("line = 0").collect()
    assert [r.file.rsplit("/", 1)[1] for r in bad] == ["b.xlsx"]


def test_upstream_sheet(spark, tmp_path):
    day = dt.datetime(2020, 1, 2)
    rows = [["Average ULP", "Sydney", "Perth"], [day, 150.5, 1], ["Mean", 9, 9], [dt.datetime(2020, 1, 3), None, 2]]
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook(rows, "Petrol"))
    cells = workbooks.read_cells(spark, str(tmp_path), "Petrol")
    assert sorted(tuple(r) for r in workbooks.upstream_rows(cells).collect()) == [(dt.date(2020, 1, 2), 150.5), (dt.date(2020, 1, 3), None)]
    assert [r.tgp for r in workbooks.upstream_rows(cells, "Perth").orderBy("tgp_date").collect()] == [1.0, 2.0]
    with pytest.raises(Exception, match="Hobart"):
        workbooks.upstream_rows(cells, "Hobart").collect()
    assert workbooks.read_cells(spark, str(tmp_path), "Diesel").count() == 0
