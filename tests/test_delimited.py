"""Delimited files read in parts, against the csv module."""

import csv
import io
import random

import pytest

from skarn.operators import delimited

CELLS = ["", "a", "b c", 'say "hi"', "two\nlines", "x;y", "x,y", '"', '""', "\n", "İstanbul", " spaced  out ", "5\" pipe", "end\r\nline", "1,5"]


def made(n, d, seed):
    """A file's text: some fields quoted as a writer does, some with a stray quote, blank lines among them."""
    r, out = random.Random(seed), io.StringIO()
    w = csv.writer(out, delimiter=d, lineterminator=r.choice(("\n", "\r\n")))
    w.writerow(["Key", "Value", "Note"])
    for i in range(n):
        if r.random() < 0.03:
            out.write("\n")
        elif r.random() < 0.05:
            out.write(f'{i}{d}pipe of 5" width{d}"quoted" tail\n')
        else:
            w.writerow([i, *(r.choice(CELLS) for _ in range(r.choice((2, 2, 2, 5))))])
    return out.getvalue()


def plain(text, d):
    return [[" ".join(v.split()) for v in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=d)]


@pytest.mark.parametrize("size", [37, 200, 5000, 1 << 20])
def test_cuts_anywhere(spark, tmp_path, size):
    texts = {f"f{i}.csv": (made(60 * (i + 1), d, i), d) for i, d in enumerate((";", ",", "\t"))}
    texts["open.csv"] = ('a,b\n1,"never closed\nand on\n', ",")
    texts["none.csv"] = ("", ",")
    for name, (text, _) in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(size))
    try:
        got = {}
        for r in delimited.rows(spark, str(tmp_path)).collect():
            got.setdefault(r["path"].rsplit("/", 1)[-1], {})[r["row_no"]] = r["values"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == set(texts) - {"none.csv"}
    for name, rows in got.items():
        want = plain(*texts[name])
        assert [rows[i] for i in sorted(rows)] == want and sorted(rows) == list(range(1, len(want) + 1))


def test_lines_stay_where_they_are(spark, tmp_path):
    """Only rows that a cut goes through are shuffled, whatever the settings are when the rows are read."""
    (tmp_path / "f.csv").write_bytes(made(3000, ";", 5).encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, "4096")
    try:
        rows = delimited.rows(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange") <= 1
    want = plain(made(3000, ";", 5), ";")
    assert [r["values"] for r in rows.orderBy("row_no").collect()] == want


def test_values_do_not_depend_on_who_reads_them(spark, tmp_path):
    """Rows with a lone carriage return, which the csv module refuses, and the white space of others."""
    (tmp_path / "f.csv").write_bytes("\ufeffa,b\n1\r2,x\n\x1c,\u2003y\u00a0\n\r\r\n\"p\"q,\"r\"\"\"\r\n".encode())
    got = [r["values"] for r in delimited.rows(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [["a", "b"], ["1 2", "x"], ["\x1c", "y"], [], ["pq", 'r"']]


def test_not_utf8_is_said(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes("a;ş\n".encode("cp1254"))
    with pytest.raises(Exception, match="is not UTF-8"):
        delimited.rows(spark, str(tmp_path)).collect()
