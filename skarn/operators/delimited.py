"""Delimited files of any size: a file is read in as many parts as Spark cuts it into, wherever the cuts fall.

Lines come from Spark's text reader with the part they stand in, in their order. Whether a line begins inside quotes
depends on all lines before it, but each line can only do one of four things to that: leave it, turn it round, or end
outside or inside whatever it was before. A first pass tells for each part how it ends and how many rows begin in it,
whichever way it begins itself; a small table of parts then tells how each does begin, and a second pass puts its lines
together. No line is shuffled or sorted but those of rows that a cut goes through.

Quotes count as the csv module counts them: at the start of a field, doubled inside, and anything after the closing one
belongs to the field. White space in values is collapsed. The delimiter is sniffed from a file's first lines. Defined
results: an empty file has no rows; blank lines are rows without a value; a file that ends inside quotes ends its last
row there; lone carriage returns end no line; a file that is not UTF-8 raises (such files go by `tabular.csv_rows`)."""

from __future__ import annotations

import csv

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions.text import SPACES, collapse
from skarn.operators.tabular import DELIMITERS, SNIFF_LINES
from skarn.runtime import ship, written


def _patterns(d: str) -> tuple[str, str, str]:
    """For a delimiter: lines that end inside quotes if they begin outside, and if they begin inside; a field behind one."""
    d = rf"\x{ord(d):02x}"
    quoted, rest = r'(?:[^"]++|"")*+', f"[^{d}]*+"
    # Of a line that begins outside: whole fields, then one whose quotes do not close.
    fields = f'(?:(?:"{quoted}"(?!"){rest}|[^"{d}]{rest}|){d})*+'
    opened = f'{fields}"{quoted}$'
    return f"(?s)^{opened}", f'(?s)^{quoted}(?:$|"(?!"){rest}{d}{opened})', f'(?s){d}(?:"{quoted}"?{rest}|[^"{d}]{rest}|)'


def _by_delimiter(make) -> Column:
    out = None
    for d in DELIMITERS:
        own = make(d)
        out = F.when(F.col("delimiter") == d, own) if out is None else out.when(F.col("delimiter") == d, own)
    return out


def _values(row: Column) -> Column:
    """The fields of a whole row, unquoted, white space collapsed."""

    def one(d: str) -> Column:
        cut = F.regexp_extract_all(F.concat(F.lit(d), row), F.lit(_patterns(d)[2]), F.lit(0))
        inner = lambda f: F.when(f.startswith('"'), F.concat(F.replace(F.regexp_extract(f, r'(?s)^"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1))).otherwise(f)
        return F.transform(cut, lambda f: collapse(inner(F.substring(f, 2, 2_000_000_000))))

    return F.when(row == "", F.expr("cast(array() as array<string>)")).otherwise(_by_delimiter(one))


def _sniffed(heads: DataFrame) -> DataFrame:
    """(path, delimiter) from the first lines of each file; a comma where nothing can be told."""

    def run(rows):
        import pandas as pd

        lines = rows.sort_values("id")["line"].tolist()
        try:
            d = csv.Sniffer().sniff("\n".join(lines), delimiters=DELIMITERS).delimiter
        except csv.Error:
            d = ","
        return pd.DataFrame({"path": rows["path"][:1], "delimiter": [d]})

    return heads.groupBy("path").applyInPandas(run, "path string, delimiter string")


def _before(begins: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Whether each line begins inside quotes (1) or not (0), and whether the next one after them does.

    a and b: how a line ends that begins outside or inside."""
    turned = np.concatenate([[0], np.cumsum(a & ~b)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(a == b, np.arange(1, len(a) + 1), 0)]))
    # Since the last line that decides, what it says is turned round as often as lines do that.
    said = np.concatenate([[begins], a])[last]
    state = said ^ ((turned - turned[last]) & 1)
    return state[:-1], int(state[-1])


def _runs(batch):
    """(file, part, rows from, to) of an Arrow batch, in order."""
    file, part = (np.asarray(batch.column(i)) for i in (0, 1))
    cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(file)]
    return [(int(file[x]), int(part[x]), x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def _ends(it):
    """For each part, by how it begins: how it ends, and the rows that begin in it."""
    import pyarrow as pa

    names = ("file", "part", "end0", "end1", "rows0", "rows1")
    at, now = None, None
    for batch in it:
        done = []
        a, b = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3))
        for file, part, x, y in _runs(batch):
            if (file, part) != at:
                done += [now] if now else []
                at, now = (file, part), [file, part, 0, 1, 0, 0]
            for k in (0, 1):
                state, now[2 + k] = _before(now[2 + k], a[x:y], b[x:y])
                now[4 + k] += int((state == 0).sum())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in now], names=names)


def _chained(parts):
    """How each part of a file begins, and the rows that begin before it."""
    parts = parts.sort_values("part")
    begins, earlier, state, n = [], [], 0, 0
    for ends, rows_ in zip(parts[["end0", "end1"]].to_numpy(), parts[["rows0", "rows1"]].to_numpy(), strict=True):
        begins.append(state)
        earlier.append(n)
        state, n = int(ends[state]), n + int(rows_[state])
    return parts[["file", "part"]].assign(begins=begins, earlier=earlier)


def _together(it):
    """Rows of the lines of each part; whole: all of the row stands in it. Of others, the pieces have the row's number. Rows
    that the csv module can read have their values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    csv.field_size_limit(1 << 31)

    def fields(texts):
        """Values of whole rows; null where a carriage return is left, which the csv module takes for the end of a line."""
        texts = pc.utf8_rtrim(texts, "\r")
        plain = pc.invert(pc.match_substring(texts, "\r"))
        found = list(csv.reader(texts.filter(plain).to_pylist(), delimiter=delimiter))
        size = np.zeros(len(texts) + 1, np.int64)
        size[1:][np.asarray(plain)] = [len(x) for x in found]
        flat = pa.array([v for x in found for v in x], pa.string())
        flat = pc.utf8_trim(pc.replace_substring_regex(flat, f"[{SPACES}]+", " "), " ")
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), flat, mask=pc.invert(plain))

    def made(file, part, numbers, texts, whole):
        n = len(texts)
        values = fields(texts) if whole else pa.nulls(n, pa.list_(pa.string()))
        texts = pc.if_else(pc.is_null(values), texts, pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(np.full(n, part)), pa.array(numbers), texts, pa.array(np.full(n, whole)), values], names=["file", "part", "row_no", "row", "whole", "values"])

    def rest():
        # What is left of a part may go on in the next one.
        return made(*at, np.array([number]), pa.array(["\n".join(held)], pa.string()), False)

    at, state, number, held, first = None, 0, 0, [], True
    for batch in it:
        a, b, begins, earlier = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3, 4, 5))
        lines, delimiters = batch.column(6), batch.column(7)
        for file, part, x, y in _runs(batch):
            if (file, part) != at:
                if held:
                    yield rest()
                delimiter = delimiters[x].as_py()
                at, state, number, held, first = (file, part), int(begins[x]), int(earlier[x]), [], True
            before, state = _before(state, a[x:y], b[x:y])
            begun = np.flatnonzero(before == 0)
            own = lines.slice(x, y - x)
            upto = int(begun[0]) if len(begun) else y - x
            held += own.slice(0, upto).to_pylist()
            if not len(begun):
                continue
            if held:
                # A part's first piece belongs to a row before it unless the part began that row.
                yield made(file, part, np.array([number]), pa.array(["\n".join(held)], pa.string()), not first)
            number += 1
            if len(begun) > 1:
                offsets = pa.array((begun - begun[0]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, own.slice(int(begun[0]), int(begun[-1] - begun[0])))
                yield made(file, part, number + np.arange(len(begun) - 1), pc.binary_join(lists, "\n"), True)
                number += len(begun) - 1
            held, first = own.slice(int(begun[-1])).to_pylist(), False
    if held:
        yield rest()


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, values) of all delimited files at a path, row numbers from 1 by file."""
    ship(spark)
    # Both passes read the same parts, whose lines come in order, each part in one task.
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))
    mark = "\ufeff"
    lines = lines.withColumn("line", F.when(~F.is_valid_utf8("line"), F.raise_error(F.concat(F.col("path"), F.lit(" is not UTF-8"))).cast("string")).when(F.col("line").startswith(mark), F.substring("line", 2, 2_000_000_000)).otherwise(F.col("line")))
    head = lines.where("part = 0").withColumn("id", F.monotonically_increasing_id())
    head = head.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("id"))).where(F.col("n") <= SNIFF_LINES)
    # Once written, the numbers of files stay.
    files = F.broadcast(written(_sniffed(head).withColumn("file", F.monotonically_increasing_id()), "files"))
    lines = lines.join(files, "path")
    # Only quotes change anything.
    quote = F.contains("line", F.lit('"'))
    a, b = (F.when(quote, _by_delimiter(lambda d, k=k: F.regexp_like("line", F.lit(_patterns(d)[k])))).otherwise(F.lit(bool(k))) for k in (0, 1))
    lines = lines.select("file", "part", a.cast("byte").alias("a"), b.cast("byte").alias("b"), "line", "delimiter")
    ends = lines.select("file", "part", "a", "b").mapInArrow(_ends, "file long, part long, end0 long, end1 long, rows0 long, rows1 long")
    # A row for each part: a few bytes for what one task reads.
    parts = F.broadcast(written(ends.groupBy("file").applyInPandas(_chained, "file long, part long, begins long, earlier long"), "parts"))
    lines = lines.join(parts, ["file", "part"]).select("file", "part", "a", "b", "begins", "earlier", "line", "delimiter")
    cut = lines.mapInArrow(_together, "file long, part long, row_no long, row string, whole boolean, values array<string>").join(files, "file")
    values = lambda: _values(F.rtrim(F.col("row"), F.lit("\r")))
    cut = written(cut.select("path", "part", "row_no", "delimiter", F.when(F.col("whole"), F.coalesce("values", values())).alias("values"), F.when(~F.col("whole"), F.col("row")).alias("row")), "cut")
    pieces = cut.where("row is not null").groupBy("path", "row_no", "delimiter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "row"))), lambda x: x["row"]), "\n").alias("row"))
    return cut.where("row is null").select("path", "row_no", "values").unionByName(pieces.select("path", "row_no", values().alias("values")))
