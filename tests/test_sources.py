from __future__ import annotations

import csv
import io
import random
import zipfile
from datetime import datetime

import pytest

from tidegauge import sources
from tidegauge.api import OnlineSeries
from tidegauge.functions import timeconv
from tidegauge.sources import readers


def test_text_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# made by hand\n# twice\nTime\tflow\n02-01-13 00:00\t3\n")
    (tmp_path / "a.txt").write_text("# made by hand\nTime\tflow\n01-01-13 00:00\t1,5\n01-01-13 00:05\tBad\n")
    (tmp_path / "c.csv").write_text("Time;tss\n03-01-13 00:00;4\n")
    found = sources.list_files(spark, str(tmp_path), "text")
    assert [f.rpartition("/")[2] for f in found] == ["a.txt", "b.txt"] and sources.header_length(spark, found[1]) == 2
    with pytest.raises(ValueError):
        sources.list_files(spark, str(tmp_path), "pdf")
    rows = sources.join_files(spark, found, decimal=",").orderBy("source_file", "source_line").collect()
    assert [r.flow for r in rows] == ["1.5", "Bad", "3"]
    other = sources.read_text(spark, str(tmp_path / "c.csv"), "csv", ";", schema="Time string, tss double")
    assert other.first().tss == 4
    sources.find_and_replace(spark, found[0], str(tmp_path / "out"), ("Bad", "NaN"))
    assert "NaN" in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    with pytest.raises(NotImplementedError):
        sources.read_mat(spark, "x.mat")


def test_widths_and_comments(spark, tmp_path):
    """Short lines stay, longer ones go; comment lines are left out at a file's top alone."""
    (tmp_path / "a.csv").write_text("# top\na,b,c\n1,2,3\n2,5\n\n# 4\n3,7,8,9\n4,\"x,y\",1\n")
    got = sources.read_text(spark, str(tmp_path / "a.csv"), "csv").collect()
    assert sorted(map(tuple, got), key=str) == [("# 4", None, None), ("1", "2", "3"), ("2", "5", None), ("4", "x,y", "1")]
    (tmp_path / "b.csv").write_text("# another top\na,b,c\n7,8,9\n")
    both = sources.join_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "csv")
    assert both.where("source_file = 'b.csv'").select("a", "b", "c").collect() == [("7", "8", "9")] and both.count() == 5
    (tmp_path / "l.csv").write_bytes("naïve;é\n1;2\n2\n1;2;3\n".encode("latin-1"))
    latin = sources.read_text(spark, str(tmp_path / "l.csv"), "csv", ";", encoding="ISO-8859-1")
    assert latin.columns == ["naïve", "é"] and sorted(map(tuple, latin.collect()), key=str) == [("1", "2"), ("2", None)]
    (tmp_path / "n.csv").write_text("1,2\n3,4\n")
    assert sources.read_text(spark, str(tmp_path / "n.csv"), "csv", header=False, schema="x int, y int").agg({"x": "sum"}).first()[0] == 4
    (tmp_path / "e.txt").write_text("t\tv\n1\t2\n2\t\n")
    sources.remove_empty_lines(str(tmp_path), "text", str(tmp_path / "out"), spark)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "e.txt")).count() == 1


def test_headers_and_comments_by_place(spark, tmp_path):
    """A line like the header or a leading comment is data unless it is in their place."""
    (tmp_path / "a.csv").write_text("a,b\n1,2\na,b\n3,4\n")
    (tmp_path / "b.csv").write_text("# c\n\n#d\na,b\n# c\n3,4\n# c\n")
    read = lambda *names: sorted(map(tuple, sources.read_text(spark, [str(tmp_path / n) for n in names], "csv").collect()), key=str)
    assert read("a.csv") == [("1", "2"), ("3", "4"), ("a", "b")]
    assert read("b.csv") == [("# c", None), ("# c", None), ("3", "4")]
    assert read("a.csv", "b.csv") == sorted(read("a.csv") + read("b.csv"), key=str)


def test_quotes_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('\ufeff"a\nx",b\n1,"x\ny"\r\n"p ""q"", r",4\n5" pipe,6\n"",7\n'.encode())
    got = sources.read_text(spark, str(tmp_path / "q.csv"), "csv")
    assert got.columns == ["a\nx", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "x\ny"), ('5" pipe', "6"), ('p "q", r', "4"), (None, "7")]
    (tmp_path / "w.csv").write_bytes("k;v\n1;é\n".encode("utf-16"))
    assert sources.read_text(spark, str(tmp_path / "w.csv"), "csv", ";", encoding="UTF-16").first() == ("1", "é")
    (tmp_path / "none.csv").write_text("")
    assert sources.read_text(spark, str(tmp_path / "none.csv"), "csv").count() == 0


def test_records_over_splits(spark, tmp_path):
    """Files in many splits that cut quoted values anywhere, one value over several of them."""
    rng, rows = random.Random(1), []
    for i in range(300):
        rows.append((str(i), "".join(rng.choice(["a", "b", "\n", " ", '"', ",", "\n\n", 'x"y']) for _ in range(rng.randrange(60)))))
    rows += [("k", "v"), ("long", "\n".join(f"line {i}" for i in range(100)))]
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator=end).writerows([("k", "v"), *rows])
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "50"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        files = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
        assert readers.records(spark, files).rdd.getNumPartitions() > 50
        got = sources.read_text(spark, files, "csv").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = [(k, v or None) for k, v in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want * 2, key=str)


def workbook(sheets: dict[str, list[str]], strings=(), formats=(), extra="") -> bytes:
    """A workbook by hand: sheets' rows are given as XML."""
    main, out = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}">{extra}<sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        if formats:
            own = "".join(f'<numFmt numFmtId="{200 + i}" formatCode="{f}"/>' for i, f in enumerate(formats))
            xfs = '<xf numFmtId="0"/><xf numFmtId="14"/>' + "".join(f'<xf numFmtId="{200 + i}"/>' for i in range(len(formats)))
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{own}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>')
    return out.getvalue()


def test_excel(spark, tmp_path):
    """Shared and inline texts, gaps, truth values, errors, dates by format, sheets by place and name, several files."""
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>flow</t></is></c><c r="D1" t="s"><v>1</v></c></row>'
    rows = [head, '<row r="2"><c r="A2" s="1"><v>45292.5</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="s"><v>2</v></c></row>', '<row r="3"/>', '<row r="5"><c r="B5" t="e"><v>#N/A</v></c><c r="D5" s="2"><v>0.25</v></c><c r="E5"><v>9</v></c></row>', '<row><c s="3"><v>7</v></c></row>']
    strings = ["<t>Time</t>", "<t>flow</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>x</t></rPh>"]
    (tmp_path / "a.xlsx").write_bytes(workbook({"one": rows, "other": ["<row><c><v>1</v></c></row>", "<row><c><v>2</v></c></row>"]}, strings, ["hh:mm", "0.0 &quot;days&quot;"]))
    got = sources.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["Time", "flow1", "_c2", "flow3"]
    assert [tuple(r) for r in got.collect()] == [("2024-01-01 12:00:00", "1.5", "TRUE", "two runs"), (None, None, None, "1899-12-30 06:00:00"), ("7", None, None, None)]
    assert sources.read_excel(spark, str(tmp_path / "a.xlsx"), "other").collect() == [("2",)]
    (tmp_path / "b.xlsx").write_bytes(workbook({"s": [head, '<row r="2"><c r="A2" s="1"><v>0</v></c><c r="B2"><v>4</v></c></row>']}, strings, ["x"], '<workbookPr date1904="1"/>'))
    both = sources.read_excel(spark, [str(tmp_path / n) for n in ("b.xlsx", "a.xlsx")], schema="t timestamp_ntz, f double")
    assert both.where("f = 4").first().t == datetime(1904, 1, 1) and both.count() == 4
    with pytest.raises(NotImplementedError):
        sources.read_excel(spark, str(tmp_path / "a.xls"))


def test_ends_inside():
    assert not readers.ends_inside('a,"b",c', ",") and readers.ends_inside('a,"b', ",") and not readers.ends_inside('a,b"c', ",")
    assert readers.ends_inside('"a""', ",") and not readers.ends_inside('"a"b"', ",") and not readers.ends_inside('x",y', ",", True) and readers.ends_inside('x","y', ",", True)


def test_model_output(spark, tmp_path):
    (tmp_path / "model.txt").write_text("#.t\t.sewer_1.COD\nd\tg/m3\n0.0\t1.5\n0.5\t2.5\n")
    got = sources.read_model_output(spark, str(tmp_path / "model.txt"))
    assert sorted(map(tuple, got.collect())) == [(0.0, 1.5), (0.5, 2.5)]


def test_sinks(spark, tmp_path):
    s = OnlineSeries.wrap(spark.createDataFrame([(1.0, 5.0), (0.0, None), (2.0, 90.0)], "time double, v double")).tag_extremes("v", limit=50, method="above")
    s.write_series(str(tmp_path / "f"), "filtered", single_file=True)
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "f")).collect()
    assert [(r.time, r.v) for r in back] == [("0.0", None), ("1.0", "5.0"), ("2.0", None)]
    s.write_west(str(tmp_path / "w"), ["g/m3"], single_file=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert lines == ["#.t\tv", "#d\tg/m3", "0.0\t0.0", "1.0\t5.0", "2.0\t90.0"]
    s.write_west(str(tmp_path / "w2"), ["g/m3"])
    parts = sorted(p for p in (tmp_path / "w2").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).splitlines() == lines
    assert [tuple(r) for r in s.to_west({"v": ("Q", "m3")}).orderBy("ord", "#t").collect()][:2] == [(0, "#d", "m3"), (1, "0.0", None)]
    sources.log_removed(str(tmp_path / "log"), 5, 3, "filter")
    assert (tmp_path / "log").read_text() == "filter: 5 rows before, 3 after, 2 removed\n"
    with pytest.raises(ValueError):
        s.write_series(str(tmp_path / "g"), "some")


def test_drop_incomplete(spark):
    assert sources.remove_empty_lines(spark.createDataFrame([(1, None), (2, 3)], "a int, b int")).count() == 1


def test_patterns():
    assert timeconv.pattern("%d-%m-%y %H:%M") == "dd-MM-yy HH:mm" and timeconv.pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        timeconv.pattern("%d-%Q")
