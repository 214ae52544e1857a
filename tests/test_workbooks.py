"""Workbooks: a file written by hand, odd and broken files, and the round trip through the sink."""

import io
import zipfile

from pyspark.sql import functions as F

from quarry.sources import workbooks as W


def _book(sheets, strings=None, links=None, book=True):
    """A workbook with sheets (name, target, xml of the rows)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if book:
            z.writestr(W.BOOK, f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.RELATION}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="1" r:id="r{i}"/>' for i, (n, _, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr(W.LINKS, f'<Relationships xmlns="{W.PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, (_, t, _) in enumerate(sheets)) + "</Relationships>")
        if strings is not None:
            z.writestr(W.STRINGS, f'<sst xmlns="{W.MAIN}">{strings}</sst>')
        for _, target, xml in sheets:
            if xml is not None:
                z.writestr("xl/" + target.removeprefix("/xl/").removeprefix("xl/"), f'<worksheet xmlns="{W.MAIN}"><sheetData>{xml}</sheetData></worksheet>')
    return out.getvalue()


RICH = '<si><t>Read </t><r><t>DTC</t></r><r><t>(Type1)</t></r></si><si><t>Boot(T2)</t></si><si/>'
FIRST = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c><c r="C2" t="s"><v>9</v></c><c r="D2" t="s"><v>2</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t> Inline </t><r><t>(T3)</t></r></is></c><c r="C3"><v>42</v></c><c r="D3"/><c t="s"><v>1</v></c></row><row><c r="A9"><v>lost</v></c></row>'


def _files(spark):
    good = _book([("Main", "worksheets/sheet1.xml", FIRST), ("Second", "/xl/worksheets/other.xml", '<row r="1"><c r="B1"><v>A (b) (c)</v></c></row>'), ("Gone", "worksheets/none.xml", None)], RICH)
    rows = [("good.xlsx", good), ("noise.xlsx", b"not an archive"), ("empty.xlsx", b""), ("null.xlsx", None), ("nobook.xlsx", _book([("x", "worksheets/s.xml", FIRST)], RICH, book=False)), ("plain.xlsx", _book([("P", "xl/worksheets/p.xml", '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>one</v></c></row>')]))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_cells(spark):
    found = W.parts(_files(spark))
    got = sorted((r["path"], r["sheet"], r["row"], r["column"], r["text"]) for r in W.cells(found).collect())
    assert got == [
        ("good.xlsx", "Main", 2, 2, "Read DTC(Type1)"), ("good.xlsx", "Main", 2, 27, "Boot(T2)"), ("good.xlsx", "Main", 3, 0, "Boot(T2)"), ("good.xlsx", "Main", 3, 2, "Inline (T3)"), ("good.xlsx", "Main", 3, 3, "42"),
        ("good.xlsx", "Second", 1, 2, "A (b) (c)"), ("plain.xlsx", "P", 1, 2, "one"),
    ]
    assert {r["path"] for r in W.problems(found).collect()} == {"noise.xlsx", "empty.xlsx", "null.xlsx"}
    assert W.cells(W.parts(_files(spark).limit(0))).collect() == []


def test_steps(spark):
    cells = W.cells(W.parts(_files(spark)))
    got = [(r["step"], r["step_key"], r["column"], r["row"], r["nth"], r["name"], r["template"]) for r in W.flow_steps(cells).orderBy("step", "nth").collect()]
    assert got == [(1, "step_001", 0, 3, 1, "Boot", "T2"), (2, "step_002", 2, 1, 1, "A", "b) (c"), (2, "step_002", 2, 2, 2, "Read DTC", "Type1"), (2, "step_002", 2, 3, 3, "Inline", "T3"), (3, "step_003", 27, 2, 1, "Boot", "T2")]
    assert ("42", "") in {(r["name"], r["template"]) for r in W.flow_steps(cells, include_others=True).collect()}


def test_column_letters(spark):
    df = spark.createDataFrame([(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")], "n int, s string")
    assert all(r["n"] == r["back"] and r["s"] == r["made"] for r in df.select("n", "s", W.column_number(F.lower("s")).alias("back"), W.column_letters(F.col("n")).alias("made")).collect())


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    cells = spark.createDataFrame([("a", "S<1>", 5, 30, "x <&> (T)", "s"), ("a", "S<1>", 4, 2, "y(T)", "inlineStr"), ("a", "S2", 1, 1, "7", None)], "path string, sheet string, row int, column int, text string, kind string")
    (r,) = W.workbook_files(cells.withColumn("sheet", F.regexp_replace("sheet", "[<>]", "_"))).collect()
    (tmp_path / "deep" / "a.xlsx").write_bytes(bytes(r["content"]))
    (tmp_path / "deep" / "b.txt").write_text("no")
    got = W.cells(W.parts(W.read_files(spark, str(tmp_path)))).collect()
    assert sorted((x["sheet"], x["row"], x["column"], x["text"]) for x in got) == [("S2", 1, 1, "7"), ("S_1_", 4, 2, "y(T)"), ("S_1_", 5, 30, "x <&> (T)")]


def test_files_are_parsed_once(spark):
    """What is joined below are written nodes: no side unzips and parses the files again."""
    files = spark.createDataFrame([("a.xlsx", _book([("S", "worksheets/sheet1.xml", '<row r="1"><c r="B1" t="s"><v>0</v></c></row>')], "<si><t>x(T)</t></si>"))], "path string, content binary")
    found = W.cells(W.parts(files))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["sheet"], r["row"], r["column"], r["text"]) for r in found.collect()] == [("S", 1, 2, "x(T)")]
