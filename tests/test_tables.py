"""Table grids: spans, nesting, omitted and stray tags; fields and the best row."""

from quarry.operators import tables as TB


def _grid(spark, html):
    out = {}
    for r in TB.grids(spark.createDataFrame([(1, html)], "doc int, html string")).collect():
        out.setdefault(r["table_index"], {})[(r["row"], r["column"])] = r["text"]
    return out


def test_spans(spark):
    got = _grid(spark, '<table><tr><th rowspan=2>A<th colspan="2">B</tr><tr><td>c<td>d</tr><tr><td colspan=0>e<td rowspan=9>f</table>')
    assert got == {0: {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "A", (1, 1): "c", (1, 2): "d", (2, 0): "e", (2, 1): "f"}}


def test_nesting_and_broken_markup(spark):
    got = _grid(spark, "<td>stray</td><table><td>x &amp; <i>y</i><table><tr><td>inner</table> z<tr><td>last")
    assert got == {0: {(0, 0): "x & y z", (1, 0): "last"}, 1: {(0, 0): "inner"}}
    assert _grid(spark, "no tables") == {} == _grid(spark, None) == _grid(spark, "<table></table>")


def test_fields_and_best_row(spark):
    html = "<table><tr><td> <td></tr><tr><th>Name<th>DID <th>DID<th></tr><tr><td>read snapshot<td>F1<td>F2<td>note</tr><tr><td><td></tr><tr><td>clear dtc</td></tr></table>"
    rows = TB.fields(TB.grids(spark.createDataFrame([(1, html), (2, "<table><tr><td>only</table>")], "doc int, html string")))
    got = {r["row"]: [tuple(f) for f in r["fields"]] for r in rows.collect()}
    assert got == {2: [("NAME", "read snapshot"), ("DID", "F2")], 4: [("NAME", "clear dtc")]}
    asks = spark.createDataFrame([("a", 1, ["DTC clear all", "x"]), ("b", 1, ["snapshot"]), ("c", 1, ["", "nothing"]), ("d", 2, ["only"])], "node string, doc int, aliases array<string>")
    assert {r["node"]: (r["row"], r["score"]) for r in TB.best_rows(rows, asks).collect()} == {"a": (4, 0.666667), "b": (2, 1.0), "c": (2, 0.0)}
