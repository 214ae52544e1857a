"""Tables read by plain tags against Python's parser, and rows kept whole against rows of cells."""

import random

from quarry.operators import tables as TB

PIECES = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH colspan=2>", "<th colspan='2' id=\"it's\">", '<td rowspan="2" class="a b">', "</th >", "x", " y &amp; z ", "&lt;", "&#65", "a\nb", "<b>", "</b>", "\u00a0", "A", "B", "<td rowspan=0>", '<td colspan="²">', "<td colspan=00000000000000000003>"]
ODD = ["<!-- <td> -->", "a < b", "<br/>", "<td/>", "<td x>", "<script><td></script>", "<td title='<tr>'>", "<?php <td> ?>", "</>", "<td", "<td a=&lt;>", "</td x>", "<textarea><td></textarea>", "<td a=1a=2>", "&"]


def _parsed(html):
    reader = TB._Reader()
    reader.feed(html)
    reader.close()
    return reader.tables.close()


def test_plain_tags_as_the_parser_reads_them():
    rng = random.Random(4)
    for i in range(4000):
        html = "<table>" * (i % 2) + "".join(rng.choices(PIECES + (ODD if i % 5 == 0 else []), k=rng.randrange(1, 25)))
        assert TB._read(html) == _parsed(html), html


def test_plain_texts_do_not_reach_the_parser(monkeypatch):
    monkeypatch.setattr(TB, "_Reader", None)
    assert TB._read('<TABLE border="1"><tr><th colspan=\'2\'>a &amp; b</TH ><tr><td>c<td>d</table> e') == [[["a & b", "a & b"], ["c", "d"]]]


def test_rows_kept_whole_are_those_of_their_cells(spark):
    rng = random.Random(5)
    text = lambda: "<table><tr><td>A<td>B<td>a <td>" + "".join(rng.choices(PIECES, k=rng.randrange(1, 30))) + "<tr><td>c<td>d<td>e"
    html = [(None, text()), *[(i, text()) for i in range(150)], (500, None), (501, "<table><tr><td>only</table>")]
    docs = spark.createDataFrame(html, "doc int, html string")
    show = lambda df: sorted(str((r["doc"], r["table_index"], r["row"], [tuple(f) for f in r["fields"]])) for r in df.collect())
    want = show(TB.fields(TB.grids(docs)))
    assert show(TB.rows_of(docs)) == want and len(want) > 50
    # No cell is shuffled.
    assert "Exchange" not in TB.rows_of(docs)._jdf.queryExecution().executedPlan().toString()
