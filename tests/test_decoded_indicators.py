"""Danger and climbing counters see through nested encodings."""

from test_operators import events

from tidewatch.operators.indicators import indicators


def test_nested_encodings_count(spark):
    paths = ["/%252e%252e%252fetc", "/%25252e%25252e%25252fx", "/q?a=&#60;script&#62;", "/q?a=%26%2360%3Bscript%3E", "/q?a=\\u003cscript\\u003e", "/a..b", "/ok", "/../x", "/%zz/ok", None]
    rows = indicators(events(spark, [(1, "1.1.1.1", p, 200, "x") for p in paths])).collect()
    got = {r["seq"]: (r["trav"], r["danger"]) for r in rows}
    assert [got[i][0] for i in range(9)] == [1, 1, 0, 0, 0, 0, 0, 1, 0]
    assert [got[i][1] for i in range(9)] == [1, 1, 1, 1, 1, 0, 0, 1, 0]
    assert got[9][0] == 0
