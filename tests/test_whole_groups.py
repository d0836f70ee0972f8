"""Groups that may hold a third of the table are cut in dealt parts first."""

import contextlib
import io
import random
import re

from test_operators import events

from tidewatch import features
from tidewatch.operators import windows


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_capped_lists_are_cut_before_they_are_collected(spark):
    r = random.Random(3)
    rows = [(r.choice(["ua", "path", "", None, "other"]), f"v{r.randint(0, 90)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "category string, value string, ord long")
    cut = {x["category"]: x["items"] for x in features.by_category(df, most=500).collect()}
    whole = {x["category"]: x["items"] for x in features.by_category(df).collect()}
    assert {k: v[:500] for k, v in whole.items()} == cut
    a, b = (sorted(map(str, features.capped(x).collect())) for x in (features.by_category(df, most=500), features.by_category(df)))
    assert a == b


def test_sessions_deal_an_address_over_chunks(spark):
    r = random.Random(4)
    ts, rows = 3000, []
    for _ in range(600):
        ts += r.choice([0, 1, 30, 299, 300, 301, 4000, 9000])
        rows.append((ts, r.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2", None]), "/a", 200, "x"))
    out = windows.sessions(events(spark, rows))
    assert not re.search(r"windowspecdefinition\(source_ip#\d+, ts#", plan(out))
    got = {x["seq"]: x["session"] for x in out.collect()}
    state = {}
    for i, (t, ip, *_) in enumerate(rows):
        last, n = state.get(ip, (t, 0))
        state[ip] = (t, n + (t - last >= 300))
        assert got[i] == state[ip][1]
