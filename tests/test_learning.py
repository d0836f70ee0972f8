"""Baselines learnt in a stream equal those of the batch, whatever the micro-batches."""

import random

from pyspark.sql import functions as F
from test_streaming import FAR, in_pieces

from tidewatch.operators import baseline, windows
from tidewatch.operators.indicators import COUNTERS
from tidewatch.streaming import processor
from tidewatch.streaming.learning import BaselineTable

SCHEMA = "source_ip string, ts long, seq long, " + ", ".join(f"{c} long" for c in COUNTERS)


def traffic(n, seed):
    r, rows, ts = random.Random(seed), [], 1003
    for i in range(n):
        ts += r.choice([0, 0, 1, 1, 2, 45 if i % 150 == 149 else 0])
        one = {"total": 1, "c404": r.random() < 0.2, "c4xx": r.random() < 0.1, "sens": r.random() < 0.1, "head": r.random() < 0.3, "bot": r.random() < 0.05}
        rows.append((f"ip{int(r.random() ** 2 * 6)}", ts, i, *[int(one.get(c, 0)) for c in COUNTERS]))
    return rows


def rounded(df):
    return sorted((t.tick, t.dim, *(round(x, 9) for x in (t.p50, t.p95, t.p99)), t.n) for t in df.collect())


def test_stream_equals_batch_and_survives_replays(spark, tmp_path):
    rows = traffic(1500, 3)
    end = ("last", FAR, 1500, *[0] * len(COUNTERS))
    table, seen = BaselineTable(spark, f"{tmp_path}/t"), []

    def twice(batch, k):
        table.apply(batch, k)
        before = table.versions()
        table.apply(batch, k)
        assert table.versions() == before
        seen.append(k)

    stream = in_pieces(spark, f"{tmp_path}/in", [*rows, end], SCHEMA, pieces=4)
    q = processor.write_batches(processor.snapshots(stream, lateness="80 seconds", first=True), f"{tmp_path}/c", twice)
    assert q.awaitTermination(240)
    whole = spark.createDataFrame(rows, SCHEMA)
    want = baseline.baselines(baseline.tick_percentiles(windows.snapshots(whole), 60), F.lit(1003)).persist()
    known = table.versions()
    assert len(known) > 1 and {v.start for v in known} == {min(r[1] for r in rows)}
    assert all(a.last < b.first for a, b in zip(known, known[1:]))
    assert rounded(table.ticks()) == rounded(want.where(F.col("tick") < FAR))

    # Events of a later batch meet what the batch operator gives them, from few versions.
    since = known[-1].first
    asked = whole.where(F.col("ts") >= since)
    fields = [F.round(c, 9).alias(n) for n, c in baseline.columns("b").items()]
    plain = lambda df: sorted(map(tuple, df.select("seq", *fields).collect()))
    assert plain(table.learnt(asked, "b")) == plain(baseline.learnt(asked, want, F.lit(rows[0][1]), "b"))
    assert table.ticks(since).count() < table.ticks().count()
    want.unpersist()


def test_nothing_learnt_gives_the_defaults(spark, tmp_path):
    table = BaselineTable(spark, f"{tmp_path}/t")
    events = spark.createDataFrame([(1, 1000), (2, None)], "seq long, ts long")
    got = table.learnt(events, "b").select("b.conf", "b.qps_p95", "b.own_qps_n").distinct().collect()
    assert [tuple(x) for x in got] == [(0.0, 1000.0, 0)]
    table.apply(spark.createDataFrame([], SCHEMA + ", tick long, first_ts long"), 0)
    assert table.versions() == [] and table.ticks().count() == 0
