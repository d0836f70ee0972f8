"""Streams give what the batch operators give on the same files."""

import random

from pyspark.sql import functions as F

from tidewatch.config import Confirm
from tidewatch.operators import confirm, indicators, windows
from tidewatch.sources import access as src
from tidewatch.streaming import processor, sets, stateful

SF = "/root/testdata/sf0.001"


def test_log_stream_equals_batch(spark, tmp_path):
    lines = src.lines(src.access(spark, SF)).orderBy("seq").select("value")
    lines.coalesce(1).write.text(f"{tmp_path}/in")
    stream = indicators.indicators(src.stream_log(spark, f"{tmp_path}/in", "nginx", F.lit(0)))
    got = []
    q = processor.write_batches(processor.snapshots(stream), f"{tmp_path}/c", lambda b, k: got.extend(map(tuple, b.collect())))
    q.awaitTermination(120)
    batch = windows.snapshots(indicators.indicators(src.read_log(spark, f"{tmp_path}/in", "nginx", F.lit(0))), 60)
    want = set(map(tuple, batch.select("tick", "source_ip", *indicators.COUNTERS).collect()))
    last = max(t[0] for t in want) - 120  # later windows wait for the watermark
    assert set(got) <= want and {t for t in want if t[0] <= last} <= set(got)


FAR = 10**6


def in_pieces(spark, path, rows, schema, pieces=3, seed=1):
    """A stream over as many micro-batches, in which rows come up to some places late; a row of no key that counts moves the watermark past all."""
    r = random.Random(seed)
    late = sorted(range(len(rows)), key=lambda i: i + r.randint(0, 5))
    step = -(-len(rows) // pieces)
    for k in range(pieces):
        spark.createDataFrame([rows[i] for i in late[step * k : step * (k + 1)]], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def outcome(stream, checkpoint):
    got = []
    q = processor.write_batches(stream, checkpoint, lambda b, k: got.extend(tuple(x) for x in b.collect()))
    assert q.awaitTermination(240)
    return sorted(got)


def test_confirmation_stream_equals_batch(spark, tmp_path):
    r = random.Random(8)
    rows, ts = [], 1000
    for i in range(300):
        ts += r.choice([0, 1, 4, 9, 60 if i % 40 == 0 else 1])
        rows.append((f"ip{r.randint(1, 3)}", ts, i, r.choice(["/a", "/b"]), r.random() < 0.9, r.random() < 0.03, r.random() < 0.03))
    rows.append(("last", FAR, 300, "/", True, False, False))
    schema = "source_ip string, ts long, seq long, path string, is_high boolean, high_confidence boolean, honeypot boolean"
    c = Confirm(3, 20, 2)
    stream = in_pieces(spark, f"{tmp_path}/in", rows, schema)
    got = outcome(stateful.confirm_blocks(stream, c, 100, "80 seconds"), f"{tmp_path}/c")
    want = sorted(map(tuple, confirm.confirm_blocks(spark.createDataFrame(rows, schema), c, 100).collect()))
    assert got == want and {x[4] for x in want} == {True, False}


def test_enumeration_and_port_streams_equal_batch(spark, tmp_path):
    r = random.Random(9)
    rows, ts = [], 1000
    for i in range(240):
        ts += r.choice([0, 1, 2, 30 if i % 50 == 0 else 0])
        rows.append((f"ip{r.randint(1, 3)}", ts, i, f"/o/{r.randint(1, 9)}", r.randint(1, 9 if i < 120 else 60)))
    rows = [("ip1", 1000, -5, "/o/1", None), *rows, ("last", FAR, 240, "/o/1", 1)]
    schema = "source_ip string, ts long, seq long, path string, dst_port int"
    stream, table = in_pieces(spark, f"{tmp_path}/in", rows, schema), spark.createDataFrame(rows, schema)
    got = outcome(stateful.idor(stream, "^/o/", "/o/([0-9]+)", 20, 3, lateness="60 seconds"), f"{tmp_path}/c")
    assert got == sorted(map(tuple, confirm.idor(table, "^/o/", "/o/([0-9]+)", 20, 3).where("source_ip != 'last'").collect()))
    ports, limits = lambda df: df.withColumnRenamed("source_ip", "src_ip"), ((5, 5), (30, 12))
    got = outcome(stateful.port_scans(ports(stream), limits, lateness="60 seconds"), f"{tmp_path}/d")
    want = sorted(map(tuple, windows.port_scans(ports(table.where("dst_port is not null")), limits).collect()))
    assert got == want and len(want) == 3


def plain_state(log, now):
    """The members after a log of (set, ip, op, expires_at)."""
    state = {}
    for s, ip, op, end in log:
        state.pop((s, ip), None)
        if op == "add":
            state[s, ip] = end
    return {k: e for k, e in state.items() if e is None or e > now}


def test_set_table_equals_a_replay_of_its_log(spark, tmp_path):
    r, log = random.Random(3), []
    table = sets.SetTable(spark, f"{tmp_path}/t", whole_every=3)
    seen = lambda now: {(x["set"], x["ip"]): x["expires_at"] for x in table.current(F.lit(now)).collect()}
    assert seen(0) == {}
    for k in range(8):
        part = [(r.choice(["black", "white"]), f"10.0.0.{r.randint(1, 12)}", r.choice(["add", "add", "del"]), r.choice([None, 50, 500])) for _ in range(9)]
        log += part
        batch = spark.createDataFrame([(i, s, ip, op, "local", end if op == "add" else None) for i, (s, ip, op, end) in enumerate(part)], "ord long, set string, ip string, op string, source string, expires_at long")
        for _ in range(2):  # a batch that is run again changes nothing
            table.apply(batch, k)
        if k in (1, 4, 7):
            assert seen(10) == plain_state(log, 10) and seen(100) == plain_state(log, 100)
    assert table.latest() == (7, 5, [6, 7])
    table.command("add", "black", ["9.9.9.9", "10.0.0.1"], at=1000, seconds=60)
    table.command("add", "white", ["8.8.8.8"])
    table.command("del", "black", ["10.0.0.1"])
    assert ("black", "9.9.9.9") in seen(1059) and ("black", "9.9.9.9") not in seen(1060) and ("black", "10.0.0.1") not in seen(0)
    assert {x["set"]: x["members"] for x in table.status(F.lit(10**9)).collect()}["white"] == len([1 for (s, _), e in plain_state(log, 10**9).items() if s == "white"]) + 1


def test_accepted_blocks_of_a_stream_reach_the_set_table(spark, tmp_path):
    schema = "source_ip string, ts long, seq long, path string, is_high boolean, high_confidence boolean"
    rows = [("a", 1000 + i, i, f"/{i}", True, False) for i in range(6)] + [("b", 1003, 9, "/", True, False), ("last", FAR, 10, "/", True, False)]
    table = sets.SetTable(spark, f"{tmp_path}/t")
    stream = stateful.confirm_blocks(in_pieces(spark, f"{tmp_path}/in", rows, schema, 2), Confirm(3, 20, 0), 60)
    q = processor.write_batches(stream, f"{tmp_path}/c", table.sink(lambda b: sets.blocked(b, 60)))
    assert q.awaitTermination(240)
    assert [tuple(x) for x in table.current(F.lit(1010)).collect()] == [("black", "a", "local", 1062)]


def test_report_sink_is_idempotent(spark, tmp_path):
    b = spark.createDataFrame([("1.1.1.1", 5, 1), ("1.1.1.1", 9, 2)], "source_ip string, ts long, seq long")
    for _ in range(2):
        processor.report_sink(f"{tmp_path}/r")(b, 0)
    assert spark.read.json(f"{tmp_path}/r").count() == 2
