"""A growing file read as a stream: every line once, through cuts, restarts, rotations and truncation."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import growing


class Follow:
    """A query that can be stopped and started again; `seen` are the lines in the order of batches."""

    def __init__(self, spark, log, where, split=growing.SPLIT):
        self.spark, self.log, self.where, self.split, self.seen, self.marked = spark, str(log), str(where), split, [], set()

    def take(self, batch, k):
        rows = batch.collect()
        self.seen += [r["value"] for r in sorted(rows, key=lambda r: (r["inode"], r["at"]))]
        self.marked |= {r["value"] for r in rows if r["truncated"]}

    def __enter__(self):
        self.query = growing.stream_lines(self.spark, self.log, self.split).writeStream.option("checkpointLocation", self.where).foreachBatch(self.take).start()
        return self

    def __exit__(self, *_):
        self.query.stop()

    def now(self):
        self.query.processAllAvailable()
        return sorted(self.seen)


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def test_every_line_once(spark, tmp_path):
    log = tmp_path / "access.log"
    want = [f"line {i}" for i in range(5)]
    append(log, "\n".join(want[:3]) + "\nline 3 is cut i")
    with Follow(spark, log, tmp_path / "c") as f:
        assert f.now() == want[:3]
        append(log, "n two\r\n")
        want = [*want[:3], "line 3 is cut in two", "line 4"]
        append(log, "line 4\nhalf")
        assert f.now() == sorted(want)
    # The query is away: the file is renamed twice, its half line ended.
    append(log, " line\n")
    os.rename(log, tmp_path / "access.log.1")
    append(log, "between 1\nbetween 2\n")
    os.rename(tmp_path / "access.log.1", tmp_path / "access.log.2")
    os.rename(log, tmp_path / "access.log.1")
    append(log, "new 1\nnew")
    want += ["half line", "between 1", "between 2", "new 1"]
    f.seen, seen = [], f.seen
    with f:
        assert sorted(seen + f.now()) == sorted(want) and not f.marked
        f.seen += seen
        append(log, " 2\n")
        assert f.now() == sorted([*want, "new 2"])
        # Emptied in place and written anew, shorter and then longer than before.
        with open(log, "wb") as out:
            out.write(b"t1\n")
        assert f.now() == sorted([*want, "new 2", "t1"]) and f.marked == {"t1"}
        with open(log, "wb") as out:
            out.write(b"u1 is longer than all there was\nu2\n")
        assert f.now() == sorted([*want, "new 2", "t1", "u1 is longer than all there was", "u2"])
        os.remove(log)
        f.query.processAllAvailable()
        append(log, "after removal\n")
        assert "after removal" in f.now() and "after removal" in f.marked and len(f.seen) == len(want) + 5


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_ranges_share_lines_out(tmp_path, split):
    log = tmp_path / "x.log"
    text = [("é" * (i % 9)) + str(i) for i in range(200)] + ["", "", "end"]
    append(log, "\n".join(text) + "\nhalf")
    r = growing._Reader(str(log), split)
    end = r.latestOffset()
    got = [v for p in r.partitions(r.initialOffset(), end) for b in growing.lines(p) for v in b.column("value").to_pylist()]
    assert got == text
    # A batch that is run again, after the file has grown, reads the same.
    append(log, " line\nmore\n")
    again = [v for p in r.partitions(r.initialOffset(), end) for b in growing.lines(p) for v in b.column("value").to_pylist()]
    assert again == text
    rest = [v for p in r.partitions(end, r.latestOffset()) for b in growing.lines(p) for v in b.column("value").to_pylist()]
    assert rest == ["half line", "more"]


def test_no_file_yet(tmp_path):
    r = growing._Reader(str(tmp_path / "none.log"), 100)
    assert r.latestOffset() == r.initialOffset() and r.partitions(r.initialOffset(), r.latestOffset()) == []


def test_events_of_a_growing_file(spark, tmp_path):
    log = tmp_path / "a.log"
    append(log, '1.2.3.4 - - [05/Feb/2024:10:00:00 +0000] "GET /a HTTP/1.1" 404 7 "-" "curl/8"\nno log line\n')
    rows = []
    q = growing.stream_events(spark, str(log), "nginx", F.lit(0)).writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, k: rows.extend(b.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["source_ip"], r["path"], r["status"], r["truncated"]) for r in rows] == [("1.2.3.4", "/a", 404, False)]
