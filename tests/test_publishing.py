"""The position source, file audits, and published versions."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.sources import positions, sinks


@pytest.fixture
def files(spark, tmp_path):
    rows = [(datetime.date(2000 + i // 360, i // 30 % 12 + 1, i % 28 + 1), f"M{i % 5}", float(i), 1.0, 2.0) for i in range(720)]
    df = spark.createDataFrame([*rows, (None, "M", 1.0, 1.0, 1.0)], "date date, market string, oi double, long double, short double")
    positions.write_positions(df, f"{tmp_path}/p")
    return f"file://{tmp_path}/p", rows


def test_filters_reach_the_source_and_other_files_stay_shut(spark, files, tmp_path):
    path, rows = files
    for month in os.listdir(f"{tmp_path}/p"):  # files out of range can't be read
        if month.startswith("month=") and not "month=2000-03" <= month <= "month=2000-05":
            for name in os.listdir(f"{tmp_path}/p/{month}"):
                open(f"{tmp_path}/p/{month}/{name}", "w").write("broken")
    df = positions.read_positions(spark, path).where("date >= DATE '2000-03-10' AND date < DATE '2000-05-20'")
    want = sorted(r for r in rows if datetime.date(2000, 3, 10) <= r[0] < datetime.date(2000, 5, 20))
    assert sorted(tuple(r) for r in df.collect()) == want
    one = datetime.date(2000, 4, 3)
    assert positions.read_positions(spark, path).where(F.col("date") == F.lit(one)).count() == sum(r[0] == one for r in rows)
    assert positions.read_positions(spark, path).where("date > DATE '2030-01-01'").count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "date" in plan


def test_only_named_columns_are_read(spark, files):
    path, rows = files
    df = positions.read_positions(spark, path, "market", "date")
    assert df.columns == ["market", "date"] and df.count() == len(rows)
    reader = positions.PositionReader(path, ["market"])
    batch = next(iter(reader.read(reader.partitions()[0])))
    assert batch.schema.names == ["market"] and len(reader.partitions()) >= 24


def test_reconciliation(spark, tmp_path):
    for folder, texts in (("old", {"a": "1", "b": "2", "c/d": "3"}), ("new", {"a": "1", "b": "x", "e": "5"})):
        for name, text in texts.items():
            at = tmp_path / folder / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    (tmp_path / "new" / "_SUCCESS").write_text("")
    old, new = (audit.file_digests(spark, str(tmp_path / x)) for x in ("old", "new"))
    assert {r.path: r.bytes for r in old.collect()} == {"a": 1, "b": 1, "c/d": 1}
    assert {r.path: r.status for r in audit.reconcile(old, new).collect()} == {"a": "SAME", "b": "CHANGED", "c/d": "MISSING", "e": "EXTRA"}
    assert audit.reconcile(old.limit(0), new.limit(0)).count() == 0


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_of_two_writers_one_wins(spark, tmp_path):
    at = sinks.Published(spark, str(tmp_path / "t"))
    assert at.version() == 0 and at.read() is None
    assert at.publish(table(spark, 1), 0) == 1
    class Late(sinks.Published):
        """Another writer publishes after this one has looked."""

        def version(self):
            seen = super().version()
            if seen == 1 and not getattr(self, "done", False):
                self.done = True
                assert at.publish(table(spark, 2), 1) == 2
            return seen

    assert Late(spark, str(tmp_path / "t")).publish(table(spark, 3), 1) is None
    assert at.version() == 2 and [r.v for r in at.read().collect()] == [2] and [r.v for r in at.read(1).collect()] == [1]
    assert at.publish(table(spark, 4), 1) is None and at.publish(table(spark, 4), 2) == 3
    assert len(os.listdir(tmp_path / "t" / "data")) == 3  # the loser's files are gone, old versions stay


def test_no_reader_sees_a_half(spark, tmp_path):
    at = sinks.Published(spark, str(tmp_path / "t"))
    at.publish(table(spark, 1), 0)
    with pytest.raises(Exception, match="broken"):
        at.publish(table(spark, 2).select(F.raise_error(F.lit("broken")).cast("long").alias("v")), 1)
    assert at.version() == 1 and [r.v for r in at.read().collect()] == [1]
    assert at.publish(table(spark, 2), 1) == 2


def test_snapshots_expire_by_a_given_clock(spark, tmp_path):
    at, day, calls = sinks.Published(spark, str(tmp_path / "s")), datetime.datetime(2026, 1, 1), []

    def refresh(last):
        calls.append(None if last is None else [r.v for r in last.collect()])
        if len(calls) == 3:
            raise ValueError("source is down")
        return table(spark, len(calls))

    serve = lambda hours: [(r.v, r.status) for r in sinks.serve(at, refresh, day + datetime.timedelta(hours=hours), datetime.timedelta(hours=6)).collect()]
    assert serve(0) == [(1, "LIVE")] and serve(5) == [(1, "LIVE")] and len(calls) == 1
    assert serve(6) == [(2, "LIVE")] and calls[-1] == [1]
    assert serve(20) == [(2, "FALLBACK_LAST_VERIFIED")] and at.version() == 2
    assert serve(21) == [(4, "LIVE")] and at.version() == 3
    with pytest.raises(ValueError, match="down"):
        sinks.serve(sinks.Published(spark, str(tmp_path / "none")), lambda last: (_ for _ in ()).throw(ValueError("down")), day, datetime.timedelta(0))
