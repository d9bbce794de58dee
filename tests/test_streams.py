from __future__ import annotations

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from cairnlog.operators.alerts import Rule, evaluate_rules
from cairnlog.operators.anomaly import score_anomalies
from cairnlog.sinks.delivery import batch_writer
from cairnlog.sources.lines import read_lines, stream_lines
from cairnlog.sources.parse import parse_auto
from cairnlog.streaming import counters
from cairnlog.streaming.alerts import alert_writer
from cairnlog.streaming.anomaly import anomaly_writer
from cairnlog.streaming.tail import lines_from_now, tail_entries

from .conftest import ACCESS_LINES, JSON_LINES, SYSLOG_LINES

SCHEMA = "i long, k string, v double, ts timestamp_ntz"


@pytest.fixture
def table(spark):
    rows = [(i, "ab"[i % 2], float((i * 7919) % 101) + (900 if i % 130 == 7 else 0)) for i in range(600)]
    return spark.createDataFrame(rows, "i long, k string, v double").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 20 + F.col("i") % 3).cast("timestamp_ntz")
    )


@pytest.fixture
def batches(spark, table, tmp_path):
    """The table as a stream of six files, one per micro-batch, oldest first."""
    folder = tmp_path / "in"
    for part in range(6):
        piece = str(tmp_path / f"piece{part}")
        table.where(F.floor(F.col("i") / 100) == part).coalesce(1).write.parquet(piece)
        folder.mkdir(exist_ok=True)
        [file] = pathlib.Path(piece).glob("part-*.parquet")
        target = folder / f"{part}.parquet"
        os.link(file, target)
        os.utime(target, (1_000_000 + part, 1_000_000 + part))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(stream, tmp_path, name):
    out = str(tmp_path / name)
    run = stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out)
    run.awaitTermination()
    assert len(run.recentProgress) > 1
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def by_batch(stream, make, tmp_path):
    """Run through a batch writer; the first batch is given twice, as after a failure."""
    out = str(tmp_path / "out")
    write = make(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "state"))
    numbers = []

    def step(df, n):
        numbers.append(n)
        for _ in range(2 if n in (0, 3) else 1):
            write(df, n)

    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert numbers == list(range(6))
    return stream.sparkSession.read.parquet(out)


def test_scores_of_a_stream_equal_the_batch(batches, table, tmp_path):
    got = by_batch(batches, lambda sink, state: anomaly_writer("v", sink, state, "i", ["k"], min_samples=10), tmp_path)
    want = score_anomalies(table, "v", min_samples=10, order_by="i", partition_by=["k"]).orderBy("i").collect()
    got = got.orderBy("i").collect()
    assert [r.i for r in got] == [r.i for r in want]
    for g, w in zip(got, want):
        assert g.is_anomaly == w.is_anomaly and g.n == w.n
        assert g.z_score == (w.z_score if w.z_score is None else pytest.approx(w.z_score))


def test_alerts_of_a_stream_equal_the_batch(batches, table, tmp_path):
    rules = [Rule("b", lambda df: F.col("k") == "b", 700, ("x",)), Rule("big", lambda df: F.col("v") > 90, 0), Rule("never", lambda df: F.lit(False))]
    got = by_batch(batches, lambda sink, state: alert_writer(rules, sink, state, "ts", "i"), tmp_path)
    want = evaluate_rules(table, rules, "ts", "i")
    columns = ["rule_no", "rule", "fired_at", "i", "v"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.where("rule = 'b' AND channels = array('x')").count() == want.where("rule = 'b'").count()


def test_alerts_go_to_channels_per_batch(batches, spark, tmp_path):
    out, log = str(tmp_path / "sent"), str(tmp_path / "log")
    rules = [Rule("all", lambda df: F.lit(True), 0, ("file",))]
    send = batch_writer({"file": lambda df: df.select("i").write.mode("append").parquet(out)}, log)
    run = batches.writeStream.foreachBatch(alert_writer(rules, send, str(tmp_path / "state"), "ts", "i"))
    run.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 600
    assert spark.read.parquet(log).where("delivered").count() == 6


def test_lines_of_a_stream_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.log").write_text("\n".join([*JSON_LINES, *ACCESS_LINES, *SYSLOG_LINES, "x", "{bad"]) + "\n")
    stream = stream_lines(spark, str(folder), maxFilesPerTrigger=1)
    got = collected(parse_auto(stream, mode="line").select("file", "seq", "format"), tmp_path, "parsed")
    want = parse_auto(read_lines(spark, str(folder)), mode="line")
    assert sorted((r.file, r.format) for r in got.collect()) == sorted((r.file, r.format) for r in want.collect())
    in_order = [r.format for r in got.where("file LIKE '%0.log'").orderBy("seq").collect()]
    assert in_order == ["json"] * 5 + ["apache"] * 2 + ["syslog"] * 2 + ["raw"]
    assert {r.level: r["count"] for r in counters.level_counts(want).collect()} == {"INFO": 9, "ERROR": 9, "WARN": 6, "DEBUG": 3}
    assert tuple(counters.line_counters(read_lines(spark, str(folder))).first()) == (30, 3)
    assert [r.level for r in counters.top_levels(want, 2).collect()] == ["ERROR", "INFO"]
    with pytest.raises(ValueError, match="mode='line'"):
        parse_auto(stream, mode="file")


def test_tail_of_new_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(JSON_LINES[:2]) + "\n{bad\nquiet\n")
    entries = tail_entries(stream_lines(spark, str(folder)), "LOST|bad|fresh")
    out = str(tmp_path / "tail")

    def advance():
        run = entries.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True)
        run.start(out).awaitTermination()
        return sorted(r.msg for r in spark.read.schema(entries.schema).parquet(out).collect())

    assert advance() == ["lost peer fe80::1", "{bad"]
    (folder / "b.log").write_text("fresh\n")
    assert advance() == ["fresh", "lost peer fe80::1", "{bad"]


def test_tail_from_now(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "tail")
    folder.mkdir()
    (folder / "old.log").write_text("old\n")
    os.utime(folder / "old.log", (1_000_000, 1_000_000))

    def advance():
        entries = tail_entries(lines_from_now(spark, str(folder), out + "-c", maxFilesPerTrigger=1))
        run = entries.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True)
        run.start(out).awaitTermination()
        return sorted(r.msg for r in spark.read.schema(entries.schema).parquet(out).collect())

    assert advance() == []
    (folder / "b.log").write_text("second\n")
    (folder / "c.log").write_text("third\n")
    assert advance() == ["second", "third"]
    (folder / "late.log").write_text("late\n")
    os.utime(folder / "late.log", (2_000_000, 2_000_000))  # arrives later, but is older than the start
    (folder / "d.log").write_text("fourth\n")
    assert advance() == ["fourth", "second", "third"]
    assert advance() == ["fourth", "second", "third"]


def test_lines_are_counted_as_they_are_written(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join([*JSON_LINES, "{bad"]) + "\n")
    (folder / "b.log").write_text("\n".join([*SYSLOG_LINES, "{bad", "{worse"]) + "\n")
    (folder / "c.log").write_text("")
    path, out = str(tmp_path / "counts"), str(tmp_path / "out")
    write = counters.counted_writer(lambda df, n: df.select("raw").write.mode("overwrite").parquet(f"{out}/batch={n}"), path)

    def step(df, n):
        for _ in range(2 if n == 0 else 1):  # a batch that runs again counts once
            write(df, n)

    run = stream_lines(spark, str(folder), maxFilesPerTrigger=1).writeStream.foreachBatch(step)
    run.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    good = len(JSON_LINES) + len(SYSLOG_LINES)
    assert tuple(counters.counted_totals(spark, path).first()) == (good, 3, 3)
    assert spark.read.schema("raw string").parquet(out).count() == good


def test_batches_leave_no_tables(spark, table, tmp_path):
    from cairnlog.session import shared_folder

    rules = [Rule("r", F.col("v") > 50, 60)]
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in shared.glob("settled-*")}
    for number in range(2):
        alert_writer(rules, lambda batch, n: batch.count(), str(tmp_path / "s"), "ts", "i")(table, number)
        anomaly_writer("v", lambda batch, n: batch.count(), str(tmp_path / "t"), "i", ["k"])(table, number)
    assert {p.name for p in shared.glob("settled-*")} == before
