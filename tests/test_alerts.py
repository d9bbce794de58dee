from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cairnlog.operators.alerts import Rule, evaluate_rules, fire_times, fired_rules
from cairnlog.operators.anomaly import score_anomalies
from cairnlog.operators.predicates import field_equals
from cairnlog.sinks import delivery, payloads


def fold(times: list[int], cooldown: int) -> list[int]:
    fired: list[int] = []
    for t in sorted(times):
        if not fired or t - fired[-1] >= cooldown:
            fired.append(t)
    return fired


def stamped(seconds: int) -> str:
    return f"2025-08-01T10:{seconds // 60:02d}:{seconds % 60:02d}"


def test_cooldown(entries):
    times = [0, 0, 30, 59, 60, 60, 125, 130]
    frame = entries([{"level": "ERROR", "timestamp": stamped(t)} for t in times])
    rules = [Rule("held", field_equals("level", "ERROR"), 60), Rule("all", lambda df: F.lit(True), 0), Rule("none", field_equals("level", "X"))]
    fired = evaluate_rules(frame, rules)
    assert [r.seq for r in fired.where("rule = 'held'").orderBy("seq").collect()] == [0, 4, 6]
    assert fired.where("rule = 'all'").count() == len(times)
    assert fired.where("rule = 'none'").count() == 0
    names = {r.seq: r.rules for r in fired_rules(fired).collect()}
    assert names[0] == ["held", "all"] and names[1] == ["all"]


def test_only_free_rules_and_missing_times(entries):
    frame = entries([{"m": "a"}, {"m": "b"}])
    assert evaluate_rules(frame, [Rule("free", lambda df: F.lit(True), 0)]).count() == 2
    assert evaluate_rules(frame, [Rule("held", lambda df: F.lit(True), 60)]).count() == 2


def test_order_that_is_tied_or_missing(spark):
    rows = [(1, 0, "a"), (1, 10, "b"), (1, 70, "c"), (None, 86_400, "d"), (None, 86_400, "e"), (2, None, "f")]
    table = spark.createDataFrame(rows, "k long, s long, n string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    fired = evaluate_rules(table, [Rule("r", lambda df: F.lit(True), 60)], "ts", "k").collect()
    names = sorted(r.n for r in fired)
    assert len(names) == 4 and names[:2] == ["a", "c"] and names[2] in "de" and names[3] == "f"


def test_entries_are_read_twice_whatever_the_rules(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touched(v):
        seen.add(1)
        return v

    table = spark.range(300).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), touched("id").alias("v"))
    table = table.withColumn("ts", F.when(F.col("id") % 50 > 0, F.col("ts")))
    rules = [Rule("held", F.col("v") > 5, 60), Rule("free", F.col("v") > 5, 0), Rule("also", F.col("v") % 2 == 0, 10)]
    assert evaluate_rules(table, rules, "ts", "id").count() > 300
    assert seen.value <= 2 * 300


def match_times() -> dict[int, tuple[int, list[int]]]:
    """By rule: a cooldown and match times of some shape."""
    random.seed(5)
    shapes = [
        random.sample(range(40_000), 900),
        random.sample(range(10**6), 700),
        [b + random.randrange(60) for b in random.sample(range(10**5), 60) for _ in range(20)],
        list(range(-5000, 20_000, 29)),
    ]
    return {2 * i + j: (c, sorted(set(times))) for i, times in enumerate(shapes) for j, c in enumerate((1000, 37))}


@pytest.mark.parametrize("blocks", [None, 1, 6, 40])
def test_fire_times_agree_with_a_plain_fold(spark, blocks):
    """However the times are cut into blocks, the fires are those of one fold per rule."""
    cases = match_times()
    rows = [(rule, t, cooldown) for rule, (cooldown, times) in cases.items() for t in times]
    ticks = spark.createDataFrame(rows, "rule_no int, _t long, _cooldown long").repartition(5)
    got = fire_times(ticks, blocks).collect()
    for rule, (cooldown, times) in cases.items():
        assert sorted(r["_t"] for r in got if r.rule_no == rule) == fold(times, cooldown), rule
    assert fire_times(ticks.where("false"), blocks).collect() == []


def test_one_cooldown_is_spread_over_blocks(spark, monkeypatch):
    """A rule that every row matches inside one cooldown: no task sees more than a block."""
    ticks = spark.range(20_000).select(F.lit(0).alias("rule_no"), (F.col("id") * 3).alias("_t"), F.lit(10**9).alias("_cooldown"))
    dealt = ticks.repartitionByRange(10, "rule_no", "_t").groupBy(F.spark_partition_id()).count()
    assert dealt.count() == 10 and dealt.agg(F.max("count")).first()[0] < 4000
    assert [tuple(r) for r in fire_times(ticks, 10).collect()] == [(0, 0)]


def test_anomaly_rule(spark):
    rows = [(i, v) for i, v in enumerate([40.0, 44.5, 38.25, 41.0, 43.0, 40.5, 260.0, 41.5])]
    table = spark.createDataFrame(rows, "i long, ms double").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    scored = score_anomalies(table, "ms", min_samples=5, order_by="i")
    fired = evaluate_rules(scored, [Rule("slow", F.col("is_anomaly"), 0)], "ts", "i")
    assert [r.i for r in fired.collect()] == [6]


def test_delivery(entries, spark, tmp_path):
    rules = [Rule("r", lambda df: F.lit(True), 0, ("a", "b", "nowhere"))]
    fired = evaluate_rules(entries([{"m": "1"}, {"m": "2"}]), rules)
    seen: list[int] = []

    def broken(_):
        raise OSError("down")

    log = str(tmp_path / "log")
    delivery.deliver(fired, {"a": broken, "b": lambda df: seen.append(df.count())}, log)
    assert seen == [2]
    assert {(r.channel, r.delivered) for r in spark.read.parquet(log).collect()} == {("a", False), ("b", True)}
    assert delivery.route(fired, []).count() == 0


def test_payloads(entries):
    frame = entries([{"level": "ERROR", "message": 'disk "full"' + "x" * 600, "n": None}, {"other": "1"}]).withColumn("rule", F.lit("High errors"))
    rows = frame.select(
        payloads.chat_payload(frame, "me").alias("chat"), payloads.mail_subject("me").alias("subject"), payloads.mail_body(frame, "me").alias("body")
    ).collect()
    chat = json.loads(rows[0].chat)
    assert chat["text"] == ":rotating_light: *me alert: High errors*"
    block = chat["blocks"][0]
    assert block["type"] == "section" and block["text"]["type"] == "mrkdwn"
    assert block["text"]["text"] == "*Rule:* High errors\n*Level:* ERROR\n*Message:* " + ('disk "full"' + "x" * 600)[:300]
    assert rows[0].subject == "[me] Alert: High errors"
    body = rows[0].body.split("\n")
    assert body[:2] == ["me Alert — High errors", "=" * 40]
    assert body[3] == "Level  : ERROR" and len(body[4]) == len("Message: ") + 500
    assert body[5:7] == ["", "Full entry:"] and body[-1] == "  n: None"
    assert "*Level:* unknown" in json.loads(rows[1].chat)["blocks"][0]["text"]["text"]
    assert '{"other":"1"}' in rows[1].body
