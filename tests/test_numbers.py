from __future__ import annotations

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlog.operators import anomaly, counting, custom, numeric, sketches
from cairnlog.operators.blocks import LINES_PER_BLOCK, with_block, with_ties_broken
from cairnlog.operators.stats import stats

from .conftest import dicts


def smallest_covering(values: list[float], p: float) -> float:
    """The smallest value with at least p percent of all values at or below it.

    How many that are is a product of doubles, as in the operator; in exact
    fractions 1 percent of 100 would be a little over one value.
    """
    needed = p / 100 * len(values)
    return next(v for v in sorted(values) if sum(w <= v for w in values) >= needed)


def test_counts(entries):
    frame = entries([{"level": "ERROR"}, {"level": "INFO"}, {"level": "ERROR"}, {"m": 1}, {"level": None}])
    top = [(r.rank, r["value"], r["count"]) for r in counting.top(frame, "level").orderBy("rank").collect()]
    assert top == [(1, "ERROR", 2), (2, "INFO", 1), (3, "unknown", 1), (4, "None", 1)]
    assert counting.top(frame, "level", 0).count() == 0
    assert counting.total(frame).first()[0] == 5
    bars = counting.distribution(frame, "level", 2, 10).orderBy("rank").collect()
    assert [(b.bar_len, b.pct_of_max) for b in bars] == [(10, 100.0), (5, 50.0)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_top_ties_go_to_the_first_seen(entries, parts):
    frame = entries([{"k": k} for k in "bacbdaec"]).repartition(parts)
    assert [r["value"] for r in counting.top(frame, "k", 4).orderBy("rank").collect()] == ["b", "a", "c", "d"]


def test_groups(entries):
    frame = entries([{"level": "ERROR", "m": "1"}, {"level": "INFO", "m": "2"}, {"level": "ERROR", "m": "3"}])
    assert [r["group"] for r in counting.group_keys(frame, "level").collect()] == ["ERROR", "INFO"]
    assert [e["m"] for e in dicts(counting.group_items(frame, "level", "ERROR"))] == ["1", "3"]
    assert counting.group_items(frame, "level", "NONE").count() == 0
    assert counting.group_cardinality(frame, "level").first()[0] == 2
    assert counting.group_cardinality(frame, "level", approximate=True).first()[0] == 2


def test_group_positions(spark):
    table = spark.range(3000).select(F.col("id"), F.floor(F.col("id") / 7).alias("t"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    got = sorted((r["id"], r["position"]) for r in counting.group_by(table.repartition(5), "k", ["t", "id"]).collect())
    seen = {"a": 0, "b": 0}
    want = []
    for i in range(3000):
        k = "a" if i % 3 == 0 else "b"
        seen[k] += 1
        want.append((i, seen[k]))
    assert got == want


def test_blocks_sort_like_an_order_of_any_type(spark):
    word = F.when(F.col("id") % 4 > 0, F.concat(F.lit("w"), (F.col("id") % 37).cast("string")))
    table = spark.range(4000).select(word.alias("w"), (F.col("id") % 2 == 0).alias("b"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = with_block(table, ["w", "b", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.count() == 4000 and cut.select("_block").distinct().count() > 1
    rows = [r["_block"] for r in cut.orderBy("w", "b", "id").collect()]
    assert rows == sorted(rows)


@pytest.mark.parametrize("day", ["1", "id div 900", "IF(id > 1000, 5, NULL)"])
def test_tied_orders_are_cut_and_defined(spark, day):
    """One past per entry, whatever the partitions; NULLs, repeated rows and maps included."""
    table = spark.range(3000).select(
        F.expr(day).alias("day"), (F.col("id") % 700).cast("double").alias("v"), F.create_map(F.lit("k"), F.col("id") % 1400).alias("m"),
        F.when(F.col("id") % 9 > 0, (F.col("id") % 2).cast("string")).alias("g"),
    )

    def results(parts):
        dealt = table.repartition(parts)
        scored = anomaly.score_anomalies(dealt, "v", order_by="day").select("day", "v", "m.k", "g", "n", F.round("mean", 6))
        placed = counting.group_by(dealt, "g", "day").select("day", "v", "m.k", "group", "position")
        assert "_tie" not in placed.columns
        return [sorted(map(str, rows.collect())) for rows in (scored, placed)]

    assert results(4) == results(3)
    seen = anomaly.score_anomalies(table, "v", order_by="day").agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(seen) == (3000, 0, 2999)
    unique, order = with_ties_broken(table, ["day"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = with_block(unique, order).groupBy("_block").count()
        assert blocks.count() > 1 and blocks.agg(F.max("count")).first()[0] < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tied_orders_of_nothing(spark):
    nothing = spark.createDataFrame([], "day int, v double")
    assert anomaly.score_anomalies(nothing, "v", order_by="day").count() == 0
    assert counting.group_by(nothing, "v", "day").count() == 0


def test_input_is_read_few_times(spark):
    def passes(work, rows=200):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("double")
        def touched(v):
            seen.add(1)
            return v

        work(spark.range(rows).select("id", touched(F.col("id").cast("double")).alias("v"))).collect()
        return seen.value / rows

    assert passes(lambda t: numeric.summary(t, "v")) == 1
    assert passes(lambda t: anomaly.score_anomalies(t, "v", order_by="id")) <= 2
    assert passes(lambda t: stats(t, "v", numeric=True, order_by="id")) == 1


def test_percentiles(spark):
    random.seed(3)
    for values in ([5.0], [1.0, 2.0], [float(i) for i in range(1, 101)], [float(random.choice([1, 2, 3, 500, random.random()])) for _ in range(777)]):
        table = spark.createDataFrame([(v,) for v in values], "v double")
        ps = [0, 1, 7, 25, 50, 90, 95, 99, 99.9, 100]
        row = numeric.summary(table, "v", ps).first()
        for p in ps:
            assert row[numeric.percentile_name(p)] == smallest_covering(values, p), (len(values), p)
        assert (row["min"], row["max"], row["count"]) == (min(values), max(values), len(values))
        assert row["mean"] == pytest.approx(sum(values) / len(values))


def test_percentiles_of_nothing(entries):
    row = numeric.summary(entries([{"m": "x"}]), "latency").first().asDict()
    assert row == {"p50": 0.0, "p90": 0.0, "p95": 0.0, "p99": 0.0, "min": None, "max": None, "mean": None, "count": 0.0}


def test_numbers_in_text(entries):
    texts = ["5", " 7.5 ", "1e3", "-.5", "x", "5d", "nan", "inf", None, "True", "1_000"]
    frame = entries([{"v": t} for t in texts] + [{}])
    got = [r.n for r in frame.orderBy("seq").select(numeric.numeric(frame, "v").alias("n")).collect()]
    assert got == [5.0, 7.5, 1000.0, -0.5, None, None, None, None, None, 1.0, None, None]
    assert numeric.skipped_count(frame, "v").first()[0] == 7
    assert numeric.median(frame, "v").first()["median"] == 5.0


def test_stats_report(entries):
    frame = entries([{"ms": v} for v in ("1", "2", "2", "x")])
    rows = {(r.section, r.label): r["value"] for r in stats(frame, "ms", 1, numeric=True).collect()}
    assert rows[("total", "entries")] == 4.0 and rows[("top", "2")] == 2.0
    assert rows[("numeric", "p50")] == 2.0 and rows[("numeric", "skipped")] == 1.0


class Detector:
    """Plain statement of the score, one value at a time."""

    def __init__(self, threshold: float = 3.0, min_samples: int = 30) -> None:
        self.threshold, self.min_samples, self.past = threshold, min_samples, []

    def score(self, value: float | None) -> tuple[float | None, bool]:
        if value is None:
            return None, False
        z = None
        if len(self.past) >= self.min_samples and len(set(self.past)) > 1:
            mean = math.fsum(self.past) / len(self.past)
            std = math.sqrt(math.fsum((v - mean) ** 2 for v in self.past) / len(self.past))
            z = abs(value - mean) / std
        self.past.append(value)
        return z, z is not None and z > self.threshold


def check_scores(rows, expected):
    assert len(rows) == len(expected)
    for row, (z, flag) in zip(rows, expected):
        assert row.is_anomaly == flag
        assert (row.z_score is None) == (z is None), row
        if z is not None:
            assert row.z_score == pytest.approx(z, rel=1e-9)


SERIES = [1e6 + (i % 5) + (300 if i % 97 == 0 else 0) for i in range(400)]
SERIES = [None if i % 41 == 0 else v for i, v in enumerate(SERIES)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_anomaly_scores(spark, parts):
    table = spark.createDataFrame(list(enumerate(SERIES)), "i long, v double").repartition(parts)
    scored = anomaly.score_anomalies(table, "v", order_by="i").orderBy("i").collect()
    detector = Detector()
    check_scores(scored, [detector.score(v) for v in SERIES])
    assert [r.skipped for r in scored] == [v is None for v in SERIES]


def test_equal_values_have_no_score(spark):
    table = spark.createDataFrame([(i, 0.1) for i in range(60)] + [(60, 9.0)], "i long, v double")
    scored = anomaly.score_anomalies(table, "v", order_by="i")
    assert scored.where("z_score IS NOT NULL").count() == 0
    assert scored.where("std <> 0").count() == 0


def test_anomaly_keys_and_resets(spark):
    rows = [(i, "ab"[i % 3 == 0], float((i * 7919) % 101)) for i in range(600)]
    table = spark.createDataFrame(rows, "i long, k string, v double")
    scored = anomaly.score_anomalies(
        table, "v", min_samples=5, threshold=1.5, order_by="i", partition_by=["k"], reset_when=F.col("i") % 150 == 0
    )
    detectors = {k: Detector(1.5, 5) for k in "ab"}
    expected = []
    for i, k, v in rows:
        if i % 150 == 0:
            detectors[k] = Detector(1.5, 5)
        expected.append(detectors[k].score(v))
    check_scores(scored.orderBy("i").collect(), expected)


def test_anomalies_of_a_log_frame(entries):
    frame = entries([{"ms": v} if v is not None else {} for v in SERIES])
    scored = anomaly.score_anomalies(frame, "ms").orderBy("seq").collect()
    detector = Detector()
    check_scores(scored, [detector.score(v) for v in SERIES])


def test_line_blocks_follow_large_line_numbers(spark):
    start = 4296 * LINES_PER_BLOCK - 150
    table = spark.range(start, start + 300).select(F.lit("f").alias("file"), F.lit(0).alias("block_start"), F.col("id").alias("seq"))
    cut = with_block(table.union(table.withColumn("seq", F.col("seq") + (1 << 58))), ["file", "block_start", "seq"])
    blocks = [r["_block"] for r in cut.orderBy("seq").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) == 3


def test_moments(spark):
    table = spark.createDataFrame([(2.0,), (4.0,), (None,)], "v double")
    assert tuple(numeric.moments(table, "v").first()) == (2, 3.0, 1.0, 1.0)
    assert tuple(numeric.moments(table.where("false"), "v").first()) == (0, 0.0, 0.0, 0.0)


def test_custom_aggregator_and_output(spark, tmp_path):
    class Sum:  # local, so that it travels with the job
        total = 0.0

        def add(self, entry):
            self.total += float(entry["v"])

        def merge(self, other):
            self.total += other.total

        def result(self):
            return {"total": self.total}

    table = spark.range(1000).select(F.col("id").alias("v")).repartition(7)
    assert custom.aggregate(table, Sum, "total double").first()[0] == 499500.0
    assert custom.aggregate(table.where("v < 0"), Sum, "total double").first()[0] == 0.0
    path = str(tmp_path / "out")
    custom.write_custom(table, lambda rows: "\n".join(f"v={r['v']}" for r in rows), path)
    assert spark.read.text(path).count() == 1000


class Spread:
    """Counts entries and keeps the extremes, by batches of columns."""

    def __init__(self):
        self.n, self.low, self.high = 0, None, None

    def add_batch(self, rows):
        values = rows["v"].dropna()
        self.n += len(rows)
        if len(values):
            self.low = min(x for x in (self.low, float(values.min())) if x is not None)
            self.high = max(x for x in (self.high, float(values.max())) if x is not None)

    def merge(self, other):
        self.n += other.n
        self.low = min((x for x in (self.low, other.low) if x is not None), default=None)
        self.high = max((x for x in (self.high, other.high) if x is not None), default=None)

    def result(self):
        return {"n": self.n, "low": self.low, "high": self.high}


class Listed(Spread):
    """The same, entry by entry."""

    add_batch = property()  # hasattr() is false

    def add(self, entry):
        self.n += 1
        if entry["v"] is not None:
            self.low = min(x for x in (self.low, entry["v"]) if x is not None)
            self.high = max(x for x in (self.high, entry["v"]) if x is not None)


@pytest.mark.parametrize("make", [Spread, Listed])
@pytest.mark.parametrize("held", [10_000, 1])
def test_custom_aggregator_by_key(spark, monkeypatch, make, held):
    monkeypatch.setattr(custom, "HELD_KEYS", held)
    rows = [(["hot", "a", "b", None][0 if i % 2 else i % 8 // 2], float(i) if i % 5 else None) for i in range(2000)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(7)
    assert table.rdd.getNumPartitions() == 7  # half the rows are one key's, in all tasks
    got = {r.k: (r.n, r.low, r.high) for r in custom.aggregate(table, make, "n long, low double, high double", ["k"]).collect()}
    want = {}
    for k in ("hot", "a", "b", None):
        values = [v for key, v in rows if key == k and v is not None]
        want[k or "unknown"] = (sum(key == k for key, _ in rows), min(values), max(values))
    assert got == want
    assert custom.aggregate(table.where("false"), make, "n long, low double, high double", ["k"]).collect() == []
    alone = custom.aggregate(table.where("k = 'a' AND v IS NULL"), make, "n long, low double, high double", ["k"]).first()
    assert alone.n > 0 and alone.low is None


def test_quantile_sketches_merge(spark):
    rows = [(i % 7, float((i * 7919) % 10_007), None) for i in range(10_007)] + [(1, 5.0, None)] * 3000 + [(9, None, None)]
    table = spark.createDataFrame(rows, "part long, v double, w double")
    parts = sketches.quantile_sketches(table, "v", ["part"])
    merged = sketches.quantiles(sketches.merge_quantiles(parts), [0, 10, 50, 99.9, 100]).first()
    values = sorted(v for _, v, _ in rows if v is not None)
    assert merged.n == len(values) and parts.count() == 7
    for name, share in (("p0", 0), ("p10", 0.1), ("p50", 0.5), ("p99_9", 0.999), ("p100", 1)):
        low, high = (f(values, merged[name]) / len(values) for f in (bisect.bisect_left, bisect.bisect_right))
        assert low - 3 * sketches.rank_error() <= share <= high + 3 * sketches.rank_error()
    assert sketches.rank_error(800) < sketches.rank_error() < 0.01
    assert sketches.quantile_sketches(table, "w", ["part"]).collect() == []
    assert sketches.quantiles(sketches.merge_quantiles(sketches.quantile_sketches(table, "w")), [50]).first().p50 is None


def test_distinct_sketches_merge(spark):
    table = spark.range(30_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 12_000).cast("string").alias("v"))
    parts = sketches.distinct_sketches(table, "v", ["part"])
    whole = sketches.distinct_counts(sketches.merge_distinct(sketches.distinct_sketches(table, "v"))).first()
    merged = sketches.distinct_counts(sketches.merge_distinct(parts)).first()
    assert merged.groups == whole.groups and abs(merged.groups - 12_000) < 5 * sketches.distinct_error() * 12_000
    missing = spark.createDataFrame([(None,), (None,)], "v string")
    assert sketches.distinct_counts(sketches.distinct_sketches(missing, "v")).first().groups == 1
    assert sketches.distinct_sketches(table.where("false"), "v", ["part"]).collect() == []
