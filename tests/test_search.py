from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnlog.functions.text import java_regex
from cairnlog.operators.search import substring_sql
from cairnlog.functions.timestamps import micros, parse_timestamp, time_bound
from cairnlog.operators import project, search
from cairnlog.operators.predicates import Chain, all_of, any_of, field_equals, python_predicate, regex_search, time_range, where

from .conftest import ACCESS_LINES, JSON_LINES, SYSLOG_LINES, dicts

FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z", "%b %d %H:%M:%S", "%Y-%m-%d"]
STAMPS = [
    "2025-08-01T10:00:00", "2025-08-01T10:00:00Z", "2025-08-01 10:00:00", "2025-08-01", "2025-8-1", "not a date",
    "01/Aug/2025:10:00:00 +0000", "1/aug/2025:1:2:3 -0530", "Aug  1 10:00:00", "Feb 29 10:00:00", "2025-02-30",
    "2025-08-01T10:00:60", "2025-08-01T24:00:00", "2025-08-01T10:00:00.5", "2025-08-01T10:00:00+00:00", "",
    "  2025-08-01  ", "01/Aug/2025:10:00:00", "0000-01-01", "Sep 1 1:1:1", "2024-02-29T01:02:03", "1/13/2025:10:00:00 +0000",
    "2025\n8\n1\n1\n1\n1\n", "2025\n8\n1\n1\n1\n1\nx", "a\nb\nc\nd\ne\nf\ng", "2025-08-01\n10:00:00",
]


def by_strptime(text: str) -> datetime | None:
    for layout in FORMATS:
        try:
            return datetime.strptime(text.strip(), layout).replace(tzinfo=None)
        except ValueError:
            continue
    return None


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_parse_timestamp_agrees_with_strptime(spark):
    table = spark.createDataFrame([(s,) for s in STAMPS], "s string")
    rows = table.select("s", parse_timestamp(F.col("s")).alias("t"), micros(parse_timestamp(F.col("s"))).alias("m")).collect()
    for row in rows:
        assert row.t == by_strptime(row.s), row.s
        if row.t:
            assert row.m == (row.t - datetime(1970, 1, 1)).total_seconds() * 1e6


def test_syslog_year(spark):
    table = spark.createDataFrame([("Feb 29 10:00:00",)], "s string")
    assert table.select(parse_timestamp(F.col("s"), 2024)).first()[0] == datetime(2024, 2, 29, 10)


def test_bounds(spark):
    one = spark.range(1)
    assert one.select(time_bound("2025-12-01T10:05")).first()[0] == datetime(2025, 12, 1, 10, 5)
    ago = one.select(F.localtimestamp() - time_bound("30m")).first()[0]
    assert 1799 < ago.total_seconds() < 1801
    with pytest.raises(ValueError, match="not a date"):
        time_bound("yesterday")


def messages(frame) -> list[str]:
    return [e["message"] for e in dicts(frame)]


def test_regex_search(entries):
    frame = entries([{"message": "fan 3 stalled"}, {"message": "fine", "unit": "FAN"}, {"message": "idle", "unit": None}])
    assert messages(where(frame, regex_search("Fan"))) == ["fan 3 stalled", "fine"]
    assert messages(where(frame, regex_search("fan", ["message"]))) == ["fan 3 stalled"]
    assert messages(where(frame, regex_search("Fan", ignore_case=False))) == []
    assert messages(where(frame, regex_search("none"))) == ["idle"]
    assert messages(where(frame, regex_search("unit"))) == []
    assert messages(where(frame, regex_search("^fan.+ed$\\Z", flags=re.MULTILINE))) == ["fan 3 stalled"]


# fmt: off
PATTERNS = [
    r"(?P<user_id>\d+)", r"a[[]b", r"us{,3}er", r"[u&&x]ser", r"(?P<a_b>x)y(?P=a_b)", r"^b", r"a.b", r"[]a]x", r"[^]a]x", r"x{2}",
    r"x{2,}y", r"x{", r"{x}", r"a{b}", r"\x41", r"\u0041b", r"[\b]", r"end\Z", r"\Astart", r"(?i)ABC", r"(?s)a.b", r"[a-z&&b]",
    r"a(?#comment)b", r"\$\{x\}", r"[[:alpha:]]", r"(?<=a)b", r"(?!a)b", r"\d+\.\d+", r"[\w.-]+@[\w-]+", r"a|b|", r"\101", r"[é-ü]",
    r"\bdog\b", r"a\\b", r"[\]x]", r"[\\]", r"\t", r"(?:a{1,2})?c", r"^$", r"#x", r"[#]", r"\W", r"\S+\s\S+", r"(a)(b)\2", r"(?:ab)+",
    r"a??b", r".*?c", r"[^\n]", r"[-a]", r"[a-]", r"~", r"<x>", r"&&", r"[&]", r"\-", r"x*y", r"\Ax$",
]
TEXTS = [
    "user 42", "a[b", "user", "uuuer", "xser", "&ser", "xyx", "abc\nb", "a\nb", "axb", "]x", "ax", "bx", "xx", "xxxy", "x{", "{x}", "a{b}",
    "A", "Ab", "AB", "\x08", "the end", "end\n", "start", "abc", "ab", "${x}", ":]", "l]", "3.14", "me@x-y", "", "b", "ü", "dog", "hot dogs",
    "a\\b", "\\", "\t", "aac", "c", "#x", "a b", "abb", "abab", "-", "~", "<x>", "&&", "&", "x", "x\n",
]
# fmt: on


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_patterns_mean_what_they_mean_in_python(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    kinds = [(0, True), (re.MULTILINE, False), (re.DOTALL, False)]
    columns = [F.col("t").rlike(java_regex(p, lower, flags)).alias(f"c{n}_{k}") for n, p in enumerate(PATTERNS) for k, (flags, lower) in enumerate(kinds)]
    for row in table.select("t", *columns).collect():
        for n, p in enumerate(PATTERNS):
            for k, (flags, lower) in enumerate(kinds):
                want = re.search(p, row.t, flags | (re.IGNORECASE if lower else 0)) is not None
                assert row[f"c{n}_{k}"] == want, (p, flags, row.t)


# fmt: off
PIECES = [
    "a", "b", "é", "3", r"\d", r"\D", r"\w", r"\W", r"\s", r"\S", " ", "  # list [1 (", "#", "\n", r"[ab ]", r"[^a\s]", r"[\s\d]", r"[\Sb]",
    r"[^\d#]", "(a)", "(?:b|3)", r"\1", ".", "^", "$", "*", "+", "?", "{1,2}", "|", r"\ ", r"\#", r"\b", "٣", "(?=a)", "(?i:a)",
]
# fmt: on


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_generated_patterns_match_as_in_python_or_raise(spark):
    rng = random.Random(11)
    cases, refused = [], 0
    while len(cases) < 320:
        pattern = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7)))
        flags = rng.choice([0, re.ASCII, re.VERBOSE, re.VERBOSE | re.ASCII, re.VERBOSE | re.MULTILINE])
        try:
            re.compile(pattern, flags)
        except re.error:
            continue
        try:
            cases.append((pattern, flags, java_regex(pattern, False, flags)))
        except ValueError:
            refused += 1
    assert refused < 100
    texts = ["", "a", "b", "ab", "aab3", "x٣y", "a\x1cb", "a b", "é a", "a#b", "3\n3", "\x85", "aa3", "b\xa0b", "ÉA", "a\n", "[1", "_é٣"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for first in range(0, len(cases), 80):
        some = cases[first : first + 80]
        for row in table.select("t", *[F.col("t").rlike(j).alias(f"c{i}") for i, (_, _, j) in enumerate(some)]).collect():
            for i, (pattern, flags, java) in enumerate(some):
                assert row[f"c{i}"] == (re.search(pattern, row.t, flags) is not None), (pattern, flags, java, row.t)


def test_comments_ascii_and_separators(spark):
    cases = [
        ("foo  # list [1\n [ab]c", re.VERBOSE, {"fooac"}), (r"(?a)\d", 0, {"3"}), (r"a\sb", 0, {"a\x1cb", "a b"}), (r"a\sb", re.ASCII, {"a b"}),
        (r"(a)\1 3", re.VERBOSE, {"aa3"}), (r"a\ b", re.VERBOSE, {"a b"}),
    ]
    rows = ["fooac", "foo [ab]c", "x٣y", "3", "a\x1cb", "a b", "aa3"]
    table = spark.createDataFrame([(r,) for r in rows], "t string")
    for pattern, flags, want in cases:
        found = {r.t for r in table.where(F.col("t").rlike(java_regex(pattern, False, flags))).collect()}
        assert found == want | ({"aa3"} if pattern == r"(?a)\d" else set()), pattern
    for pattern in ("(?i:a)b", r"[^\Sa]"):
        with pytest.raises(ValueError, match="not supported"):
            java_regex(pattern)


def test_patterns_that_cannot_be_are_refused_before_the_job():
    with pytest.raises(re.error):
        java_regex("a(")
    with pytest.raises(ValueError, match="not supported"):
        java_regex(r"(a)?(?(1)b|c)")


def test_time_range(entries):
    days = ("03-09", "03-10", "03-12")
    frame = entries([{"timestamp": f"2031-{d} 06:30:00", "message": d} for d in days] + [{"message": "none"}, {"timestamp": "soon", "message": "junk"}])
    assert messages(where(frame, time_range(start=datetime(2031, 3, 10, 6, 30)))) == ["03-10", "03-12"]
    assert messages(where(frame, time_range(end="2031-03-10T06:30"))) == ["03-09", "03-10"]
    assert messages(where(frame, time_range("2031-03-09T07:00", "2031-03-11"))) == ["03-10"]
    assert messages(where(frame, time_range())) == list(days)


def test_chain(entries):
    frame = entries([{"zone": "a", "temp": "71"}, {"zone": "b", "temp": "70"}, {"zone": "a", "temp": "12"}, {"temp": "70"}])
    temps = lambda rows: [e["temp"] for e in dicts(rows)]
    warm = Chain().add(regex_search("^7", ["temp"])).add(regex_search(".", ["zone"]))
    in_a = Chain().add(lambda df: F.col("fields")["zone"].contains("a"))
    assert len(warm) == 2 and len(warm & in_a) == 3
    assert temps(warm.apply(frame)) == ["71", "70"]
    assert temps((warm & in_a).apply(frame)) == ["71"]
    assert Chain().apply(frame).count() == 4
    assert where(frame, any_of()).count() == 0
    assert where(frame, all_of()).count() == 4
    assert where(frame, any_of(field_equals("zone", "b"), field_equals("absent", "x"))).count() == 1
    assert where(frame, python_predicate(lambda e: e["temp"] == "70")).count() == 2


def test_search_limit_takes_the_first(lines):
    from cairnlog.sources.parse import parse_auto

    frame = parse_auto(lines(JSON_LINES))
    assert messages(search.search(frame, "queue|compact", limit=2)) == ["queue at 91%", "queue at 40%"]
    assert messages(search.search(frame, "error", field="level", since="2031-03-10T00:00")) == ["lost peer fe80::9"]
    assert search.match_count(frame, "queue|compact", limit=1).first().matches == 3
    assert search.first_n(frame, 0).count() == 5


def test_time_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp_ntz '2025-01-01 00:00:00' AS ts, 1 AS a, 2 AS b").write.parquet(path)
    chain = Chain().add(time_range("2025-01-01", timestamp="ts")).add(field_equals("a", "1"))
    chain.apply(spark.read.parquet(path)).select("a").explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts," in plan and "struct<ts:timestamp_ntz,a:int>" in plan


def test_substring_search_wildcards(spark):
    table = spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, "AXB"), (4, None)], "i int, t string")
    assert [r.i for r in search.substring_search(table, "t", "a_b", order_by="i").collect()] == [1, 2]
    assert search.substring_search(table, "t", "x", limit=1).count() == 1
    many = spark.range(1500).select("id", F.lit("x").alias("t"))
    assert search.substring_search(many, "t", "x").count() == 1500


def test_projections(lines, entries):
    from cairnlog.sources.parse import parse_auto

    mixed = parse_auto(lines([ACCESS_LINES[0], SYSLOG_LINES[0], JSON_LINES[1], "plain"]), "line")
    rows = [(r.ts, r.level, r.msg) for r in project.normalise_entry(mixed).orderBy("seq").collect()]
    assert rows == [
        ("09/Mar/2031:23:58:11 +0100", "INFO", "HEAD /health → 204 (0 B)"),
        ("Mar  9 23:58:13", "INFO", "[dhclient] bound to 10.9.8.7"),
        ("2031-03-09T23:59:40", "ERROR", "lost peer fe80::1"),
        ("", "INFO", "plain"),
    ]
    odd = entries([{"level": "", "severity": "warn", "time": "t", "message": None, "body": "b"}])
    assert [(r.ts, r.level, r.msg) for r in project.normalise_entry(odd).collect()] == [("t", "WARN", "b")]
    assert project.default_columns(mixed) == ["host", "timestamp", "method", "path", "status", "bytes", "level"]
    assert project.default_columns(mixed.where("format = 'json'")) == ["timestamp", "level", "message", "peer"]
    assert project.default_columns(mixed.where("false")) == []
    assert dicts(project.select_fields(mixed, ["level", "none"]))[2:] == [{"level": "ERROR"}, {}]
    table = project.field_columns(entries([{"a": None, "b": 1}]), ["a", "b", "c"]).first()
    assert tuple(table) == ("None", "1", "")


def test_substring_sql_binds_names_and_texts(spark):
    rows = [(1, "100% sure"), (2, "it's; DROP TABLE x --"), (3, None), (4, ""), (5, "back\\slash"), (6, "a_b"), (7, "100 sure")]
    spark.createDataFrame(rows, "`the id` int, `odd ' name` string").createOrReplaceTempView("`odd; table %`")

    def found(pattern, **options):
        return [r[0] for r in substring_sql(spark, "`odd; table %`", "`odd ' name`", pattern, order_by="`the id`", **options).collect()]

    assert found("'s; DROP TABLE x --") == [2] and found("\\") == [5] and found("100_ sure") == [1]
    assert found("a%b") == [6] and found("' OR 1 = 1 --") == [] and found("") == [1, 2, 4, 5, 6, 7] and found("", limit=2) == [1, 2]
    for table, field in (("`odd; table %` WHERE true --", "`the id`"), ("`odd; table %`", "true OR `the id`")):
        with pytest.raises(Exception, match="(?i)parse|syntax|identifier"):
            substring_sql(spark, table, field, "x").collect()
    spark.catalog.dropTempView("odd; table %")
