from __future__ import annotations

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from cairnlog.functions.fields import field, has_field, numeric
from cairnlog.sources import parse
from cairnlog.sources.formats import detect_format
from cairnlog.sources.lines import read_lines

from .conftest import ACCESS_LINES, JSON_LINES, SYSLOG_LINES, dicts


def test_detect_format(lines):
    cases = [
        ("{never closed", "json"),
        (JSON_LINES[3], "json"),
        (ACCESS_LINES[0], "apache"),
        (SYSLOG_LINES[0], "syslog"),
        ("<191>Dec\tthen anything", "syslog"),
        ("<191> Dec 3 09:01:02 box app: x", "raw"),
        ("May be", "syslog"),
        ("Mayor", "raw"),
        ("- - - [", "apache"),
        ("one two [three", "raw"),
        ("[1, 2]", "raw"),
    ]
    found = lines([c for c, _ in cases]).select("seq", detect_format(F.col("raw")).alias("f")).orderBy("seq")
    assert [r.f for r in found.collect()] == [f for _, f in cases]


def test_json_drops_what_is_not_an_object(lines):
    texts = [
        '{"a": 1}', "not json", "[1]", "null", '{"a":1} tail', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}",
        '{"a":1}] [{"b":2}', '{"a":[{"b":1}]}', '{"a":1', "{}", '{"a":"x\ty"}', '{"a":"] }"}', '{"a":"}]"}',
    ]
    frame = parse.parse_json(lines(texts))
    kept = {r.seq for r in frame.collect()}
    assert kept == {i for i, t in enumerate(texts) if _is_object(t)}
    assert kept == {r.seq for r in parse.parse_json(lines(texts), exact=True).collect()}


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def test_json_values_as_text(lines):
    text = '{"t":true,"s":"true","n":null,"x":NaN,"q":"NaN","i":12,"f":1.50,"b":12345678901234567890123,"a":1,"a":2}'
    for exact in (False, True):
        [entry] = dicts(parse.parse_json(lines([text]), exact))
        assert entry == {
            "t": "True", "s": "true", "n": None, "x": "nan", "q": "NaN", "i": "12", "f": "1.5",
            "b": "12345678901234567890123", "a": "2",
        }


def test_typed_entries(lines, spark, tmp_path):
    texts = [
        '{"i":1,"f":1.5,"e":1e3,"big":12345678901234567890123,"t":true,"s":"true","n":null,"l":[1,"x"],"d":{"k":false}}',
        '{"i":"1","f":-2.0,"a.b":2,"it\'s":3,"":4}', "{}", '{"x":NaN,"i":7}', '{"i":1,"i":"last"}',
        '{"i":1} tail', '{"i":1}] [{"i":2}', "[1]", "3", "null", '{"i":1', "not json", '{"o":{"i":1}}', '{"i":1}{"i":2}',
    ]
    frame = parse.parse_json_typed(lines(texts))
    assert {r.seq for r in frame.collect()} == {r.seq for r in parse.parse_json(lines(texts)).collect()} == {0, 1, 2, 3, 4, 12}
    rows = {r.seq: r for r in parse.typed_view(frame, "i bigint, f double, t boolean, n string, l array<string>, `a.b` int, `it's` int").collect()}
    assert (rows[0].i, rows[0].f, rows[0].t, rows[0].n, rows[0].l) == (1, 1.5, True, None, ["1", "x"])
    assert (rows[1]["a.b"], rows[1]["it's"], rows[3].i, rows[4].i) == (2, 3, 7, None)
    kinds = {(r.name, r.kind): r["count"] for r in parse.field_kinds(frame).collect()}
    assert kinds[("i", "int")] == 1 and kinds[("i", "str")] == 3 and kinds[("f", "float")] == 2
    assert {k for n, k in kinds if n in list("tsnld")} == {"bool", "str", "null", "list", "dict"} and kinds[("big", "int")] == 1
    # operators see the same texts and numbers as on a frame of texts; a repeated key counts once, with its last value
    plain = parse.parse_json(lines(texts)).where("seq <> 4")
    for name in ("i", "f", "big", "t", "s", "n", "x", "a.b", "absent"):
        both = [
            [tuple(r) for r in f.select(field(f, name, "-"), numeric(f, name), has_field(f, name)).orderBy("seq").collect()]
            for f in (plain, frame.where("seq <> 4"))
        ]
        assert both[0] == both[1], name
    assert [r[0] for r in frame.where("seq = 4").select(field(frame, "i")).collect()] == ["last"]
    frame.write.parquet(str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).where(F.try_variant_get("fields", "$.i", "int") == 7).count() == 1
    assert parse.field_kinds(parse.parse_json_typed(lines([]))).collect() == []
    with pytest.raises(ValueError):
        field(frame, "both \" and '")


def test_a_line_may_hold_several_entries(lines):
    def parts(line):
        if line.startswith("bad"):
            yield {"n": 0}
            raise ValueError(line)
        for word in line.split():
            yield {"n": len(word), "word": word, "other": 1}

    frame = parse.parse_rows(lines(["one three", "bad", "seven", "one three", "   "]), parts, "word string, n int, none double")
    rows = frame.orderBy("seq", "entry_no").collect()
    assert [(r.seq, r.entry_no, r.word, r.n, r.none) for r in rows] == [
        (0, 0, "one", 3, None), (0, 1, "three", 5, None), (1, 0, None, 0, None), (2, 0, "seven", 5, None), (3, 0, "one", 3, None), (3, 1, "three", 5, None),
    ]
    assert parse.parse_rows(lines([]), parts, "n int").collect() == []


def test_access_log(lines):
    frame = parse.parse_access_log(lines([*ACCESS_LINES, "half [an access] \"line"]))
    rows = parse.access_view(frame).orderBy("seq").collect()
    assert [(r.method, r.status, r.bytes, r.level) for r in rows] == [
        ("HEAD", 204, 0, "INFO"), ("DELETE", 503, 88, "ERROR"),
    ]
    assert set(dicts(frame)[0]) == {
        "host", "timestamp", "method", "path", "protocol", "status", "bytes", "referer", "user_agent", "level",
    }


def test_access_log_edges(lines):
    texts = [
        'h i u [t] "GET /a b c" 0503 - "" "agent x" tail',
        'h i u [t] "PING" 200 12k "http://r/"',
        'h i u [t] "GET / HTTP/1.1" 99999999999999999999 7',
    ]
    first, second, third = dicts(parse.parse_access_log(lines(texts)))
    assert (first["path"], first["protocol"], first["status"], first["bytes"]) == ("/a", "b c", "503", "0")
    assert (first["level"], first["referer"], first["user_agent"]) == ("ERROR", "", "agent x")
    assert (second["method"], second["path"], second["bytes"]) == ("PING", None, None)
    assert (second["referer"], second["user_agent"]) == ("http://r/", None)
    assert (third["status"], third["level"]) == ("9" * 20, "ERROR")


def test_syslog(lines):
    texts = [*SYSLOG_LINES, "<165>Aug  1 10:00:00 h app : x: y", "Mar 9 without a clock", "<9999999999999999999999>Aug 1 10:00:00 h a: m"]
    parsed = dicts(parse.parse_syslog(lines(texts)))
    assert parsed[0] == {
        "timestamp": "Mar  9 23:58:13", "hostname": "edge7", "tag": "dhclient", "pid": "4021",
        "message": "bound to 10.9.8.7", "level": "INFO", "priority": None,
    }
    assert (parsed[1]["tag"], parsed[1]["pid"]) == ("systemd", None)
    assert (parsed[2]["tag"], parsed[2]["message"], parsed[2]["level"], parsed[2]["priority"]) == ("app", "x: y", "NOTICE", "165")
    assert parsed[3] == {"message": "Mar 9 without a clock", "raw": "True"}
    assert parsed[4]["level"] == "DEBUG"


def test_auto_line_detects_every_line(lines):
    frame = parse.parse_auto(lines(["note", ACCESS_LINES[0], JSON_LINES[0], SYSLOG_LINES[0], "{broken", "a b c [x"]), "line")
    assert [r.format for r in frame.orderBy("seq").collect()] == ["raw", "apache", "json", "syslog"]


@pytest.mark.parametrize(
    ("first", "expected"),
    [
        (JSON_LINES[0], ["raw", "json", "json"]),
        (ACCESS_LINES[0], ["raw", "apache", "apache"]),
        (SYSLOG_LINES[0], ["raw", "syslog", "syslog", "syslog", "syslog", "syslog"]),
    ],
)
def test_auto_file_locks_at_the_first_line_that_is_not_raw(lines, first, expected):
    texts = ["note", first, JSON_LINES[1], ACCESS_LINES[1], SYSLOG_LINES[1], "late note"]
    frame = parse.parse_auto(lines(texts), "file")
    assert [r.format for r in frame.orderBy("seq").collect()] == expected
    if first == SYSLOG_LINES[0]:
        assert [e.get("raw") for e in dicts(frame)] == ["True", None, "True", "True", None, "True"]


def test_auto_file_without_any_format(lines):
    assert [e["message"] for e in dicts(parse.parse_auto(lines(["x", "y"]), "file"))] == ["x", "y"]


def test_parse_as(lines):
    assert parse.parse_as(lines(JSON_LINES), "json").count() == 5
    assert parse.parse_as(lines(JSON_LINES), "apache").count() == 0
    assert parse.parse_as(lines(JSON_LINES + ["x"])).count() == 5
    with pytest.raises(ValueError, match="unknown format"):
        parse.parse_as(lines(JSON_LINES), "xml")


def test_text_of_several_lines_is_not_taken_for_groups(lines):
    texts = ["h\nt\nGET / x\n200\n5\n\n", "1\nAug  1 10:00:00\nh\nt\n\nm"]
    assert parse.parse_access_log(lines([texts[0] + '"q"'])).count() == 0
    assert [e.get("raw") for e in dicts(parse.parse_syslog(lines(texts)))] == ["True", "True"]


def test_custom_parsers(lines):
    by_column = parse.parse_custom(
        lines(["k=v", "other"]), "pair",
        lambda raw: F.when(raw.contains("="), F.create_map(F.lit("k"), F.substring_index(raw, "=", -1))),
    )
    by_python = parse.parse_custom(
        lines(["k=v", "other"]), "pair", parse.python_fields(lambda t: {"k": t[2:]} if "=" in t else None)
    )
    assert dicts(by_column) == dicts(by_python) == [{"k": "v"}]


def test_read_lines_keeps_file_order_at_any_split_size(spark, tmp_path: pathlib.Path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for part in range(3):
        body = "".join(f"  line {part} {i}\t\n\n" for i in range(2000))
        (folder / f"{part}.log").write_text(body)
    (folder / "bad.log").write_bytes(b"caf\xe9 \x85\n\xc2\x85 nel \xe3\x80\x80\n")
    expected = [f"line {part} {i}" for part in range(3) for i in range(2000)] + ["caf� �", "nel"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "20000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_lines(spark, str(folder)).orderBy("file", "block_start", "seq").collect()
            assert [r.raw for r in rows] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_file(spark, tmp_path: pathlib.Path):
    (tmp_path / "empty.log").write_text("\n")
    assert parse.parse_auto(read_lines(spark, str(tmp_path))).count() == 0


def test_parse_is_evaluated_once(lines, capsys):
    parse.parse_json(lines(JSON_LINES)).where(F.col("fields")["level"] == "ERROR").explain()
    plan = capsys.readouterr().out
    # once in the branch of lines with words that are told apart by type, once in that of the others
    assert plan.count("concat([, raw") == 2 and "Filter (isnotnull(fields#" in plan
