from __future__ import annotations

import csv
import io
import json
import pathlib

from cairnlog.operators.counting import write_groups
from cairnlog.sinks import files
from cairnlog.sinks.results import ResultStore, result_key
from cairnlog.sources.parse import parse_auto

from .conftest import ACCESS_LINES, JSON_LINES, SYSLOG_LINES


def text_of(path: pathlib.Path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_ndjson_keeps_types(lines, tmp_path):
    line = '{"b":true,"n":null,"i":1,"f":2.5,"o":{"x":[1]},"s":"1"}'
    frame = parse_auto(lines([line, ACCESS_LINES[0], SYSLOG_LINES[0], "note"]), "line")
    files.write_ndjson(frame.coalesce(1), str(tmp_path / "out"))
    rows = [json.loads(t) for t in text_of(tmp_path / "out").splitlines()]
    assert rows[0] == json.loads(line)
    assert (rows[1]["status"], rows[1]["bytes"], rows[1]["referer"]) == (204, 0, None)
    assert (rows[2]["pid"], rows[2]["priority"]) == ("4021", None)
    assert rows[3] == {"message": "note", "raw": True}
    files.write_ndjson(frame, str(tmp_path / "few"), ["i", "status"], limit=2)
    assert [json.loads(t) for t in text_of(tmp_path / "few").splitlines()] == [{"i": 1}, {"status": 204}]


def test_csv(entries, tmp_path):
    rows = [{"level": "A", "message": 'say "hi", you'}, {"message": " x ", "extra": "1", "level": None}, {"level": "line\nbreak"}]
    files.write_csv(entries(rows).coalesce(1), str(tmp_path / "out"))
    got = list(csv.DictReader(io.StringIO(text_of(tmp_path / "out"))))
    assert got == [
        {"level": "A", "message": 'say "hi", you'},
        {"level": "", "message": " x "},
        {"level": "line\nbreak", "message": ""},
    ]
    files.write_csv(entries(rows).where("false"), str(tmp_path / "none"))
    assert text_of(tmp_path / "none") == ""


def test_html(entries):
    frame = entries([{"level": "Error<", "message": "<b>&\"'", "timestamp": "t"}])
    row = frame.select(files.html_row(frame)).first()[0]
    assert row == (
        '<tr class="level-error&lt;">\n  <td>t</td>\n  <td class="level">Error&lt;</td>\n'
        "  <td>&lt;b&gt;&amp;&quot;&#x27;</td>\n</tr>"
    )


def test_group_folders(entries, spark, tmp_path):
    write_groups(entries([{"k": "a/b"}, {"k": "c"}, {}]), "k", str(tmp_path / "g"))
    assert {r["group"] for r in spark.read.parquet(str(tmp_path / "g")).collect()} == {"a/b", "c", "unknown"}


def test_result_key():
    assert result_key("p", {"a": 1, "b": 2}) == result_key("p", {"b": 2, "a": 1})
    assert len({result_key("p", {"a": 1}), result_key("q", {"a": 1}), result_key("p", {"a": 2}), result_key("p", {"a": 1}, "v2")}) == 4


def test_result_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    runs = []

    def compute():
        runs.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.get_or_compute("k1", compute).count() == 3
    assert len(runs) == 1
    assert store.get("other") is None
    assert store.set("empty", spark.range(0)) and store.get("empty").count() == 0
    assert ResultStore(spark, store.root, ttl=0).get("k1") is None
    assert store.invalidate("k1") and not store.invalidate("k1")
    store.set("k2", spark.range(1))
    assert store.flush("k*") == 1 and store.flush() == 1 and store.flush() == 0


def test_unwritable_store_still_answers(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("x")
    store = ResultStore(spark, str(blocked))
    assert store.set("k", spark.range(1)) is False
    assert store.get_or_compute("k", lambda: spark.range(2)).count() == 2


def test_json_lines_round_trip(lines, tmp_path, spark):
    frame = parse_auto(lines(JSON_LINES))
    files.write_ndjson(frame, str(tmp_path / "again"), order_by=None)
    assert sorted(text_of(tmp_path / "again").splitlines()) == sorted(JSON_LINES)
