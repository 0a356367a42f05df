"""Shapes of replies told apart in one column."""

import json

import pytest

from skriva.sources import replies


def test_shapes(spark):
    voices = {"voices": [{"voice_id": "2", "name": "bo", "labels": {"accent": "scots", "descriptive": "very_calm"}}, {"voice_id": "1", "name": "Al", "category": "pre_made"}, {"name": "no id"}]}
    release = {"tag_name": "v1.2", "html_url": "https://page", "assets": [{"name": "x-1", "browser_download_url": "http://no"}, {"name": "x-2", "browser_download_url": "https://late"}]}
    given = [
        ({"models": [{"name": "a:1", "size": 3}, {"name": "b"}]}, "models", ["a:1", "b"]), ({"models": []}, "models", []), ({"status": "pulling", "total": 8, "completed": 2}, "progress", ("pulling", 0.25)),
        ({"status": "done", "total": 0, "completed": 2}, "progress", ("done", None)), ({"error": "no such", "status": "x"}, "error", "no such"), (voices, "voices", [("1", "Al", "pre_made"), ("2", "bo", "scots, very calm")]),
        (release, "release", ("1.2", "", "https://page")), ({"response": "　 hé\n", "done_reason": "length", "eval_count": 9}, "reply", ("hé", True, None, 9)), ({"response": ""}, "reply", ("", False, None, None)),
        ({"display_name": "Far", "address": {}}, "place", "Far"), ({"address": {"town": "Hay", "country": "Wales"}}, "place", "Hay, Wales"), ({"q": 1}, "other", None), ([1], "other", None), (7, "other", None), (None, "other", None),
        ({"error": None, "response": "x"}, "reply", ("x", False, None, None)), ({"models": "none"}, "models", None), ({"status": "s", "total": "many", "completed": 1}, "progress", ("s", None)),
    ]
    lines = [(i, json.dumps(x), None) for i, (x, _, _) in enumerate(given)] + [(100, '{"status": "cut', "clash"), (101, "  ", None), (102, None, None), (103, "　", None)]
    got = {r.i: r for r in replies.read_replies(spark.createDataFrame(lines, "i int, line string, other string"), platform="x-").collect()}
    assert got[100].kind == "broken" and set(got) == {*range(len(given)), 100}
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else tuple(v) if isinstance(v, tuple) else v
    with pytest.raises(ValueError, match="kind"):
        replies.read_replies(spark.createDataFrame([("x", 1)], "line string, kind int"))
    for i, (_, kind, want) in enumerate(given):
        row = got[i]
        assert row.kind == kind, i
        if kind != "other":
            assert plain(row[kind]) == want, i
        assert all(row[k] is None for k in set(replies.SHAPES.values()) - {kind})


def test_downloads_end_at_their_first_error(spark):
    line = lambda **x: json.dumps(x)
    rows = [("a", 1, line(status="p", total=4, completed=1)), ("a", 2, line(status="q", total=4, completed=2)), ("a", 3, "{"), ("b", 1, line(status="p")), ("b", 2, line(error="full")), ("b", 3, line(status="no")), ("b", 4, line(error="later")), ("c", 1, line(error="gone")), (None, 1, line(status="p")), (None, 2, line(error="e"))]
    read = replies.read_replies(spark.createDataFrame(rows, "model string, n int, line string").repartition(3))
    got = {tuple(r) for r in replies.downloads(read, "model", "n").collect()}
    assert got == {("a", "q", 0.5, None), ("b", "p", None, "full"), ("c", None, None, "gone"), (None, "p", None, "e")}
