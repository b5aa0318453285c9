"""Functions on literals, one case for every trap that the formats set."""

import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from tidemark.functions import collections as C
from tidemark.functions import dates as D
from tidemark.functions import numbers as M
from tidemark.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(("given", "wanted"), [("  a \t", "a"), ("  ", None), ("", None), (None, None), ("a b", "a b")])
def test_clean(spark, given, wanted):
    assert value(spark, T.clean(text(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("0", None), ("false", None), ("null", None), ('"0"', "0"), ('" x "', "x"), ("7", "7"), ("true", "True"), ("2.5", "2.5")])
def test_clean_variant(spark, given, wanted):
    assert value(spark, T.clean_variant(F.parse_json(F.lit(given)))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("133 Elm - 4", ("133 Elm", "4")),
        ("1 A - B - 12", ("1 A - B", "12")),
        ("1 A - much too long", ("1 A - much too long", None)),
        (" 1 A ", ("1 A", None)),
        ("1 A - ", ("1 A -", None)),
        (None, (None, None)),
    ],
)
def test_split_unit(spark, given, wanted):
    assert tuple(value(spark, T.split_unit(text(given)))) == wanted


@pytest.mark.parametrize("entities", [T.unescape_common, T.unescape])
def test_html_to_text(spark, entities):
    html = "<p>One&nbsp;&amp;  two</p><ul><li class=x>a</li><LI>b</li></ul><br/>\r\n\n\n\nend&copy;"
    got = value(spark, T.html_to_text(text(html), entities))
    assert got == "One & two\n- a\n- b\n\nend©"
    assert value(spark, T.html_to_text(text("<b> </b>"), entities)) is None
    assert value(spark, T.html_to_text(text("&amp;lt;"), entities)) == "&lt;"


def test_every_entity_needs_the_full_unescape(spark):
    assert value(spark, T.unescape(text("&eacute;&#233;&#xe9;"))) == "ééé"


def test_every_entity_is_a_character_by_default(spark):
    entities = "&eacute;&#8217;&hellip;&ndash;&#x2014;&amp;eacute; &lt;b&gt; &notit; &bogus;"
    wanted = html.unescape(entities)
    assert value(spark, T.html_to_text(text(f"<p>{entities}</p>"))) == wanted
    assert value(spark, T.list_items(text(f"<li>{entities}</li><li>&nbsp;</li><li>a</li>"))) == [wanted, "a"]
    assert value(spark, T.list_items(text(None))) == []


def test_text_pieces(spark):
    assert value(spark, T.list_items(text("<ul><li> a <b>c</b></li><li></li><li\n>d</li></ul>"))) == ["a c", "d"]
    assert value(spark, T.compose(", ", text(" a "), text(None), text(""), text("b"))) == "a, b"
    assert value(spark, T.compose(", ", text(None), text(" "))) is None
    assert value(spark, T.append_unless_within(text("a long text"), text("long"))) == "a long text"
    assert value(spark, T.append_unless_within(text("a"), text("b"))) == "a\n\nb"
    assert value(spark, T.append_unless_within(text(None), text("b"))) == "b"
    assert [value(spark, T.truthy(text(s))) for s in ("1", "TRUE", "yes", "no", None)] == [True, True, True, False, False]
    assert [value(spark, T.bedrooms(text(s))) for s in ("Studio", "2.5 beds", "none", None)] == [0.0, 2.5, None, None]
    assert [value(spark, T.wanted_status(text(s))) for s in ("PENDING", "x", None)] == ["pending", "available", "available"]
    assert value(spark, T.absolute_url(text("/a"), text("https://h//"))) == "https://h/a"
    assert value(spark, T.with_query(text("u"), [("a", text("x y&z")), ("b", text(None))])) == "u?a=x+y%26z&b="
    assert value(spark, T.authority(text("http://h.example:81/p"))) == "h.example:81"
    assert value(spark, T.backup_stamp(text("db-20250102-030405.sqlite.gz"), "db")) == dt.datetime(2025, 1, 2, 3, 4, 5)
    assert value(spark, T.backup_stamp(text("db-20251302-030405.sqlite.gz"), "db")) is None


@pytest.mark.parametrize(("given", "wanted"), [("2026-10-01T09:00", dt.date(2026, 10, 1)), ("2026", None), ("2026-1-1", None), ("2026-02-30", None), ("", None), (None, None)])
def test_parse_date(spark, given, wanted):
    assert value(spark, D.parse_date(text(given))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [(" Sunday, June 1, 2025 ", dt.date(2025, 6, 1)), ("June 1, 2025", dt.date(2025, 6, 1)), ("6/1/2025", dt.date(2025, 6, 1)), ("12/31/9999", None), ("1 June 2025", None), (None, None)],
)
def test_parse_us_date(spark, given, wanted):
    assert value(spark, D.parse_us_date(text(given))) == wanted


def test_times(spark):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    assert value(spark, D.iso_z(stamp("2025-01-02 03:04:05"))) == "2025-01-02T03:04:05Z"
    assert value(spark, D.iso_z(stamp("2025-01-02 03:04:05.5"))) == "2025-01-02T03:04:05.500000Z"
    assert value(spark, D.epoch_iso(F.lit(1787016624))) == "2026-08-18T03:30:24+00:00".replace("2026-08-18T03:30:24", dt.datetime.fromtimestamp(1787016624, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S"))
    assert value(spark, D.epoch_iso(F.lit(0))) is None
    assert tuple(value(spark, D.iso_week(F.lit("2024-12-30").cast("date")))) == (2025, 1)
    assert value(spark, D.seconds_between(stamp("2025-01-01 00:00:00"), stamp("2025-01-01 00:00:01.5"))) == 1.5


@pytest.mark.parametrize(("given", "wanted"), [("$1,234.50", 1234.5), (" 5 ", 5.0), ("5d", None), ("1_000", 1000.0), ("", None), ("x", None), (None, None), ("-.5e1", -5.0)])
def test_to_number(spark, given, wanted):
    assert value(spark, M.to_number(text(given))) == wanted


def test_numbers(spark):
    assert [value(spark, M.to_integer(text(s))) for s in ("2.5", "3.5", "x")] == [2, 4, None]
    assert [value(spark, M.variant_number(F.parse_json(F.lit(s)))) for s in ("0", '"0"', "false", "null", "3")] == [None, 0.0, None, None, 3.0]
    assert [value(spark, M.backoff_minutes(F.lit(60), F.lit(f))) for f in (0, 2, 4, 9)] == [60, 240, 960, 960]
    assert value(spark, M.backoff_minutes(F.lit(720), F.lit(3))) == 1440
    row = lambda *a: value(spark, M.percent(*(F.lit(x) for x in a)))
    assert (row("succeeded", 0, None), row("running", 1, 0), row("running", 1, 3), row("running", 9, 3)) == (100.0, None, 33.3, 100.0)
    assert value(spark, M.eta_seconds(F.lit("running"), F.lit(2), F.lit(10), F.lit(4.0))) == 16.0
    assert value(spark, M.eta_seconds(F.lit("queued"), F.lit(2), F.lit(10), F.lit(4.0))) is None


def test_collections(spark):
    pairs = F.array(*(F.struct(F.lit(k).alias("Key"), F.lit(v).alias("Value")) for k, v in (("a", "1"), ("b", ""), ("a", "2"))))
    assert value(spark, C.entries_to_map(pairs)) == {"a": "2", "b": ""}
    assert value(spark, C.filled(C.entries_to_map(pairs))) == {"a": "2"}
    assert value(spark, C.filled(F.create_map(F.lit("a"), F.lit("")))) is None
    assert value(spark, C.without_keys(C.entries_to_map(pairs), ["a"])) == {"b": ""}
    assert value(spark, C.flag_names({"x": F.lit("1"), "y": text(None), "z": F.lit("yes")})) == ["x", "z"]
    assert [value(spark, C.json_strings(text(s))) for s in ('["a", 1, "b"]', "{", '{"a": 1}', None)] == [["a", "b"], [], [], []]
    assert value(spark, C.canonical_json(text('{"b": 1, "a": [1, 2]}'))) == '{"a":[1,2],"b":1}'
    assert [value(spark, C.last_items(F.array(F.lit(1), F.lit(2), F.lit(3)), n)) for n in (2, 9, 0)] == [[2, 3], [1, 2, 3], []]
    a, b = (value(spark, C.content_hash([text(x).alias("x"), text(y).alias("y")])) for x, y in (("1", None), (None, "1")))
    assert a != b
