import datetime as dt

import pytest

from loamdex.errors import PatternError, PatternUnsupported, QueryError
from loamdex.functions import dates
from loamdex.functions.coerce import assignment, coerce, read_env_file
from loamdex.lang.filters import parse_filter
from loamdex.lang.patterns import Hop, parse_pattern
from loamdex.plans.query import Query, compile_query

NOON = dt.datetime(2026, 3, 10, 12, tzinfo=dt.timezone(dt.timedelta(hours=2)))


@pytest.mark.parametrize(
    "text, kwargs",
    [
        ('moored = "south"', {"moored": "south"}),
        ("built > 1950 AND built <= 1988", {"built__gt": 1950, "built__lte": 1988}),
        ('marks CONTAINS "old"', {"marks__contains": "old"}),
        ("needs IS NOT EMPTY", {"needs__not_empty": True}),
        ("needs IS NULL", {"needs__is_null": True}),
        ('key MATCHES "^[ho]"', {"key__matches": "^[ho]"}),
        ("crew IN [2, 5]", {"crew__in": [2, 5]}),
        ("checked < 2025-05-01", {"checked__lt": dt.date(2025, 5, 1)}),
    ],
)
def test_text_and_keywords_say_the_same(yard, text, kwargs):
    assert compile_query(text, yard).ids() == Query(yard).where(**kwargs).ids()


def test_not_keeps_packets_without_the_field(yard):
    assert compile_query('NOT moored = "south"', yard).ids() == ["boats/heron.md", "log.md", "stores/rope.md", "stores/tar.md"]
    assert compile_query("needs IS NULL", yard).ids() == []


def test_precedence(yard):
    assert compile_query('built = 1901 OR kind = "boat" AND NOT moored = "south"', yard).ids() == ["boats/ark.md", "boats/heron.md"]
    assert compile_query('(built = 1901 OR kind = "boat") AND NOT moored = "north"', yard).ids() == ["boats/ark.md", "boats/otter.md"]


def test_words_with_keyword_beginnings_are_fields():
    e, keys = parse_filter('notes = "x" ORDER BY order_no DESC NULLS FIRST, b')
    assert e.field == "notes" and [(k.field, k.desc, k.nulls) for k in keys] == [("order_no", True, "first"), ("b", False, "auto")]


def test_escapes_are_read_once():
    assert parse_filter(r'a = "x\\n\"\t"')[0].value == 'x\\n"\t'


@pytest.mark.parametrize("bad", ["", "a =", "a = b", "a > 1 extra", "a IN [1", "AND", 'a MATCHES "("', "a = 2026-13-40", "(a = 1", "a ? 1"])
def test_bad_text(bad):
    with pytest.raises(QueryError):
        parse_filter(bad)


@pytest.mark.parametrize(
    "word, value",
    [
        ("today", dt.date(2026, 3, 10)),
        ("YESTERDAY", dt.date(2026, 3, 9)),
        ("tomorrow+1w", dt.date(2026, 3, 18)),
        ("today-7d", dt.date(2026, 3, 3)),
        ("today+1h", dt.datetime(2026, 3, 10, 1, tzinfo=dt.timezone.utc)),
        ("now-30m", NOON - dt.timedelta(minutes=30)),
    ],
)
def test_date_words(word, value):
    assert dates.resolve(word, lambda: NOON) == value
    assert parse_filter(f"a < {word}", clock=lambda: NOON)[0].value == value


def test_pattern_ranges():
    hop = lambda r: parse_pattern(f"MATCH (a)-[:f{r}]->(b) RETURN a").hops[0]
    assert hop("") == Hop("f", 1, 1) and hop("*") == Hop("f", 1, None) and hop("*3") == Hop("f", 1, 3) and hop("*2..4") == Hop("f", 2, 4) and hop("*..2") == Hop("f", 1, 2) and hop("*..0") == Hop("f", 1, 0)
    for bad in ("*0", "*3..2"):
        with pytest.raises(PatternError):
            hop(bad)


@pytest.mark.parametrize("clause", ["CREATE (a)", "MATCH (a) SET a.x = 1 RETURN a", "OPTIONAL MATCH (a) RETURN a", "MATCH (a) RETURN sum(a.x)", "MATCH (a)<-[:f]-(b) RETURN a", "MATCH (a), (b) RETURN a", "MATCH (a) RETURN a LIMIT 3", "MATCH (a) WITH a RETURN a", "MATCH (a)-[:f]-(b) RETURN a"])
def test_unsupported_patterns(clause):
    with pytest.raises(PatternError):
        parse_pattern(clause)


def test_words_of_clauses_inside_text_are_fine():
    assert parse_pattern('MATCH (a) WHERE a.title = "SET" RETURN a.set').items[0].field == "set"
    with pytest.raises(PatternUnsupported):
        parse_pattern("MATCH (a) DELETE a")


@pytest.mark.parametrize("text", ["MATCH (a) RETURN b", "MATCH (a) WHERE b.x = 1 RETURN a", "MATCH (a) RETURN a ORDER BY b.x", "MATCH (a) RETURN count(a), a", "RETURN a"])
def test_wrong_patterns(text):
    with pytest.raises(PatternError):
        parse_pattern(text)


def test_coercion(tmp_path):
    assert [coerce(t) for t in ("7", "-1.5", "true", "null", '"7"', "2026-05-01", "x y", "+49123", "1e3", ".5", "1.")] == [7, -1.5, True, None, "7", dt.date(2026, 5, 1), "x y", "+49123", "1e3", ".5", "1."]
    assert assignment("a=b=c") == ("a", "b=c")
    (tmp_path / "env").write_text("# c\nexport A=1\nB='x y'\n\nC=\n")
    assert read_env_file(str(tmp_path / "env")) == {"A": "1", "B": "x y", "C": ""}
