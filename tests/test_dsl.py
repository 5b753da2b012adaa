import pytest

from tagloom.operators.dsl import SearchSpec, parse, rating_of
from tagloom.operators.search import filter_suggestions


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", {}), ("Red", {"terms": ("red",)}), ("red red", {"terms": ("red",)}), ("-blue", {"negative": ("blue",)}), ("source:S", {"sources": ("s",)}), (".PNG .jpg", {"extensions": ("png", "jpg")}),
        ("filename:a filename:b", {"filename": "b"}), ("pool:x", {"pool": "x"}), ("has:upscale", {"flags": frozenset({"upscaled"})}), ("-has:upscaled", {"flags": frozenset({"not_upscaled"})}),
        ("has:video", {"extensions": ("mp4", "webm")}), ("is:fav", {"flags": frozenset({"favourite"})}), ("order:score", {"order": "score"}), ("rating_general", {"ratings": ("rating:general",)}),
        ("general:rating_explicit", {"ratings": ("rating:explicit",)}), ("artist:bob", {"in_category": (("artist", "bob"),)}), ('"long -hair" red', {"free": ("long", "-hair"), "terms": ("red",)}), ('"one"', {"free": ("one",)}),
        ("weird:thing", {"terms": ("weird:thing",)}),
    ],
)
def test_token(query, want):
    assert parse(query) == SearchSpec(**want)


def test_whole_query():
    s = parse("red -blue source:s .png order:score")
    assert (s.terms, s.negative, s.sources, s.extensions, s.order) == (("red",), ("blue",), ("s",), ("png",), "score")
    assert parse("  ").is_all and not s.is_all and parse(None).is_all


def test_rating_names():
    assert rating_of("rating:sensitive") == "rating:sensitive"
    assert rating_of("rating_other") is None


def test_filter_suggestions():
    assert "rating:general" in filter_suggestions("saf")
    assert "order:score" in filter_suggestions("order:s")
    assert filter_suggestions("x") == []
