"""The search language: text to a SearchSpec (OP-030 to OP-045)."""

from __future__ import annotations

from dataclasses import dataclass, field

from tagloom.functions.constants import BASE_CATEGORIES, RATINGS, VIDEO_EXTENSIONS

#: Flags of the form has:x and is:x, and what they ask for.
FLAGS = {
    "has:parent": "parent", "has:child": "child", "has:relationship": "relationship", "has:pool": "pool", "has:upscaled": "upscaled", "has:upscale": "upscaled",
    "-has:upscaled": "not_upscaled", "-has:upscale": "not_upscaled", "is:favourite": "favourite", "is:favorite": "favourite", "is:fav": "favourite", "metadata:missing": "metadata_missing",
}


@dataclass(frozen=True)
class SearchSpec:
    terms: tuple[str, ...] = ()
    free: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    filename: str | None = None
    pool: str | None = None
    flags: frozenset[str] = frozenset()
    in_category: tuple[tuple[str, str], ...] = ()
    ratings: tuple[str, ...] = ()
    order: str | None = None

    @property
    def is_all(self) -> bool:
        return self == SearchSpec()


@dataclass
class _Building:
    terms: list[str] = field(default_factory=list)
    free: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    in_category: list[tuple[str, str]] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)
    ratings: list[str] = field(default_factory=list)
    one: dict[str, str] = field(default_factory=dict)


def rating_of(token: str) -> str | None:
    """rating:x, rating_x, and either with a general: or meta: before it; None for anything else."""
    for prefix in ("general:", "meta:"):
        if token.startswith(prefix + "rating"):
            token = token[len(prefix) :]
    name = "rating:" + token[7:] if token[:7] in ("rating:", "rating_") else None
    return name if name in RATINGS else None


def parse(query: str | None) -> SearchSpec:
    """Tokens in order, each by the first rule that fits; an open quote takes words until it closes."""
    b, quoted = _Building(), False
    for token in (query or "").lower().split():
        head, _, tail = token.partition(":")
        if head == "source" and tail:
            b.sources.append(tail)
        elif head in ("filename", "pool", "order") and tail:
            b.one[head] = tail
        elif token in FLAGS:
            b.flags.add(FLAGS[token])
        elif token == "has:video":
            b.extensions += VIDEO_EXTENSIONS
        elif token.startswith(".") and len(token) > 1 and not quoted:
            b.extensions.append(token[1:])
        elif token.startswith("-") and len(token) > 1 and not quoted:
            b.negative.append(token[1:])
        elif quoted or token.startswith('"'):
            quoted = not token.endswith('"') or token == '"' and not quoted
            if word := token.strip('"'):
                b.free.append(word)
        elif rating := rating_of(token):
            b.ratings.append(rating)
        elif head in BASE_CATEGORIES and tail:
            b.in_category.append((head, tail))
        else:
            b.terms.append(token)
    once = lambda x: tuple(dict.fromkeys(x))
    return SearchSpec(
        once(b.terms), once(b.free), once(b.negative), once(b.sources), once(b.extensions), b.one.get("filename"), b.one.get("pool"), frozenset(b.flags), once(b.in_category), once(b.ratings), b.one.get("order")
    )
