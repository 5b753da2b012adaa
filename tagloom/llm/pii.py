"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
"://" and cue words of accounts and secrets.  From each anchor a local parser
expands to the boundaries of what may stand there and validates it.  Parsers
look at each character a bounded number of times, so long runs cost no more
than their length.  Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import per_process, slices

#: Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "address")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Cue words, fixed values: what an account number or a secret usually follows, in four languages, lower case.
ACCOUNT_CUES = ("account", "acct", "compte", "cuenta", "iban", "konto", "kontonummer")
SECRET_CUES = ("api-key", "api_key", "apikey", "clave", "contraseña", "geheimnis", "jeton", "kennwort", "mot de passe", "passwd", "password", "passwort", "secret", "token")


def written(cue: str) -> set[str]:
    """The ways a cue is written: lower case, capitals, or its first letter large."""
    return {cue, cue.upper(), cue[0].upper() + cue[1:]}


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9\x20-]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[\x20\t]*(?:[Nn]o\.?|[Nn]umber|[#:=]))*[\x20\t]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_./+=-]{12,})")
_AUTHORITY = re.compile(r"[^\x20\t\n\r\x0b\f/@\"'<>]+@[^\x20\t\n\r\x0b\f\"'<>]+")
Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    turned = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _build():  # noqa: ANN202
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors = {c: "digit" for c in "0123456789"} | {"@": "at", "+": "plus", "://": "scheme"}
    anchors |= {w: kind for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)) for c in cues for w in written(c)}
    for text, kind in anchors.items():
        a.add_word(text, kind)
    a.make_automaton()
    return a


def _dotted_quads(text: str, at: int, end: int) -> Iterator[Span]:
    """Four digit groups joined by single dots, leftmost first, each group whole."""
    groups = [m.span() for m in _DIGITS.finditer(text, at, end)]
    k = 0
    while k + 3 < len(groups):
        four = groups[k : k + 4]
        if all(b[0] == a[1] + 1 for a, b in zip(four, four[1:], strict=False)):
            if all(int((text[a:b].lstrip("0") or "0")[:4]) <= 255 for a, b in four):
                yield four[0][0], "ip", four[3][1]
            k += 4
        else:
            k += 1


def spans(text: str | None) -> list[Span]:
    """(start, kind, end) of all personal data in a text, by start, then kind as in KINDS."""
    if not text:
        return []
    found: list[Span] = []
    mail_end = ip_end = card_end = 0
    for last, kind in per_process("anchors", _build).iter(text):
        if kind == "digit":
            if last >= ip_end:
                ip_end = _DOTTED.match(text, last).end()  # type: ignore[union-attr]
                if ip_end - last >= 7:
                    found += _dotted_quads(text, last, ip_end)
            if last >= card_end:
                card_end = _CARD_RUN.match(text, last).end()  # type: ignore[union-attr]
                if card_end - last >= 12:
                    for m in _CARD.finditer(text, last, card_end):
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            found.append((m.start(), "card", m.end()))
        elif kind == "at":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                mail_end = m.end()
                found.append((start, "email", mail_end))
        elif kind == "plus":
            if (m := _PHONE.match(text, last)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((last, "phone", m.end()))
        elif kind == "account":
            if (m := _ACCOUNT.match(text, last + 1)) and (m[1][0].isdigit() or iban(m[1])):
                found.append((m.start(1), "account", m.end(1)))
        elif kind == "secret":
            if m := _SECRET.match(text, last + 1):
                found.append((m.start(1), "secret", m.end(1)))
        elif m := _AUTHORITY.match(text, last + 1):  # an address that names a user
            start = last - 2
            while start > 0 and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            found.append((start, "address", m.end()))
    found.sort(key=lambda s: (s[0], _ORDER[s[1]], s[2]))
    return found


def redacted(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets; overlapping spans are one stretch."""
    found = spans(text)
    if not found or text is None:
        return text
    out, at = [], 0
    k = 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(t.decode("utf-8", "replace"))] for _, _, texts in slices(b.column(1)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text; more columns are ignored).

    spans: array of (kind, start, end), code points, end exclusive, by start and
    then kind.  A null or empty text has none; null and repeated doc_ids pass,
    each row for itself; texts are read whole, however long; bytes that are no
    UTF-8 count as the replacement character; an empty table gives an empty
    result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the base spans' SHA-256, and all spans as text, of rows as from ``find``; without spans 0 and the hash of nothing."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text`` (and ``n_chars`` counted anew where it exists); other columns as they were.

    Each row is changed for itself, so repeated rows stay equal; a null text
    stays null; bytes that are no UTF-8 become the replacement character; an
    empty table stays empty.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            kind, parts = b.schema.field(place).type, []
            for at, to, texts in slices(b.column(place)):
                known = b.column(place).slice(at, to - at).is_valid().to_pylist()
                parts.append(pa.array([redacted(t.decode("utf-8", "replace")) if k else None for t, k in zip(texts, known, strict=True)], kind))
            columns[place] = pa.concat_arrays(parts) if parts else pa.array([], kind)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
