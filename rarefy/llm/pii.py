"""Op 7: personal data found by anchor expansion.

One Aho-Corasick pass over a whole text reports anchors: at-signs, plus signs
before a digit, digits, URL schemes and identifier cues.  From each anchor a
small deterministic parser expands the candidate, validates it and fixes its
boundaries.  Texts without anchors cost the one pass.

Base kinds (fixed by contract): ``email``, ``ip``, ``card``, ``phone``.
Added by this method: ``url`` (a URL that carries user info or an identity
parameter), ``iban`` (checksum), ``ssn``, ``account`` and ``secret`` (values
assigned to a cue such as ``account no:`` or ``token =``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "account", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}
UPPER = re.compile(r"[A-Z]+")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"']+")
USER_INFO = re.compile(r"://[^\s/?#@]+@")
IDENTITY_PARAMETER = re.compile(r"[?&](?:email|e-mail|user|username|login|token|key|api_key|apikey"
                                r"|password|session|sid|phone|ssn)=[^&#\s]+", re.I)
# Between a cue and its value: an optional word such as "no.", then : = or #.
JOIN = re.compile(r"(?:[ _-]?(?:number|no|nr|id|key))?\.?[\"']?[ \t]*+(?:[:=#]|is\b)[ \t]*+[\"']?",
                  re.I)
ACCOUNT = re.compile(r"[A-Z]{0,4}[0-9](?:[\x20-]?[0-9]){5,}")
SSN = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9])")
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
# Cue -> parser, in any case.
CUES = {
    "account": "account", "acct": "account", "konto": "account", "cuenta": "account",
    "compte": "account", "passport": "account", "ssn": "ssn", "social security": "ssn",
    "iban": "iban", "token": "secret", "password": "secret", "passwd": "secret",
    "secret": "secret", "api key": "secret", "api_key": "secret", "apikey": "secret",
    "access key": "secret", "access_key": "secret", "bearer": "secret",
}

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    machine = ahocorasick.Automaton()
    machine.add_word("@", ("at", 1))
    for d in "0123456789":
        machine.add_word(d, ("digit", 1))
        machine.add_word("+" + d, ("plus", 2))
    for s in SCHEMES:
        machine.add_word(s, ("scheme", len(s)))
    for cue, parser in CUES.items():
        machine.add_word(cue, (parser, len(cue)))
    machine.make_automaton()
    return machine


def ascii_lower(text: str) -> str:
    """ASCII letters in lower case: as long as the text, unlike ``str.lower``."""
    if text.isascii():
        return text.lower()
    return UPPER.sub(lambda m: m.group().lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _ips(text: str, start: int, end: int) -> Iterator[Span]:
    """Runs of four dotted numbers inside text[start:end] (digits and dots only)."""
    at, run = start, []
    for part in text[start:end].split("."):
        if part:
            run.append((at, part))
            if len(run) == 4:
                if all(len(p) < 4 or not p[:-3].strip("0") for _, p in run) \
                        and all(int(p[-3:]) <= 255 for _, p in run):
                    yield "ip", run[0][0], at + len(part)
                run = []
        else:
            run = []
        at += len(part) + 1


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _cue_span(text: str, kind: str, after: int, digitless: list[int]) -> Span | None:
    """The value assigned to a cue that ends at ``after``.

    ``digitless`` holds the end of the last run read that is no secret for want
    of a digit: cues inside it do not read it again.
    """
    join = JOIN.match(text, after)
    at = join.end() if join else after
    if kind == "iban":
        at = join.end() if join else after + (text[after:after + 1] == " ")
        found = IBAN.match(text, at)
        while found:
            end = found.end()
            if _iban(text[at:end]):
                return "iban", at, end
            # A following word may have been taken for a group: give it back.
            cut = text.rfind(" ", at, end)
            found = IBAN.fullmatch(text, at, cut) if cut > at else None
        return None
    if kind == "ssn":
        if not join:
            at = after + (text[after:after + 1] == " ")
        found = SSN.match(text, at)
        return ("ssn", at, found.end()) if found else None
    if not join:
        return None
    if kind == "account":
        found = ACCOUNT.match(text, at)
        return ("account", at, found.end()) if found else None
    found = SECRET.match(text, at) if at >= digitless[0] else None
    if found:
        value = found.group().rstrip(".=")
        if not DIGIT.search(value):
            digitless[0] = found.end()
        elif len(value) >= 8:
            return "secret", at, at + len(value)
    return None


def find_spans(text: str) -> list[Span]:
    """All spans (kind, start, end) in code points, by start, then kind."""
    out: list[Span] = []
    email_end = number_end = card_end = url_end = 0
    cue_end: dict[str, int] = {}
    digitless = [0]
    for last, (kind, size) in _automaton().iter(ascii_lower(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= number_end:
                number_end = NUMBERS.match(text, at).end()
                if number_end - at >= 7:
                    out.extend(_ips(text, at, number_end))
            if at >= card_end:
                found = CARD.match(text, at)
                if found:
                    card_end = found.end()
                    digits = re.sub("[^0-9]", "", found.group()) if card_end - at <= 40 else ""
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            found = DOMAIN.match(text, at + 1) if start < at else None
            if found:
                email_end = found.end()
                out.append(("email", start, email_end))
        elif kind == "plus":
            found = PHONE.match(text, at)
            if found and 10 <= sum("0" <= c <= "9" for c in found.group()) <= 15:
                out.append(("phone", at, found.end()))
        elif kind == "scheme":
            if at >= url_end:
                url_end = URL.match(text, at).end()
                value = text[at:url_end]
                if USER_INFO.search(value) or IDENTITY_PARAMETER.search(value):
                    out.append(("url", at, url_end))
        elif not text[last + 1:last + 2].isalpha() and not text[max(at - 1, 0):at].isalpha() \
                and at >= cue_end.get(kind, 0):
            span = _cue_span(text, kind, last + 1, digitless)
            if span:
                out.append(span)
                cue_end[kind] = span[2]
    out.sort(key=lambda s: (s[1], RANK[s[0]], s[2]))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by ``<KIND>``; overlapping ones by that of the first."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPAN_COLUMNS = ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                "base_sha256 string, spans string")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            spans = find_spans(value.as_py())
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
            rows.append((*counts, digest, spans_text(spans)))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=["doc", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, all spans.

    Null and empty texts have no spans.  One row per input row (repeated rows
    too, null ids stay null); other columns are ignored; no shuffle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")).mapInArrow(
        on_workers(_find), f"doc {kind}, {SPAN_COLUMNS}")
    return out.withColumnRenamed("doc", doc_id)


def _redact(batches: Iterator[pa.RecordBatch], text_at: int, size_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(batch.columns)
        sizes = cols[size_at].to_pylist() if size_at >= 0 else None
        texts = cols[text_at].to_pylist()
        for i, t in enumerate(texts):
            spans = find_spans(t) if t else []
            if spans:
                texts[i] = redact(t, spans)
                if sizes is not None:
                    sizes[i] = len(texts[i])
        cols[text_at] = pa.array(texts, cols[text_at].type)
        if sizes is not None:
            cols[size_at] = pa.array(sizes, cols[size_at].type)
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced; documents without spans are unchanged.

    ``n_chars`` (where the column exists) follows the new text.  Null texts
    stay null, no row is dropped, all columns are kept.
    """
    names = docs.columns
    size_at = names.index(n_chars) if n_chars in names else -1
    # Plain names inside: mapInArrow does not take names with dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(on_workers(_redact, names.index(text), size_at), plain.schema).toDF(*names)
