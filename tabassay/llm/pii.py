"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, digit joints,
schemes and identifier cues; small deterministic parsers expand each anchor to its boundaries and
validate it.

Base kinds: email, ip, card, phone. They are the leftmost non-overlapping matches of their patterns
over the whole text, those failing their test dropped. Cues add: login (user and password before the
host of an address with a scheme), secret (value after password, token, api_key and the like), key
(fixed-form access key ids), iban (checked by its remainder). Spans are code points, end exclusive.

Null and empty texts have no spans. Long texts are read whole. Repeated rows stay. Empty tables
give empty results; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import load, texts

# fixed values: kinds in the order of equal starts
KINDS = ("email", "ip", "card", "phone", "login", "secret", "key", "iban")
BASE = KINDS[:4]
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")
KEY_CUES = ("AKIA", "ASIA")
IBAN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"""["']?[ ]?[=:][ ]?["']?([A-Za-z0-9_+/.-]{8,})""")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c in _DIGITS][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _automaton():
    """Anchor -> kind. Digit joints are a digit followed by what may join it to the next digit."""
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", "email")
    a.add_word("://", "login")
    for d in _DIGITS:
        a.add_word(f".{d}", "ip")
        a.add_word(f"+{d}", "phone")
        for e in _DIGITS:
            for joint in ("", " ", "-"):
                a.add_word(d + joint + e, "card")
    for cue in SECRET_CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, "secret")
    for cue in KEY_CUES:
        a.add_word(cue, "key")
    for first in IBAN_LETTERS:
        for d in _DIGITS:
            a.add_word(first + d, "iban")
    a.make_automaton()
    return a


def _email(text, at, floor):
    """The at-sign at ``at``: the longest local part after the last match, then host labels."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    host = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, host.end(), True) if host else None


def _digits_left(text, at, floor):
    while at > floor and text[at - 1] in _DIGITS:
        at -= 1
    return at


def _ip(text, end, floor):
    """``end``: the digit after a dot. The dot may join the first two parts only."""
    start = _digits_left(text, end - 1, floor)
    m = _GROUPS.match(text, start) if start < end - 1 else None
    return (start, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) if m else None


def _card(text, end, floor):
    """``end``: the second digit of a joint; the chain starts where no joint precedes."""
    start = end
    while True:
        if start > floor and text[start - 1] in _DIGITS:
            start -= 1
        elif start - 1 > floor and text[start - 1] in " -" and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    m = _CHAIN.match(text, start)
    if not m:
        return None
    n = sum(c in _DIGITS for c in m[0]) if m.end() - start < 40 else 0
    return start, m.end(), 14 <= n <= 19 and luhn(m[0])


def _phone(text, end, floor):
    m = _PHONE.match(text, end - 1)
    return (end - 1, m.end(), 10 <= sum(c in _DIGITS for c in m[0]) <= 15) if m and end - 1 >= floor else None


def _login(text, end, floor):
    m = _LOGIN.match(text, end + 1)
    return (m.start(), m.end(), True) if m else None


def _secret(text, end, floor):
    m = _VALUE.match(text, end + 1)
    return (m.start(1), m.end(1), True) if m else None


def _key(text, end, floor):
    start = end - 3
    m = _KEY.match(text, end + 1) if start == 0 or not text[start - 1].isalnum() else None
    return (start, m.end(), True) if m else None


def _iban(text, end, floor):
    start = end - 2
    m = _IBAN.match(text, start) if start >= 0 and (start == 0 or not text[start - 1].isalnum()) else None
    return (start, m.end(), True) if m and iban_ok(m[0]) else None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "secret": _secret, "key": _key, "iban": _iban}


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text by start, then kind."""
    floors = dict.fromkeys(KINDS, 0)
    found = []
    for end, kind in _automaton().iter(text):
        floor = floors[kind]
        if end < floor:  # inside the last match of this kind
            continue
        span = _PARSERS[kind](text, end, floor)
        if span and span[0] >= floor:
            floors[kind] = span[1]
            if span[2]:
                found.append((span[0], span[1], kind))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("kind", T.StringType())]))


@F.pandas_udf(_SPANS)
def pii_spans(text: pd.Series) -> pd.Series:
    """Column function: spans of each text."""
    return pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in find(t)] if t else [] for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def pii_masked(text: pd.Series) -> pd.Series:
    """Column function: text with each span, or run of overlapping spans, replaced by its first kind in brackets."""

    def mask(t):
        out, at, spans = [], 0, find(t)
        i = 0
        while i < len(spans):
            start, stop, kind = spans[i]
            while i + 1 < len(spans) and spans[i + 1][0] < stop:
                i += 1
                stop = max(stop, spans[i][1])
            out += [t[at:start], f"[{kind.upper()}]"]
            at, i = stop, i + 1
        return "".join(out) + t[at:]

    return pd.Series([mask(t) if t else t for t in text], dtype=object)


def find_pii(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, pii): the spans of every document."""
    return texts(docs, **columns).select("doc_id", pii_spans("text").alias("pii"))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; null stays null."""
    return docs.withColumn(text_col, pii_masked(F.col(text_col)))


def _count(kind):
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir):
    found = find_pii(load(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(_count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("pii")).alias("spans"))
