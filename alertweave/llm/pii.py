"""Personal data in texts: patterns propose spans, validators confirm them, context scores them.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: their spans depend on pattern and
validator alone. The added kinds ``iban`` (mod-97) and ``ssn`` must also reach a score, which
words nearby raise or lower. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, texts_of

ship(__name__)

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, and takes the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
#: Length by country in the IBAN registry.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a confirmed span without context, and what a word nearby adds or takes.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
ACCEPTED = 0.5
NEAR = 40
_FOR = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|pay", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank|transfer", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
_AGAINST = re.compile(r"version|order|invoice|isbn|serial|part", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local part is the run before it, so no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        right = _DOMAIN.match(text, at)
        if right:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, right.end()
                done = right.end()
        at = text.find("@", max(at + 1, done))


def _found(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for start, end in _found(_IP, text):
        parts = [p.lstrip("0") for p in text[start:end].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield start, end


def cards(text: str) -> Iterator[tuple[int, int]]:
    for start, end in _found(_CARD, text):
        digits = _digits(text[start:end])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield start, end


def phones(text: str) -> Iterator[tuple[int, int]]:
    for start, end in _found(_PHONE, text):
        if 9 <= len(_digits(text[start:end])) <= 15:
            yield start, end


def _ibans(text: str, at: int, to: int, sizes: Callable[[str], Iterable[int]]) -> Iterator[tuple[int, int]]:
    """A proposal may run on into the next account, so the search goes on behind what was
    confirmed of it, or behind its first letter if nothing was.
    """
    while proposal := _IBAN.search(text, at, to):
        start, end = proposal.span()
        code = text[start:end].replace(" ", "")
        size = next((n for n in sizes(code) if n <= len(code) and mod97(code[:n])), 0)
        stop, seen = start, 0
        while seen < size:
            seen += text[stop] != " "
            stop += 1
        if size:
            yield start, stop
        at = max(stop, start + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """First the accounts of their country's length; between them the longest confirmed forms,
    as words in capitals may follow."""
    at = 0
    listed = _ibans(text, 0, len(text), lambda code: [_IBAN_SIZES[code[:2]]] if code[:2] in _IBAN_SIZES else [])
    for start, stop in [*listed, (len(text), len(text))]:
        yield from _ibans(text, at, start, lambda code: range(min(34, len(code)), 14, -1))
        if start < stop:
            yield start, stop
        at = stop


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for start, end in _found(_SSN, text):
        area, group, serial = text[start:end].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield start, end


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns), strict=True))


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    value = START[kind] + (0.3 if _FOR[kind].search(near) else 0) - (0.3 if _AGAINST.search(near) else 0)
    return min(1.0, max(0.0, value))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by kind, then start. Spans of different kinds may overlap."""
    out = []
    for kind, find in FINDERS.items():
        for start, end in find(text):
            value = score(kind, text, start, end)
            if kind in BASE or value >= ACCEPTED:
                out.append((kind, start, end, round(value, 3)))
    return out


def find_pii(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of ``text`` with their scores; null counts as empty and has none."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("score", pa.float64())])
    )
    names = ("kind", "start", "end", "score")

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            rows = [[dict(zip(names, s, strict=True)) for s in spans(x)] for x in texts_of(batch, text)]
            return {out: pa.array(rows, kind)}

        return fn

    return add_columns(df, make, f"`{out}` {SPANS}")


def redact(text: Column, found: Column) -> Column:
    """Replace each span by its kind in brackets; overlapping spans become one."""
    by_place = F.array_sort(found, lambda a, b: F.when(a["start"] < b["start"], -1)
                            .when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(
            F.concat(acc["done"], gap, tag).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    end = lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1))
    return F.aggregate(by_place, state, step, end)


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas in the order of the array."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def summary(df: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans, and the highest score."""
    rows = find_pii(df.select("doc_id", "text")).drop("text")
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(s).alias("spans"),
        F.array_max(F.transform(s, lambda x: x["score"])).alias("top_score"),
    )
