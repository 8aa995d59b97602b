"""Several values packed in one field: the cheapest dialect by minimum description length, then one row per value.

A *dialect* is a set of delimiters with a quote character (or none). The length of a field under a dialect is the
code length of its values plus that of its separators, quotes and of the dialect itself. A value is coded by its class
(a reference number, or words) and, for words, by its symbols; both codes are Shannon lengths taken from counts over
the whole corpus, which each partition adds up for itself, so that only a table of fields x classes x symbols is
shuffled. Digits cost the same in either class and are left out of the comparison, hence the length depends on
the *outline* of a field only (runs of digits written as one ``0``), and each worker scores an outline once.

A quoted stretch is a field within the field: it is one value or a list, whichever is the shorter description; a
stretch of nothing but reference numbers is always a list.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = frozenset(("", "-", "NA"))
#: Single delimiters and families of delimiters that may part the values of one field.
SINGLE = (";", ",", "|", "/", "、", "；", "，", "\t", "\n", " ")
FAMILIES = (";；", ",，、", ";；,，、", ";；,，、|/\t\n", ";；,，、|/\t\n\r ")
FINEST = FAMILIES[-1]
QUOTES = ("", '"', "'")
BLANK = " \t\r\n　 ﻿"
REFERENCE = re.compile(r"(?:[A-Za-z][A-Za-z_.]*:\s*)?[0-9]+(?::[0-9]+)?$")
#: Outlines remembered by a worker; the least recently used go first, and are simply scored again.
MEMO = 50_000
SYMBOLS = 24


@dataclass(frozen=True)
class Dialect:
    delimiters: str
    quote: str


DIALECTS = tuple(Dialect(d, q) for d in ("", *SINGLE, *FAMILIES) for q in QUOTES)


def outline(text: str) -> str:
    return re.sub("[0-9]+", "0", text)


def _symbol(ch: str) -> str:
    if ch.isalpha():
        return "a"
    if ch.isdigit():
        return "0"
    if ch.isspace():
        return " "
    return ch if ch in ";,|/、；，\"'[]:.-()" else "?"


def _strip(text: str) -> str:
    return text.strip(BLANK)


def _unbracket(text: str) -> str:
    t = _strip(text)
    return _strip(t[1:-1]) if len(t) > 1 and t[0] == "[" and t[-1] == "]" else t


@lru_cache(maxsize=256)
def _patterns(delimiters: str, quote: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Compiled for a dialect: a delimiter; what must follow a closing quote; a run of quotes."""
    one = f"[{re.escape(delimiters)}]" if delimiters else "(?!)"
    blank = f"[{re.escape(BLANK)}]*"
    return re.compile(one), re.compile(f"{one}|{blank}(?:{one}|$(?![\\s\\S]))"), re.compile(re.escape(quote) + "+" if quote else "(?!)")


def pieces(text: str, dialect: Dialect) -> list[tuple[str, bool]]:
    """(content, was quoted) of the non-empty places between the delimiters; a doubled quote inside quotes is one quote.

    A quote opens only at the start of a place and closes only before a delimiter or the end; an unclosed one is text.
    One pass finds all runs of quotes, one from right to left the next run that may close; so the time is linear, however
    many quotes stay open: in a run of quotes the pairs are content, and an odd one out closes if what follows allows it.
    """
    t, q = _unbracket(text), dialect.quote
    delimiter, follows, run = _patterns(dialect.delimiters, q)
    if not q or q not in t:
        return [(p, False) for x in (delimiter.split(t) if dialect.delimiters else [t]) if (p := _strip(x))]
    runs = [m.span() for m in run.finditer(t)]
    at = {a: k for k, (a, _) in enumerate(runs)}
    ends = [bool(follows.match(t, b)) for _, b in runs]
    closing, later = [-1] * (len(runs) + 1), -1  # the first run from k on that closes a quote opened before it
    for k in range(len(runs) - 1, -1, -1):
        if ends[k] and (runs[k][1] - runs[k][0]) % 2:
            later = k
        closing[k] = later
    out: list[tuple[str, bool]] = []
    start, n = 0, len(t)
    while start <= n:
        i = start
        while i < n and t[i] in BLANK and t[i] not in dialect.delimiters:
            i += 1
        if (k := at.get(i)) is not None:
            a, b = runs[k]
            close = b - 1 if ends[k] and (b - a) % 2 == 0 else runs[closing[k + 1]][1] - 1 if closing[k + 1] >= 0 else -1
            if close > i:
                out.append((t[i + 1 : close].replace(q + q, q), True))
                m = delimiter.search(t, close + 1)
                start = m.end() if m else n + 1
                continue
        m = delimiter.search(t, i)
        end = m.start() if m else n
        if piece := _strip(t[start:end]):
            out.append((piece, False))
        start = m.end() if m else n + 1
    return out


class ValueCode:
    """Code lengths of one field, in bits, from its counts of value classes and of the symbols in wordy values."""

    def __init__(self, counts: Mapping[tuple[str, str], int]):
        kinds = {k: counts.get(("kind", k), 0) + 1 for k in ("ref", "words")}
        total = sum(kinds.values())
        self.kind = {k: -math.log2(v / total) for k, v in kinds.items()}
        symbols = Counter({s: n for (what, s), n in counts.items() if what == "symbol"})
        whole = sum(symbols.values()) + SYMBOLS
        self.symbol = {s: -math.log2((n + 1) / whole) for s, n in symbols.items()}
        self.unseen = -math.log2(1 / whole)
        self.extra = {"a": math.log2(26)}

        self.known: dict[str, float] = {}

    def value(self, text: str) -> float:
        cost = self.known.get(text)
        if cost is None:
            cost = self._value(text)
            if len(text) <= 64 and len(self.known) < MEMO:
                self.known[text] = cost
        return cost

    def _value(self, text: str) -> float:
        if REFERENCE.match(text):
            return self.kind["ref"] + text.count(":") + self.extra["a"] * sum(c.isalpha() for c in text) / 2
        symbols: Counter = Counter()
        for ch, n in Counter(outline(text)).items():
            symbols[_symbol(ch)] += n
        return self.kind["words"] + self.symbol.get("end", self.unseen) + sum(n * (self.symbol.get(s, self.unseen) + self.extra.get(s, 0)) for s, n in sorted(symbols.items()))

    def listed(self, text: str) -> tuple[float, list[str]]:
        """The cost and the values of a quoted stretch: one value, or a list of values."""
        whole = _strip(text)
        parts = [p for p, _ in pieces(whole, Dialect(FINEST, ""))]
        if len(parts) > 1 and all(REFERENCE.match(p) for p in parts):
            return self.separators(len(parts), FINEST) + sum(map(self.value, parts)), parts
        return self.value(whole), [whole]

    @staticmethod
    def separators(n: int, delimiters: str) -> float:
        return (n - 1) * (1 + math.log2(max(1, len(delimiters))))

    def length(self, text: str, dialect: Dialect) -> float:
        parts = pieces(text, dialect)
        cost = math.log2(len(DIALECTS)) + len(dialect.delimiters) / 4 + self.separators(max(1, len(parts)), dialect.delimiters)
        for part, quoted in parts:
            cost += self.listed(part)[0] if quoted else self.value(part)
            cost += 1 if dialect.quote else 0  # whether the value is quoted
        return cost


def candidates(text: str) -> list[Dialect]:
    """The dialects that can tell the text apart from a coarser one: all their quotes and some of their delimiters occur in it.

    Of dialects whose delimiters are the same as far as they occur, only the smallest can be cheapest.
    """
    present = set(text)
    least: dict[tuple[frozenset, str], Dialect] = {}
    for x in DIALECTS:
        some = frozenset(x.delimiters) & present
        if (x.delimiters and not some) or (x.quote and x.quote not in present):
            continue
        if (old := least.get((some, x.quote))) is None or len(x.delimiters) < len(old.delimiters):
            least[some, x.quote] = x
    return list(least.values())


def choose(text: str, code: ValueCode) -> Dialect:
    """The cheapest dialect; of equally cheap ones the one with fewer delimiters, then the earlier in ``DIALECTS``."""
    return min(candidates(text), key=lambda x: (round(code.length(text, x), 9), len(x.delimiters), DIALECTS.index(x)))


def values(text: str, dialect: Dialect, code: ValueCode) -> list[str]:
    """The values of a field in order, without placeholders."""
    out: list[str] = []
    for part, quoted in pieces(text, dialect):
        out += code.listed(part)[1] if quoted else [part]
    out = [_strip(v) for v in out]
    return [v for v in out if v not in PLACEHOLDERS]


def _seed_values(text: str) -> list[str]:
    """The values of the finest dialect that respects the quotes at hand; from these the first counts are taken."""
    quote = next((q for q in ('"', "'") if q in text), "")
    out: list[str] = []
    for part, quoted in pieces(text, Dialect(FINEST, quote)):
        inner = [p for p, _ in pieces(part, Dialect(FINEST, ""))] if quoted else [part]
        out += inner if all(REFERENCE.match(p) for p in inner) else [part]
    return [v for v in out if v not in PLACEHOLDERS]


class _Memo(OrderedDict):
    """A bounded map that forgets what was used least recently."""

    def find(self, key, make):
        if key in self:
            self.move_to_end(key)
            return self[key]
        value = make()
        if len(key[-1]) <= 4096:
            self[key] = value
            if len(self) > MEMO:
                self.popitem(last=False)
        return value


def _tally(shape: str) -> Counter:
    """How often the classes and symbols occur in the values of one outline."""
    one: Counter = Counter()
    for v in _seed_values(shape):
        ref = bool(REFERENCE.match(v))
        one["kind", "ref" if ref else "words"] += 1
        if not ref:
            one["symbol", "end"] += 1
            for ch, n in Counter(v).items():
                one["symbol", _symbol(ch)] += n
    return one


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    memo = _Memo()
    for pdf in batches:
        for (field, shape), n in Counter(zip(pdf["field"], pdf["shape"])).items():
            for k, c in memo.find((shape,), lambda: _tally(shape)).items():
                total[(field, *k)] += c * n
    yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["field", "what", "symbol", "n"])


def value_counts(packed: DataFrame) -> dict[str, dict[tuple[str, str], int]]:
    """Counts of value classes and symbols per field over all rows: each task sends its sums, and fields x (2 + ``SYMBOLS``) of them at most reach the driver."""
    shapes = packed.where("raw is not null").select("field", F.regexp_replace("raw", "[0-9]+", "0").alias("shape"))
    rows = shapes.mapInPandas(_counted, "field string, what string, symbol string, n long").groupBy("field", "what", "symbol").agg(F.sum("n").alias("n")).collect()
    out: dict[str, dict[tuple[str, str], int]] = {}
    for r in rows:
        out.setdefault(r.field, {})[r.what, r.symbol] = r.n
    return out


def packed_fields(tables: Sequence[tuple[str, DataFrame, str, Sequence[str]]]) -> DataFrame:
    """``tbl, field, row_key, raw`` of (name, table, key column, packed columns): blank and placeholder texts are left out."""
    out = None
    for name, table, key, fields in tables:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("raw")) for f in fields])
        rows = table.select(F.col(key).cast("string").alias("row_key"), F.explode(each).alias("p")).select(F.lit(name).alias("tbl"), "p.field", "row_key", "p.raw")
        rows = rows.where(F.col("raw").isNotNull() & ~F.trim("raw").isin(*PLACEHOLDERS))
        out = rows if out is None else out.unionByName(rows)
    return out


def split_packed(packed: DataFrame, counts: Mapping[str, Mapping[tuple[str, str], int]] | None = None) -> DataFrame:
    """``tbl, field, row_key, pos, item``: each value of each packed field, with its place from 1.

    ``packed`` has ``tbl, field, row_key, raw``. Repeated rows give their values once; null, blank and placeholder fields
    and empty places give no rows; texts of any length are parsed whole, in time proportional to their length for each of
    the few dialects that can apply. Fields with equal texts give equal values. An empty table gives no rows. Besides
    the sums of ``value_counts`` only the result is shuffled, to drop repetitions.
    """
    counts = value_counts(packed) if counts is None else counts
    known = {f: dict(c) for f, c in counts.items()}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = {f: ValueCode(c) for f, c in known.items()}
        fallback = ValueCode({})
        memo = _Memo()
        for pdf in batches:
            src: list[int] = []
            pos: list[int] = []
            item: list[str] = []
            for i, (field, raw) in enumerate(zip(pdf["field"], pdf["raw"])):
                if raw is None:
                    continue
                code = codes.get(field, fallback)
                if raw.isdigit():
                    got = [raw]
                else:
                    shape = outline(raw)
                    dialect = memo.find((field, shape), lambda shape=shape, code=code: choose(shape, code))
                    got = values(raw, dialect, code)
                src += [i] * len(got)
                pos += range(1, len(got) + 1)
                item += got
            rows = pdf[["tbl", "field", "row_key"]].iloc[src].reset_index(drop=True)
            rows["pos"] = pd.Series(pos, dtype="int32")
            rows["item"] = pd.Series(item, dtype="object")
            yield rows

    return packed.select("tbl", "field", "row_key", "raw").mapInPandas(parse, "tbl string, field string, row_key string, pos int, item string").distinct()
