"""Held-out texts inside a corpus: rare seeds of consecutive units join passages to items, local alignment decides.

Units are words parted by white space, or single letters and digits for texts of a script without spaces; case, width
and punctuation don't count. Seeds are runs of ``seed`` exact units. One scan of the corpus keeps the stretches of text
around seeds that some item may hold (a filter of bounded size tells), so that the number of items doesn't multiply the
passes. Seeds are then counted over the whole corpus, and of each item the rarest are kept that suffice: of any two
neighbouring seeds at least one. As every passage that counts holds a run of ``seed + 1`` exact units, none is lost.
What the kept seeds join is aligned by Smith and Waterman's method, gaps allowed, in a band about the seeds' diagonals;
the score decides whether a document holds an edited copy. ``exact`` tells whether some gapless stretch within the band
is a passage by the strict rule: ``least`` consecutive units of an item with at most one in ``one_in`` exchanged.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.skew import HOT_SHARE, salted_join
from strandmill.session import settle

#: Bits of the seed filter for each seed, and at most: 2^26 bits are 8 MB. Beyond, more stretches pass it; none is lost.
FILTER_BITS, MOST_BITS = 16, 1 << 26
#: Units of text that a worker looks at together.
CHUNK = 200_000
#: Half the width of the band of diagonals that are aligned together, and the spread of seeds within it.
BAND, SPREAD = 6, 4
MATCH, EXCHANGE, GAP = 1, -1, -2
#: Items with which a stretch of text is sent to a worker at once, about.
TOGETHER = 64
_MEMO = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """The least length of a passage, how many units one exchanged unit takes, and the length of a seed."""

    kind: int
    least: int
    one_in: int
    seed: int

    @property
    def run(self) -> int:
        """The exact units in a row that every passage holds: n units, m of them exchanged, leave m + 1 runs."""
        return min(-(-(max(self.least, m * self.one_in) - m) // (m + 1)) for m in range(self.least))

    @property
    def close(self) -> int:
        """The exact units that some stretch of ``least`` units of every passage has: from twice the length on, one of two apart has at most its share of the exchanged ones."""
        return self.least - (2 * self.least - 1) // self.one_in

    @property
    def score(self) -> int:
        """The least score of a passage's own alignment."""
        return min(MATCH * (max(self.least, m * self.one_in) - m) + EXCHANGE * m for m in range(self.least))


WORDS = Rule(0, 12, 8, 4)
LETTERS = Rule(1, 24, 8, 5)
RULES = (WORDS, LETTERS)


def _spaceless(ch: str) -> bool:
    return "㐀" <= ch <= "鿿" or "぀" <= ch <= "ヿ" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U0003ffff"


_HAS_SPACELESS = re.compile("[㐀-鿿぀-ヿ豈-﫿\U00020000-\U0003ffff]").search


_OTHER_WORDS = re.compile("[^\\W㐀-鿿぀-ヿ豈-﫿\U00020000-\U0003ffff]+").findall


def by_letters(text: str, lang: str | None = None) -> bool:
    """Whether a text is compared by letters: it holds letters of a script without spaces, and either its language is
    Chinese or Japanese, or these are a quarter of its letters or as many as its words of other scripts (long foreign names count once).
    """
    letters = [c for c in text if c.isalpha()]
    dense = sum(map(_spaceless, letters))
    return dense > 0 and ((lang or "")[:2].lower() in ("zh", "ja") or 4 * dense >= len(letters) or dense >= len(_OTHER_WORDS(text)))


class _Kept(dict):
    """For ``str.translate``: letters, digits, marks and white space stay, everything else goes."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        keep = ch.isalnum() or ch.isspace() or unicodedata.category(ch)[0] == "M"
        self[code] = out = code if keep else None
        return out


class _Letters(dict):
    """For ``str.translate``: letters and digits stay."""

    def __missing__(self, code: int) -> int | None:
        self[code] = out = code if chr(code).isalnum() else None
        return out


_KEPT, _LETTERS = _Kept(), _Letters()
_PLAIN = {c: None for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()}


def words(text: str) -> list[str]:
    if text.isascii():
        return text.lower().translate(_PLAIN).split()
    return unicodedata.normalize("NFKC", text).casefold().translate(_KEPT).split()


def letters(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().translate(_LETTERS)


class _Codes(dict):
    """A 64-bit code for each word, the same in every process; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


_CODES = _Codes()


def codes(units, rule: Rule) -> np.ndarray:
    """One 64-bit number for each unit."""
    if rule.kind:
        return np.frombuffer(units.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.fromiter(map(_CODES.__getitem__, units), dtype=np.uint64, count=len(units))


def seed_keys(code: np.ndarray, rule: Rule) -> np.ndarray:
    """The key of the seed at each place; two kinds of units never share one on purpose."""
    n = len(code) - rule.seed + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, rule.kind + 1, dtype=np.uint64)
    for k in range(rule.seed):
        out = (out ^ code[k : k + n]) * _P
        out ^= out >> np.uint64(29)
    return out


class SeedFilter:
    """Two bits for each key that some item holds: never wrong about those, seldom about others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(size - 1)
        return keys & mask, (keys >> np.uint64(32)) & mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, int(self.mask) + 1):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def neighbours(hit: np.ndarray) -> np.ndarray:
    """Hits with a hit next to them: a run of ``seed + 1`` exact units has two."""
    out = np.zeros_like(hit)
    both = hit[1:] & hit[:-1]
    out[1:] |= both
    out[:-1] |= both
    return out


def rarest(counts: list[int]) -> list[int]:
    """The places to keep, of any two neighbours at least one, with the least sum of counts; of equal sums the one that keeps fewer, then later, places."""
    keep, drop = (0, 0, None), (0, 0, None)  # sum, number and chain of kept places, if the last place is kept or dropped
    for i, n in enumerate(counts):
        best = min(keep, drop, key=lambda x: x[:2])
        keep, drop = (best[0] + n, best[1] + 1, (i, best[2])), (keep if i else best)
    out, at = [], min(keep, drop, key=lambda x: x[:2])[2]
    while at:
        out.append(at[0])
        at = at[1]
    return out[::-1] or list(range(min(1, len(counts))))


def passage(columns, rule: Rule) -> bool:
    """Whether some stretch is long enough and has at most one exchanged unit in ``one_in``; it starts and ends with exact units."""
    n = len(columns)
    for a in range(n - rule.least + 1):
        if not columns[a]:
            continue
        wrong = 0
        for e in range(a, n):
            wrong += not columns[e]
            if wrong * rule.one_in > n - a:
                break
            if columns[e] and e - a + 1 >= rule.least and wrong * rule.one_in <= e - a + 1:
                return True
    return False


def bands(shifts: list[int]) -> list[list[int]]:
    """The diagonals in groups that one band covers."""
    out: list[list[int]] = []
    for s in sorted(shifts):
        if out and s - out[-1][0] <= SPREAD:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def likely(texts: list[np.ndarray], items: list[np.ndarray], shifts: list[list[int]], rule: Rule) -> np.ndarray:
    """Which groups of diagonals are worth an alignment: on them some ``least`` units of the item have ``close`` exact ones at least.

    Every passage has them on its own diagonal. An edited copy has them if each of its parts holds a seed.
    """
    longest = max(map(len, items))
    gap = np.zeros(longest, dtype=np.uint64)  # around each text, so that every diagonal stays within; no unit has the code 0 or 1
    of: dict[int, int] = {}
    parts, offsets, n = [gap], [], longest
    for t in texts:
        if id(t) not in of:
            of[id(t)] = n
            parts += (t, gap)
            n += len(t) + longest
        offsets.append(of[id(t)])
    flat = np.concatenate(parts)
    own = np.ones((len(items), longest), dtype=np.uint64)
    for k, item in enumerate(items):
        own[k, : len(item)] = item
    counts = np.fromiter(map(len, shifts), dtype=np.int64, count=len(shifts))
    which = np.repeat(np.arange(len(shifts)), counts)
    begin = np.fromiter((s + o for o, group in zip(offsets, shifts) for s in group), dtype=np.int64, count=int(counts.sum()))
    same = flat.take(begin[:, None] + np.arange(longest)) == own.take(which, axis=0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    united = np.logical_or.reduceat(same, first, axis=0) if len(which) > len(counts) else same
    sums = np.zeros((len(counts), longest + 1), dtype=np.int32)
    np.cumsum(united, axis=1, out=sums[:, 1:])
    return (sums[:, rule.least :] - sums[:, : -rule.least]).max(axis=1) >= rule.close


def windows(texts: list[np.ndarray], items: list[np.ndarray], centres: list[int]) -> np.ndarray:
    """``[candidate, unit of the item, diagonal of the band]``: whether the units are the same. ``texts`` and ``items`` are codes."""
    longest = max(map(len, items))
    width = 2 * BAND + 1
    whole = np.zeros((len(items), longest + width - 1), dtype=np.uint64)
    there = np.zeros(whole.shape, dtype=bool)
    own = np.zeros((len(items), longest), dtype=np.uint64)
    for k, (text, item, centre) in enumerate(zip(texts, items, centres)):
        own[k, : len(item)] = item
        first = centre - BAND
        a, b = max(0, first), min(len(text), first + len(item) + width - 1)
        if a < b:
            whole[k, a - first : b - first] = text[a:b]
            there[k, a - first : b - first] = True
    view = np.lib.stride_tricks.sliding_window_view
    same = (view(whole, width, axis=1) == own[:, :, None]) & view(there, width, axis=1)
    for k, item in enumerate(items):
        same[k, len(item) :] = False
    return same


def alignment_scores(same: np.ndarray) -> np.ndarray:
    """The best score of a local alignment within each band; all candidates advance together, one unit of the item at a time.

    A cell is one unit of the item on one diagonal: from the cell above it comes by a match or an exchange, from the
    diagonal to the right by a missing and from the left by an added unit.
    """
    n, length, width = same.shape
    above = np.zeros((n, width), dtype=np.int32)
    top = np.zeros(n, dtype=np.int32)
    slope = -GAP * np.arange(width, dtype=np.int32)
    for i in range(length):
        row = above + np.where(same[:, i], MATCH, EXCHANGE)
        row[:, :-1] = np.maximum(row[:, :-1], above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # added units, any number of them
        np.maximum(top, row.max(axis=1), out=top)
        above = row.astype(np.int32)
    return top


def aligned(texts: list[np.ndarray], items: list[np.ndarray], centres: list[int], rule: Rule) -> list[tuple[int, bool]]:
    """For each candidate (best score of a local alignment in its band, whether a gapless stretch of the band is a passage).

    The band holds the diagonals ``centre - BAND`` to ``centre + BAND``. Whatever path an alignment takes in it, its
    gapless stretches lie on these diagonals, so the strict rule is tested on them, for what the score lets through.
    """
    same = windows(texts, items, centres)
    scores = alignment_scores(same)
    least = rule.least - rule.least // rule.one_in
    out = []
    for k, score in enumerate(scores.tolist()):
        exact = score >= rule.score and any(passage(same[k, : len(items[k]), b].tolist(), rule) for b in np.flatnonzero(same[k].sum(axis=0) >= least))
        out.append((score, exact))
    return out


def _stretches(hits: np.ndarray, n: int, reach: int, seed: int) -> list[tuple[int, int]]:
    """Parts of a text in which an item of ``reach`` units can lie around the hits."""
    out: list[list[int]] = []
    for p in hits.tolist():
        a, b = max(0, p - reach), min(n, p + seed + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class _Hits:
    """Rows of the corpus side: stretches with the keys and places of their seeds."""

    def __init__(self):
        self.doc, self.kind, self.sid, self.units, self.keys, self.pos = [], [], [], [], [], []

    def add(self, doc: int, rule: Rule, units, keys: np.ndarray, hit: np.ndarray, reach: int) -> None:
        for a, b in _stretches(hit, len(units), reach, rule.seed):
            mine = hit[(hit >= a) & (hit + rule.seed <= b)]
            part = units[a:b] if rule.kind else " ".join(units[a:b])
            self.doc.append(doc)
            self.kind.append(rule.kind)
            self.sid.append(hashlib.blake2b(f"{doc}|{a}|{part}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
            self.units.append(part)
            self.keys.append(keys[mine].view(np.int64))
            self.pos.append((mine - a).astype(np.int32))

    def batch(self) -> pa.RecordBatch:
        def lists(parts, kind):
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=kind.to_pandas_dtype())
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))

        columns = [pa.array(self.doc, pa.int64()), pa.array(self.kind, pa.int32()), pa.array(self.sid, pa.string()), pa.array(self.units, pa.string()), lists(self.keys, pa.int64()), lists(self.pos, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "kind", "sid", "units", "keys", "pos"])


_HITS = "doc_id bigint, kind int, sid string, units string, keys array<bigint>, pos array<int>"


def _classes(items: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    """``item_id, cls, kind, units, n``: items long enough for a passage; items with equal units are of one class."""
    spoken = F.col(f"`{lang}`") if lang else F.lit(None)
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"), spoken.cast("string").alias("lang")).where("item_id is not null and text is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, g in zip(pdf["item_id"], pdf["text"], pdf["lang"]):
                dense = by_letters(t, g)
                units = letters(t) if dense else words(t)
                if len(units) >= RULES[dense].least:
                    out.append((i, int(dense), units if dense else " ".join(units), len(units)))
            yield pd.DataFrame(out, columns=["item_id", "kind", "units", "n"])

    parsed = rows.mapInPandas(parse, "item_id bigint, kind int, units string, n int").distinct()
    return parsed.withColumn("cls", F.sha2(F.concat_ws("|", "kind", "units"), 256).substr(1, 24))


def _item_seeds(classes: DataFrame) -> DataFrame:
    """``cls, pos, key`` of every seed of every class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, kind, units in zip(pdf["cls"], pdf["kind"], pdf["units"]):
                rule = RULES[kind]
                keys = seed_keys(codes(units if kind else units.split(" "), rule), rule)
                yield pd.DataFrame({"cls": c, "pos": np.arange(len(keys), dtype=np.int32), "key": keys.view(np.int64)})

    return classes.select("cls", "kind", "units").mapInPandas(run, "cls string, pos int, key bigint")


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """The bits of the seed filter: as many as ``FILTER_BITS`` for each of ``n`` seeds, at most ``MOST_BITS``, so that it may be broadcast."""
    size = 1 << 12
    while size < min(FILTER_BITS * n, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 64, dtype=np.uint64)
        for pdf in batches:
            for at in SeedFilter.places(pdf["key"].to_numpy().view(np.uint64), size):
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pd.DataFrame({"word": some.astype(np.int64), "mask": bits[some].view(np.int64)})

    rows = seeds.select("key").mapInPandas(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _corpus_hits(documents: DataFrame, bits: np.ndarray, kinds: set[int], reach: dict[int, int]) -> DataFrame:
    """The stretches of all documents around seeds that pass the filter; one scan, no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SeedFilter(sent.value)

        def flush(held: list, out: _Hits) -> None:
            """Looks at several texts as one sequence; seeds across their ends are left out."""
            for rule in RULES:
                mine = [(d, u) for r, d, u in held if r.kind == rule.kind]
                if not mine:
                    continue
                code = np.concatenate([codes(u, rule) for _, u in mine])
                keys = seed_keys(code, rule)
                hit = known.holds(keys)
                ends = np.cumsum([len(u) for _, u in mine])
                for k in range(1, rule.seed):
                    at = ends - k
                    hit[at[(at >= 0) & (at < len(hit))]] = False
                places = np.flatnonzero(neighbours(hit))
                if not len(places):
                    continue
                which = np.searchsorted(ends, places, side="right")
                cuts = np.flatnonzero(np.diff(which)) + 1
                for part in np.split(places, cuts):
                    k = int(np.searchsorted(ends, part[0], side="right"))
                    begin = int(ends[k] - len(mine[k][1]))
                    out.add(mine[k][0], rule, mine[k][1], keys[begin:], part - begin, reach[rule.kind])

        for batch in batches:
            held: list = []
            size, out = 0, _Hits()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                if 0 in kinds and len(u := words(t)) > WORDS.seed:
                    held.append((WORDS, doc, u))
                    size += len(u)
                if 1 in kinds and _HAS_SPACELESS(t) and len(u := letters(t)) > LETTERS.seed:
                    held.append((LETTERS, doc, u))
                    size += len(u)
                if size > CHUNK:
                    flush(held, out)
                    held, size = [], 0
                    yield out.batch()
                    out = _Hits()
            flush(held, out)
            yield out.batch()

    docs = documents
    return docs.mapInArrow(run, _HITS)


def leaks(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, item_lang: str | None = None) -> DataFrame:
    """``doc_id, item_id, score, exact``: each document with each item of which it holds a passage or an edited copy of one.

    ``score`` is the best local alignment's: 1 for a match, -1 for an exchanged, -2 for an added or missing unit. It is
    at least that of the shortest passage. ``exact``: some gapless stretch is a passage by the strict rule. An edited
    copy is found if ``seed + 1`` units in a row are unchanged.

    The corpus is scanned once for any number of items and not shuffled; only stretches around seeds of the items are
    kept. Hot seeds are spread over tasks; items with equal units are aligned once. Null, empty and short texts hold
    nothing; repeated rows give one row; very long texts are scanned whole, in linear time. ``item_lang`` names the
    column with the item's language, if there is one. Empty tables give no rows.
    """
    items = settle(_classes(items, item_key, item_text, item_lang), "items")
    facts = items.groupBy("kind").agg(F.max("n").alias("longest"), F.sum("n").alias("n"), F.countDistinct("cls").alias("classes")).collect()
    classes = items.select("cls", "kind", "units").distinct()
    seeds = settle(_item_seeds(classes), "seeds")
    docs = documents.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    hits = settle(_corpus_hits(docs, _filter(seeds, sum(r.n for r in facts)), {r.kind for r in facts}, {r.kind: r.longest for r in facts}), "hits")
    found = hits.select("sid", F.explode(F.arrays_zip("keys", "pos")).alias("h")).select("sid", F.col("h.keys").alias("key"), F.col("h.pos").alias("at"))
    # how often each seed occurs in the corpus; seeds that don't occur cost nothing
    often = settle(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(seeds.select("key").distinct(), "key", "left_semi"), "often")
    total = often.agg(F.sum("n").alias("all"))
    hot = [r.key for r in often.crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.col("all") * HOT_SHARE, F.lit(2))).select("key").collect()]  # 1 / HOT_SHARE at most

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, own in zip(pdf["cls"], pdf["own"]):
                own = sorted((s["pos"], s["key"], s["n"]) for s in own)
                out += [(c, own[k][0], own[k][1]) for k in rarest([n for _, _, n in own]) if own[k][2]]
            yield pd.DataFrame(out, columns=["cls", "pos", "key"])

    # the seeds of one item are as many as its units
    own = seeds.join(often, "key", "left").groupBy("cls").agg(F.collect_list(F.struct("pos", "key", F.coalesce("n", F.lit(0)).alias("n"))).alias("own"))
    chosen = own.mapInPandas(choose, "cls string, pos int, key bigint")
    pairs = salted_join(found, chosen, "key", "inner", F.col("sid"), hot=hot, hint=None).select("sid", "cls", (F.col("at") - F.col("pos")).alias("shift")).distinct()
    pairs = pairs.groupBy("sid", "cls").agg(F.sort_array(F.collect_list("shift")).alias("shifts"))  # diagonals of one stretch against one item

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            sizes = batch.column(3).value_lengths().to_numpy()
            each = batch.column(3).flatten()
            row = np.repeat(np.arange(len(kinds)), sizes)  # of each candidate
            items = each.field("item").dictionary_encode()
            of = items.indices.to_numpy()
            cls, shifts = each.field("cls"), each.field("shifts").to_pylist()
            found: tuple[list, list, list, list] = ([], [], [], [])
            for rule in RULES:
                mine = np.flatnonzero(kinds[row] == rule.kind)
                if not len(mine):
                    continue
                code = lambda units, rule=rule: codes(units if rule.kind else units.split(" "), rule)
                item_codes = {int(k): code(items.dictionary[int(k)].as_py()) for k in np.unique(of[mine])}
                text_codes = {int(k): code(batch.column(2)[int(k)].as_py()) for k in np.unique(row[mine])}
                jobs = [(c, group) for c in mine.tolist() for group in bands(shifts[c])]
                at = 0
                while at < len(jobs):
                    part = jobs[at : at + 1024]
                    at += len(part)
                    t, i = [text_codes[row[c]] for c, _ in part], [item_codes[of[c]] for c, _ in part]
                    some = np.flatnonzero(likely(t, i, [g for _, g in part], rule)).tolist()
                    if some:
                        done = aligned([t[j] for j in some], [i[j] for j in some], [part[j][1][0] + SPREAD // 2 for j in some], rule)
                        for j, (score, exact) in zip(some, done):
                            if score >= rule.score:
                                c = part[j][0]
                                for column, value in zip(found, (batch.column(0)[int(row[c])].as_py(), cls[c].as_py(), score, exact)):
                                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, (pa.int64(), pa.string(), pa.int32(), pa.bool_()))], names=["doc_id", "cls", "score", "exact"])

    texts = hits.select("sid", "doc_id", "kind", F.col("units").alias("text")).distinct()
    # a stretch goes out once for some items, not once for each
    groups = max(1, sum(r.classes for r in facts) // TOGETHER)
    whole = _spread_join(pairs, classes.select("cls", F.col("units").alias("item")), "sid").withColumn("group", F.pmod(F.xxhash64("cls"), F.lit(groups)))
    whole = whole.groupBy("sid", "group").agg(F.collect_list(F.struct("cls", "item", "shifts")).alias("candidates")).join(texts, "sid")
    scored = whole.select("doc_id", "kind", "text", "candidates").mapInArrow(align, "doc_id bigint, cls string, score int, exact boolean")
    scored = scored.groupBy("doc_id", "cls").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
    return _spread_join(scored, items.select("cls", "item_id").distinct(), "doc_id").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))


def _spread_join(left: DataFrame, right: DataFrame, by: str, salts: int = 8) -> DataFrame:
    """Join on ``cls`` with the few rows of ``right`` repeated ``salts`` times, so that an item that leaked everywhere is met by many tasks."""
    a = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, ["cls", "salt"]).drop("salt")
