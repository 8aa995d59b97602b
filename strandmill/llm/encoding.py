"""Token ids of a whole corpus with a public byte-pair vocabulary, by forced boundaries.

A pair of bytes that is never side by side inside any token can't be bridged by a merge, so that a cut between the two
is certain. Each piece of the splitting pattern is cut at all such pairs, the fragments are encoded on their own, and
the ids are concatenated; fragments are short, so that a piece of any length takes linear time, and frequent pieces are
remembered.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
#: Pieces remembered by a worker; when so many are known it starts afresh.
MEMO = 300_000
#: Ids after which a batch is handed over.
FLUSH = 2_000_000
_BUILT: dict[str, Encoder] = {}


class Encoder:
    """``encode`` gives the ids of a text without special tokens; strings that look like special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            a = np.frombuffer(token, dtype=np.uint8)
            self.joined[a[:-1], a[1:]] = True
        self.memo: dict[str, list[int]] = {}

    @classmethod
    def parse(cls, data: bytes, pattern: str = PATTERN) -> Encoder:
        """From the lines of a rank file: a token in base64 and its rank."""
        return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}, pattern)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two neighbouring bytes are side by side in no token."""
        if len(piece) < 2:
            return [piece] if piece else []
        a = np.frombuffer(piece, dtype=np.uint8)
        cuts = (np.flatnonzero(~self.joined[a[:-1], a[1:]]) + 1).tolist()
        edges = [0, *cuts, len(piece)]
        return [piece[i:j] for i, j in zip(edges, edges[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Byte-pair merges of one fragment, always the lowest rank first and of equal ranks the leftmost, with a heap."""
        if (whole := self.ranks.get(fragment)) is not None:
            return [whole]
        n = len(fragment)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 when it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get(fragment[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(fragment[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[fragment[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [t for f in self.fragments(data) for t in self.merge(f)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out: list[int] = []
        for p in self.split(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out


def encode_texts(documents: DataFrame, key: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """``key, ids ARRAY<INT>``: the ids of each row's whole text; one row for each row of ``documents``.

    ``vocabulary`` is the path of a rank file; it is read on the driver and broadcast (under 1 MB for 50,000 tokens).
    Null and empty texts get an empty list. Rows stay where they are: no shuffle. Repeated rows are encoded each time,
    an empty table gives an empty one, and a null key is kept.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{vocabulary}: {len(data)} bytes are too many to broadcast")
    sent = documents.sparkSession.sparkContext.broadcast(data)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hashlib.sha256(sent.value).hexdigest() + pattern
        if mark not in _BUILT:
            _BUILT[mark] = Encoder.parse(sent.value, pattern)
        encode = _BUILT[mark].encode
        for batch in batches:
            first, flat, offsets = 0, array("i"), [0]
            for i, text in enumerate(batch.column(1)):
                flat.extend(encode(text.as_py()))
                offsets.append(len(flat))
                if len(flat) > FLUSH or i + 1 == len(batch):  # long texts leave in several batches
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), ids], names=[key, "ids"])
                    first, flat, offsets = i + 1, array("i"), [0]

    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")
