"""Byte-level BPE encoding of whole columns with a public vocabulary.

Texts of an Arrow batch are cut by the vocabulary's pattern; each different piece
of the batch is encoded once. All pieces are laid out as one sequence of byte
symbols, and an index maps each mergeable pair to all its positions in it. The
active ranks are applied in ascending order: a rank's positions are merged from
left to right, and the lists of the pairs that appear at their sides are
extended. A merge only creates pairs of higher rank (checked when the vocabulary
is read), so each rank is visited once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loreweave.llm.shingles import slices

#: Fixed value: the pattern of byte_bpe_50k that cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """Merges as arrays: sorted pair keys, their ranks, and per rank the two parts and the result."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.of_byte = np.array([ids[name] for name in _byte_names()], dtype=np.int64)
        first_use = np.full(int(max(ids.values())) + 1, len(pairs), dtype=np.int64)
        np.minimum.at(first_use, self.left, np.arange(len(pairs)))
        np.minimum.at(first_use, self.right, np.arange(len(pairs)))
        if (first_use[self.made] <= np.arange(len(pairs))).any():
            raise ValueError("a merge of this vocabulary comes before one that it needs")
        keys = (self.left << 32) | self.right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't one."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)


def merge_pieces(pieces: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one row, and where each piece ends."""
    coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
    ends = np.cumsum([len(c) for c in coded])
    start = words.of_byte[np.frombuffer(b"".join(coded), dtype=np.uint8)]
    n = len(start)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    symbols = start.tolist()
    after = np.where(last, -1, np.arange(1, n + 1)).tolist()
    before = np.where(np.concatenate(([True], last[:-1])), -1, np.arange(-1, n - 1)).tolist()

    inner = np.flatnonzero(~last)
    ranks = words.ranks(start[inner], start[np.minimum(inner + 1, n - 1)])
    inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    inner, ranks = inner[order], ranks[order]
    first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else np.zeros(0, dtype=np.int64)
    places = {int(ranks[a]): inner[a:b].tolist() for a, b in zip(first, np.append(first[1:], len(ranks)))}

    active = list(places)
    heapq.heapify(active)
    rank_of, left, right, made = words.rank_of, words.left.tolist(), words.right.tolist(), words.made.tolist()
    while active:
        rank = heapq.heappop(active)
        a, b, new = left[rank], right[rank], made[rank]
        for at in sorted(places.pop(rank)):
            then = after[at]
            if symbols[at] != a or then < 0 or symbols[then] != b:
                continue
            symbols[at], symbols[then] = new, -1
            beyond = after[at] = after[then]
            if beyond >= 0:
                before[beyond] = at
                found = rank_of.get(new << 32 | symbols[beyond])
                if found is not None:
                    if found not in places:
                        places[found] = []
                        heapq.heappush(active, found)
                    places[found].append(at)
            ahead = before[at]
            if ahead >= 0:
                found = rank_of.get(symbols[ahead] << 32 | new)
                if found is not None:
                    if found not in places:
                        places[found] = []
                        heapq.heappush(active, found)
                    places[found].append(ahead)
    done = np.array(symbols, dtype=np.int64)
    kept = np.cumsum(done >= 0)
    return done[done >= 0].astype(np.int32), kept[ends - 1]


def _encode(texts: pa.Array, words: Vocabulary, cut: regex.Pattern) -> pa.ListArray:
    index: dict[str, int] = {}
    seen: list[int] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    for row, text in enumerate(texts.to_pylist()):
        if text:
            pieces = cut.findall(text)
            seen.extend([index.setdefault(p, len(index)) for p in pieces])
            counts[row + 1] = len(pieces)
    if not seen:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], pa.int32()))
    ids, ends = merge_pieces(list(index), words)
    starts = np.concatenate(([0], ends[:-1]))
    piece = np.array(seen, dtype=np.int64)
    lengths = (ends - starts)[piece]
    upto = np.concatenate(([0], np.cumsum(lengths)))
    values = ids[np.repeat(starts[piece] - upto[:-1], lengths) + np.arange(upto[-1])]
    offsets = upto[np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Token ids of each text: the key column and ``ids``, without special tokens.

    A special token's string within a text is ordinary text. Null and empty texts
    give an empty list; rows with equal or null keys are all kept. ``vocabulary``
    is a tokenizer file that the driver reads; its two megabytes are broadcast.
    Texts never leave their partition.
    """
    words = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("key"), _encode(part.column("text"), words.value, cut)], ["key", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(emit, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, into: str, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the number of tokens of each text, 0 for null and empty texts."""
    words = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    place = df.columns.index(text)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                ids = _encode(part.column(place), words.value, cut)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes)], [*part.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` bigint"
    return df.mapInArrow(emit, schema)
