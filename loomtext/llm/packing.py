"""Best-fit packing of token pieces into sequences of one size.

How many pieces there are of each length says all that matters for packing, and that table is bounded by the sequence size. On it a
configuration linear program is solved: choose how often each way to fill a sequence (a configuration) is used, so that all pieces
are covered by as few sequences as possible. Multiplicative weights give each length a price; dynamic programming prices the best
configuration (a knapsack bounded by the pieces there are); covered lengths get cheaper. The fractional solution is rounded down,
the rest is solved again, and what is too little for that goes by best fit. The plan is a table of runs: pieces number a to b of a
length lie in sequences s and on, at an offset. Its size depends on the sequence size, not on the pieces.

In Spark, pieces of a length are numbered in buckets of about the square root of their count, so a length that holds a third of all
pieces is spread out; each piece then finds its run by its number.

Defined results: a null or empty text is the end token alone; a text longer than the size is cut into pieces of the size and a last
one; equal texts and equal ids are packed as separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from .common import positional, texts_of

SEQUENCE_TOKENS = 2048
#: words and pre-tokens whose ids a worker remembers, and the longest of them in bytes
WORDS, WORD_BYTES = 400_000, 64
#: a mark that a word may end in
MARKS = ".,;:!?"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and no token spans it, so a text is the sequence of its words between ASCII white space. A word
    of Latin letters that is new is put in lower case and cut by the tokenizer file's own pattern, and each distinct pre-token goes
    to the tokenizer's model once; any other word, and one that may hold a special token, goes through the whole tokenizer. With a
    file of another make every text does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        spaced = steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        spaced = spaced and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and "\\s" in cuts[0]["pattern"]["Regex"] and not cuts[1]["add_prefix_space"]
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"]) if spaced else None
        # the model reads bytes as characters: visible ones as they are, the others moved up in order
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        moved = iter(range(0x100, 0x200))
        self.shown = {b: b if b in visible else next(moved) for b in range(0x100)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        if self.pattern is None:
            return self._whole(text.decode("utf-8", "replace"))
        words = text.split()
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > WORDS:
            self.words, new = {}, set(words)
        if len(self.parts) > WORDS:
            self.parts = {}
        long = {}
        for word in new:
            (self.words if len(word) <= WORD_BYTES else long)[word] = self._word(word)
        if long:
            return b"".join([long[w] if w in long else self.words[w] for w in words])
        return b"".join(map(self.words.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        # below this lower case and composed forms go character by character
        if "<|" in text or (not text.isascii() and max(text) >= "\u0100"):
            return self._whole(text)
        text = text.lower()
        if text.isalpha():
            return self.parts.get(text) or self._part(text)
        if text[-1] in MARKS and text[:-1].isalpha():  # as the pattern cuts it, only sooner
            return (self.parts.get(text[:-1]) or self._part(text[:-1])) + (self.parts.get(text[-1]) or self._part(text[-1]))
        return b"".join([self.parts.get(p) or self._part(p) for p in self.pattern.findall(text)])

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.shown)
        ids = little([t.id for t in self.tokenizer.model.tokenize(shown)])
        if len(part) <= WORD_BYTES:
            self.parts[part] = ids
        return ids


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps the words it knows."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def token_pieces(
    docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece of at most ``size`` ids: the document's id, ``piece`` (from 0), ``start`` (ids before it), ``length``,
    ``ids_crc32`` (unsigned, over little-endian 32-bit ids) and, unless left out, ``ids`` (array<int>)."""
    kind = docs.schema[doc_id].dataType
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(doc_id, kind), *[T.StructField(n, t) for n, t in fields]])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, rows, crcs, ids = [], [], [], []
                for i, text_bytes in enumerate(texts_of(part, "__text")):
                    data = encode(text_bytes) + end
                    for k, low in enumerate(range(0, len(data), 4 * size)):
                        cut = data[low : low + 4 * size]
                        row.append(i)
                        rows.append((k, low // 4, len(cut) // 4))
                        crcs.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<i4"))
                k, start, length = zip(*rows)
                columns = [part.column("__id").take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)


# the plan, on the table of lengths


@dataclass(frozen=True)
class Run:
    """``times`` sequences filled alike: (length, pieces of it in each), longest first."""

    times: int
    fill: tuple[tuple[int, int], ...]


def best_fill(lengths: np.ndarray, left: np.ndarray, price: np.ndarray, size: int):
    """Knapsack by dynamic programming: the dearest filling of every capacity with at most ``left`` pieces of each length.

    Returns the values by capacity, and a function that gives the pieces of the best filling of a capacity."""
    value = np.zeros(size + 1)
    items: list[tuple[int, int, int]] = []  # (position, pieces, tokens), the pieces in powers of two
    # by item and capacity, the last item up to it that made the capacity's filling better
    last = np.full(size + 1, -1, np.int32)
    history = [last]
    for i, length in enumerate(lengths.tolist()):
        most, block = min(int(left[i]), size // length), 1
        while most > 0:
            block = min(block, most)
            width = length * block
            with_it = value[:-width] + price[i] * block
            better = with_it > value[width:]
            value[width:][better] = with_it[better]
            last = last.copy()
            last[width:][better] = len(items)
            history.append(last)
            items.append((i, block, width))
            most -= block
            block *= 2

    def pieces(capacity: int) -> dict[int, int]:
        out: dict[int, int] = {}
        at = int(history[-1][capacity])
        while at >= 0:
            i, block, width = items[at]
            out[i] = out.get(i, 0) + block
            capacity -= width
            at = int(history[at][capacity])
        return out

    return value, pieces


def fractions(lengths: np.ndarray, count: np.ndarray, size: int, rounds: int, rate: float, step: float) -> list[tuple[float, dict[int, int]]]:
    """Configurations (pieces by position of the length) and how often each is used, which together use no length up.

    Each round prices the lengths, a length the cheaper the more of it is covered, and takes for each length the dearest
    filling that holds it, as long as it leaves no more room than the round allows; each takes a part of what is left.
    """
    left, used, slack = count.astype(float), [], 0
    for _ in range(rounds):
        whole = np.floor(left + 1e-6)
        if not whole.any():
            break
        covered = 1 - left / count
        weight = np.exp(-rate * covered)
        value, pieces = best_fill(lengths, whole, lengths * weight, size)
        dearest = np.where(whole > 0, lengths * weight + value[size - lengths], -1.0)
        taken = 0.0
        for seed in np.argsort(-dearest, kind="stable").tolist():
            if left[seed] < 1:
                continue
            fill = pieces(size - int(lengths[seed]))
            fill[seed] = fill.get(seed, 0) + 1
            at, each = np.array(list(fill)), np.array(list(fill.values()))
            room = float((left[at] / each).min())
            if room < 1 or int((lengths[at] * each).sum()) < size - slack:
                continue
            times = max(1.0, step * room)
            left[at] -= times * each
            used.append((times, fill))
            taken += times
        if taken * size < 0.02 * float(left @ lengths):
            slack = 2 * slack + 1
    return used


def best_fit(lengths: np.ndarray, count: np.ndarray, size: int) -> list[Run]:
    """Longest first, each into the fullest sequence that has room; on a few pieces."""
    room: list[list[dict[int, int]]] = [[] for _ in range(size + 1)]
    for i in np.argsort(-lengths):
        length = int(lengths[i])
        for _ in range(int(count[i])):
            space = next((r for r in range(length, size + 1) if room[r]), None)
            fill = room[space].pop() if space is not None else {}
            space = size if space is None else space
            fill[length] = fill.get(length, 0) + 1
            room[space - length].append(fill)
    return [Run(1, tuple(sorted(f.items(), reverse=True))) for fills in room for f in fills]


def plan(histogram: dict[int, int], size: int, rounds: int = 24, few: int = 1_000, rate: float = 0.05, step: float = 0.5) -> list[Run]:
    """Runs of equally filled sequences that hold every piece of the histogram exactly once."""
    runs = [Run(n, ((size, 1),)) for length, n in histogram.items() if length == size and n]
    lengths = np.array(sorted(k for k, n in histogram.items() if k < size and n), dtype=np.int64)
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    while left.sum() > few:
        before = int(left.sum())
        where = np.flatnonzero(left > 0)
        for times, fill in fractions(lengths[where], left[where], size, rounds, rate, step):
            k = int(times + 1e-6)
            for i, each in fill.items():
                left[where[i]] -= k * each
            runs.append(Run(k, tuple(sorted(((int(lengths[where[i]]), int(each)) for i, each in fill.items()), reverse=True))))
        if left.sum() > 0.8 * before:
            break
    return runs + best_fit(lengths, left, size)


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, length: str = "length") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (both long): where each lies. Columns of these names are replaced.

    ``length`` has to be 1 to ``size``. Sequences are numbered from 0 without gaps, pieces of one have no gap between them.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    body = positional(pieces.select(*names)).withColumn("__row", F.monotonically_increasing_id())
    at = f"c{names.index(length)}"
    body = cut_lineage(body.withColumn("__l", F.col(at).cast("bigint")))
    histogram = {r["__l"]: r["n"] for r in body.groupBy("__l").agg(F.count(F.lit(1)).alias("n")).limit(size + 1).collect()}
    if any(k is None or not 0 < k <= size for k in histogram):
        raise ValueError(f"pieces have a length of 1 to {size}")
    numbered = number_within(body, histogram)
    keys, table = run_table(plan(histogram, size))
    schema = T.StructType([*[f for f in body.schema.fields if not f.name.startswith("__")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, no = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__l", "__no"))
            first, each, sequence, offset = table[:, np.searchsorted(keys, (tokens << SHIFT) + no, side="right") - 1]
            into, among = np.divmod(no - first, each)
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if not name.startswith("__")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + into), pa.array(offset + among * tokens)], names=schema.names)

    return numbered.mapInArrow(run, schema).toDF(*names, "sequence_id", "offset")


#: a number within a length stays below 2 ** SHIFT
SHIFT = 48


def run_table(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """The plan by pieces: sorted keys (length, first number), and for each the first number, pieces in a sequence, first sequence, offset."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, each in run.fill:
            first = given.get(length, 0)
            rows.append(((length << SHIFT) + first, first, each, sequence, offset))
            given[length] = first + run.times * each
            offset += length * each
        sequence += run.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return table[0], table[1:]


def number_within(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``__no``: a number from 0 for each row among those of its length, in buckets of about the square root of their count."""
    most = max(histogram, default=0)
    counts = F.split(F.lit(",".join(str(isqrt(histogram.get(k, 0)) + 1) for k in range(most + 1))), ",").cast("array<bigint>")
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64("__row"), F.get(counts, F.col("__l").cast("int"))))
    sizes = dealt.groupBy("__l", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__l", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__l", "__b").orderBy("__row"))
    numbered = dealt.withColumn("__in", inside).join(broadcast_if_small(sizes), ["__l", "__b"])
    return numbered.withColumn("__no", F.col("__before") + F.col("__in") - 1).drop("__b", "__before", "__in", "__row")
