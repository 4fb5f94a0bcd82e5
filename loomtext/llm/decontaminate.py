"""Benchmark decontamination: find passages of test items in training texts, mark or remove them.

Items are cut into windows of ``window`` consecutive words; an item of fewer words is one window. The
hashes of all windows, with the words behind them, are broadcast after their size has been counted;
tasks scan their texts for them. Only runs of words that occur in some item are hashed, each hash that
is found is verified word by word, and every word inside an occurrence counts as hit. Item sets beyond
the bound go another way with the same result: the windows of the texts are joined with those of the items on
the words themselves.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower
case. Null texts have no words; an empty table gives no rows; repeated rows and ids are judged each for
itself; other columns are passed through where rows are returned, and not read otherwise.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, place, positional, texts_of

WINDOW = 13
#: what may be broadcast: rows and bytes of the item table
MAX_ITEMS = 200_000
MAX_BYTES = 32 << 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of each window of ``length`` ids."""
    h = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        h = h * _FACTOR + ids[k : len(ids) - length + 1 + k]
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of the items: word numbers, and for each length sorted hashes with what is behind them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            length = min(window, len(ids))
            for k in range(len(ids) - length + 1) if ids else ():
                found[length][tuple(ids[k : k + length])].add(item)
        self.lengths = {}
        for length, grams in sorted(found.items()):
            by_hash: dict[int, list[tuple[np.ndarray, frozenset[str]]]] = defaultdict(list)
            for gram, owners in grams.items():
                ids = np.array(gram, np.uint64)
                by_hash[int(_hashes(ids, length)[0])].append((ids, frozenset(owners)))
            self.lengths[length] = (np.array(sorted(by_hash), np.uint64), dict(by_hash))

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, a mark per word, and the items met."""
        words, get = words_of(text), self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        hit, owners = np.zeros(len(words) + 1, np.int64), set()
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            for length, (hashes, behind) in self.lengths.items():
                if length > b - a:
                    break
                h = _hashes(ids[a:b], length)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for k in np.flatnonzero(hashes[at] == h).tolist():
                    for gram, items in behind[int(h[k])]:
                        if np.array_equal(gram, ids[a + k : a + k + length]):
                            owners |= items
                            hit[a + k] += 1
                            hit[a + k + length] -= 1
        return len(words), np.cumsum(hit[:-1]) > 0, owners


def _runs(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


_HITS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_HIT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _items_within(items: DataFrame, max_items: int, max_bytes: int) -> list[tuple[str, bytes]] | None:
    """All items, or None when they are beyond the bound; counting stops at the bound."""
    few = items.limit(max_items + 1)
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > max_items or size > max_bytes:
        return None
    return [(r[0], (r[1] or "").encode()) for r in items.collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_items: int = MAX_ITEMS,
    max_bytes: int = MAX_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """The columns of ``docs``, the text only if asked for, with n_words, n_hit, items (sorted) and spans
    of hit words. Columns of these names must not be there yet."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    near = _items_within(items, max_items, max_bytes)
    if near is None:
        return _scan_by_join(docs, items, window, text, keep_text)
    kept = [c for c in docs.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(Windows(near, window))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [shared.value.scan(t) for t in texts_of(batch, text)]
        values = [[n for n, _, _ in rows], [int(m.sum()) for _, m, _ in rows], [sorted(o) for _, _, o in rows], [_runs(m) for _, m, _ in rows]]
        made = [pa.array(v, t) for v, t in zip(values, _HIT_TYPES)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "n_words", "n_hit", "items", "spans"])

    return map_batches(docs, run, _schema(docs, kept))


def _schema(docs: DataFrame, kept: list[str]):
    return docs.select(*kept, *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in _HITS.split(", "))]).schema


def word_array(text: Column) -> Column:
    """The words of a text, natively."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), F.array().cast("array<string>"))


def _grams(words: str, length: Column) -> Column:
    """(place from 1, window) of each window of a length."""
    places = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(k.alias("at"), F.concat_ws(" ", F.slice(words, k, length)).alias("gram")))


def _scan_by_join(docs: DataFrame, items: DataFrame, window: int, text: str, keep_text: bool) -> DataFrame:
    """The way for item sets beyond the broadcast bound: windows of texts and items meet in a join.

    Rows get a number once, in a written table, since ids may repeat.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    rows = cut_lineage(docs.select(F.struct(*kept).alias("row"), word_array(F.col(text)).alias("w")).withColumn("r", F.monotonically_increasing_id()))
    cut = items.select("item", word_array(F.col("text")).alias("w")).where("size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window)))
    windows = cut_lineage(cut.select("item", "len", F.explode(_grams("w", F.col("len"))).alias("g")).select("item", "len", "g.gram").distinct())
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most ``window`` values
    if not lengths:
        lengths = [window]
    grams = rows.select("r", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len"), "w")
    grams = grams.select("r", "len", F.explode(_grams("w", F.col("len"))).alias("g")).select("r", "len", "g.at", "g.gram")
    names = windows.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))
    met = cut_lineage(grams.join(names, ["len", "gram"]).select("r", "at", "len", "items"))
    owners = met.select("r", F.explode("items").alias("item")).distinct().groupBy("r").agg(F.array_sort(F.collect_list("item")).alias("items"))
    places = met.groupBy("r", "at").agg(F.max("len").alias("len"))
    ranges = places.groupBy("r").agg(F.array_sort(F.collect_list(F.struct((F.col("at") - 1).cast("bigint").alias("start"), (F.col("at") - 1 + F.col("len")).cast("bigint").alias("end")))).alias("s"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(x)))

    spans = ranges.select("r", F.aggregate("s", empty, merge).alias("spans"))
    out = rows.join(owners, "r", "left").join(spans, "r", "left")
    count = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "row.*",
        F.size("w").cast("bigint").alias("n_words"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", empty).alias("spans"),
    )


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = scan(positional(docs), benchmark, text=place(docs, text), keep_text=True, **options)
    kept = found.where(~contaminated(F.col("n_words"), F.col("n_hit")))
    return kept.select(*positional(docs).columns).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with hit words cut out of the text; what stands between them and around stays."""
    named, at = positional(docs), place(docs, text)
    found = scan(named, benchmark, text=at, keep_text=True, **options)
    order = named.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(at).to_pylist()
        cut = [_without(t, s) if s else t for t, s in zip(raw, batch.column("spans").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == at else batch.column(c) for c in order], order)

    return map_batches(found, run, named.schema).toDF(*docs.columns)


def _without(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    marks = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    starts, ends, out, at = edges[::2], edges[1::2], [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode()
