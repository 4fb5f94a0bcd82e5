"""Byte-level BPE with a public vocabulary: whole texts to ids and back.

A long text is cut into chunks that overlap. Chunks are pre-tokenised on their own, wherever they are; a
chunk starts at an arbitrary place, but once it has a pre-token boundary in common with the chunk before,
all later ones agree, because what the pattern matches depends on the text that follows only. Chunks are
stitched at the first common boundary of their overlap that follows a visible character, each piece between
two stitches is cut into its pre-tokens, each distinct pre-token is encoded, and ids are joined in order. If two chunks share no
boundary (a word or white space longer than the overlap), what follows of that text is one piece: exact, if less parallel.

A text of one chunk has nothing to stitch and goes the same way without a shuffle. Texts never reach the vocabulary library's own
pattern engine, whose stack a long run of white space exceeds; it merges the bytes of one pre-token at a time.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, map_batches

#: characters of a chunk, and how many of them the next chunk repeats
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: a match that ends this close to a chunk's end may have been cut short
MARGIN = 8
#: pre-tokens whose ids a worker remembers, and the longest of them in characters
KNOWN, KNOWN_LENGTH = 400_000, 64

_LOADED: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """A rank file and a pre-token pattern. Executors read the file where the package is installed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that starts and ends at pre-token boundaries."""
        tokens = [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, set(tokens)
        long = {}
        for token in new:
            ids = self.encoding._encode_single_piece(token)
            (self.known if len(token) <= KNOWN_LENGTH else long)[token] = struct.pack(f"<{len(ids)}I", *ids)
        if long:
            return np.frombuffer(b"".join([long[t] if t in long else self.known[t] for t in tokens]), "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def codec(path: str, pattern: str) -> Codec:
    """Loaded once per worker."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path, pattern] = Codec(parse_ranks(f.read()), pattern)
    return _LOADED[path, pattern]


def boundaries(pattern, text: str, start: int, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk in the whole text's characters, without those near a cut end."""
    safe = len(text) - (0 if last else MARGIN)
    out = []
    for m in pattern.finditer(text):
        if m.end() > safe:
            break
        out.append(start + m.end())
    return out


def stitch(before: list[int], after: list[int], visible: set[int]) -> int | None:
    """The first place that ends a pre-token in both chunks and follows a visible character."""
    common = set(before).intersection(after) & visible
    return min(common) if common else None


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays of ids as one list column."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _encode_batch(path: str, pattern: str, text: str, kept: list[str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = codec(path, pattern).encode
        ids = [encode(t.as_py() or "") for t in batch.column(text)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(ids)], [*kept, "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """Texts to overlapping chunks (key, i, last, start, part)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            for start in range(0, max(1, len(text) - overlap), chunk):
                end = start + chunk + overlap
                rows.append({"key": key, "i": start // chunk, "last": end >= len(text), "start": start, "part": text[start:end]})
        return pa.RecordBatch.from_pylist(rows, _CHUNK_TYPES)

    return run


_CHUNKS = "key string, i bigint, last boolean, start bigint, part string"
_CHUNK_TYPES = pa.schema([("key", pa.string()), ("i", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("part", pa.string())])


def _pretokenise(path: str, pattern: str, chunk: int, overlap: int):
    """Adds the boundaries of a chunk inside its overlap with the one before (head) and after (tail)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find, heads, tails = codec(path, pattern).pattern, [], []
        columns = [batch.column(c).to_pylist() for c in ("start", "last", "part")]
        for start, last, part in zip(*columns):
            ends = boundaries(find, part, start, last)
            visible = [e for e in ends if not part[e - start - 1].isspace()]
            heads.append([e for e in visible if e <= start + overlap])
            tails.append([e for e in visible if not last and e > start + chunk])
        made = [pa.array(v, pa.list_(pa.int64())) for v in (heads, tails)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "head", "tail"])

    return run


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) for texts (key, text); equal keys stand for equal texts and give one row."""
    # spreads the chunks of a text, and leaves one of equal ones
    chunks = map_batches(texts.select("key", "text"), _cut(chunk, overlap), _CHUNKS).dropDuplicates(["key", "i"])
    cut = cut_lineage(map_batches(chunks, _pretokenise(path, pattern, chunk, overlap), _CHUNKS + ", head array<bigint>, tail array<bigint>"))
    # stitches need the boundaries of the overlaps alone, not the texts
    order = Window.partitionBy("key").orderBy("i")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    seams = cut.select("key", "i", "head", "tail").withColumn("seam", F.when(F.col("i") == 0, F.lit(0)).otherwise(common))
    # behind a chunk without a seam nothing is known of the boundaries: the rest is one piece
    broken = F.max(F.col("seam").isNull()).over(order)
    seams = seams.withColumn("seam", F.when(~broken, F.col("seam")))
    seams = seams.withColumn("piece", F.count("seam").over(order)).withColumn("to", F.lead("seam").over(order))
    joined = cut.select("key", "i", "last", "start", "part").join(seams.select("key", "i", "piece", "seam", "to"), ["key", "i"])
    skip = F.coalesce(F.col("seam") - F.col("start"), F.lit(0))
    stop = F.when(F.col("last"), F.length("part")).otherwise(F.coalesce(F.col("to") - F.col("start"), F.lit(chunk)))
    own = joined.select("key", "piece", "i", F.expr("part").substr((skip + 1).cast("int"), F.greatest(stop - skip, F.lit(0)).cast("int")).alias("t"))
    pieces = own.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))
    pieces = pieces.select("key", "piece", F.concat_ws("", F.transform("s", lambda x: x["t"])).alias("t"))
    encoded = map_batches(pieces, _encode_batch(path, pattern, "t", ["key", "piece"]), "key string, piece bigint, ids array<int>")
    whole = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("s"))
    return whole.select("key", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``docs`` but the text, with ``ids``: what the vocabulary's own library gives for the whole text.

    Fixed results: null and empty texts have no ids; repeated rows stay; an empty table gives no rows; a column ``ids`` of the
    table is replaced. Texts longer than ``chunk`` are met again by a hash of the text, so that ids may repeat or be null.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "ids")]
    key = fresh(docs.columns, "text_key")
    schema = docs.select(*kept).withColumn("ids", F.lit(None).cast("array<int>")).schema
    is_long = F.coalesce(F.length(text) > chunk, F.lit(False))
    one_chunk = map_batches(docs.where(~is_long).select(*kept, text), _encode_batch(path, pattern, text, kept), schema)
    far = docs.where(is_long).withColumn(key, F.sha2(text, 256))
    found = encode_long(far.select(F.col(key).alias("key"), F.col(text).alias("text")), path, pattern, chunk, overlap)
    found = found.select(F.col("key").alias(key), F.col("ids").alias("__ids"))
    met = far.select(*kept, key).join(found, key).select(*kept, F.col("__ids").alias("ids"))
    return one_chunk.unionByName(met)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` with ``decoded``: the bytes of the ids in order. Null ids give no bytes. A column
    ``decoded`` of the table is replaced."""
    encoded = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    names = encoded.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        join, column = codec(path, pattern).decode, batch.column(ids)
        flat = np.asarray(column.flatten())
        ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()]).tolist()
        out = [join(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return map_batches(encoded, run, encoded.withColumn("decoded", F.lit(None).cast("binary")).schema)
