"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy.

Texts are words; a word is the subwords that a public byte-level vocabulary gives for it. The probability of a subword is
that of its class given the subwords before it, times its probability inside the class. The class comes from one layer of
causal self-attention over a window; what stands inside the classes comes from counts over the whole training corpus.

Scoring cuts a text into overlapping windows: each window scores only its last ``STRIDE`` positions, the ones before give context,
so each token is scored once; windows of many texts form batches with one causal mask.

Corpus counts are Spark aggregates over all training texts. The words above a count threshold that leaves at most
``HEAVY`` of them are broadcast, with their counts; the others, of which there may be any number, are joined. So no
frequent word is ever a join key. Training texts are encoded once, for the neighbours, the sample and the training. Attention
weights start from a fit on a sample of windows (``SAMPLE_WINDOWS``); then each task trains on all windows of its share of the texts,
and the weights of all tasks are averaged. Shares go by the hash of id and text, so how files are cut changes nothing. The classes of
subwords come from their neighbours in the whole corpus.
"""

from __future__ import annotations

import copy
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import codec
from .common import SLICE, texts_of

#: the model: positions of a window, those it scores, width, classes, of which one for each of the most frequent subwords
KEYS, STRIDE, WIDTH, CLASSES, SINGLE = 32, 24, 24, 256, 200
#: bounds of what reaches the driver: windows of the sample, and words that are broadcast
SAMPLE_WINDOWS, HEAVY = 24_000, 1 << 17
SAMPLE_TEXTS = 4_000
EPOCHS, BATCH, RATE = 3, 64, 0.015
#: training on all windows: characters of a task, windows shuffled together and of a batch, rates of embeddings and of other weights
SHARE_CHARS, POOL, STEP, RATES = 32 << 20, 4_096, 128, (0.02, 0.003)
#: positions whose class probabilities are held at a time, as many as a core's cache has room for
ROWS = 32 * STRIDE
#: embedding rows that are averaged together, and tasks whose weights one row sums
CHUNK, FAN = 1_024, 64
#: what counts inside classes tell apart: begins of words, the most frequent subwords before, all others before
CONTEXTS = 64
#: weight of the class's own distribution against the one of a context
PRIOR = 20.0
#: bytes of text whose words are held at a time, and distinct words counted before they are passed on
SEGMENT, FLUSH = 1 << 20, 400_000
_WINDOWS = 32


def segments(text: bytes, most: int = SEGMENT) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end at white space."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of a text column; counts of a task are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts_of(batch, "text"):
                for part in segments(text):
                    seen.update(part.lower().split())
                    if len(seen) > FLUSH:
                        yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Subwords:
    """Words to subword ids of the vocabulary; two more ids stand for the begin and the end of a text."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self.codec = codec(path, pattern)
        self.begin = len(self.codec.pieces)
        self.end = self.begin + 1
        self.size = self.begin + 2
        #: of ids that are written
        self.kind = np.uint16 if self.size <= 1 << 16 else np.int32
        self.known = _Known(self.of)

    def of(self, word: bytes) -> list[int]:
        return self.codec.encoding._encode_single_piece(b" " + word)

    def all(self, words: Iterable[bytes]) -> np.ndarray:
        """Ids of many words in order; words met before are remembered, their ids as bytes that are joined."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)


class _Known(dict):
    def __init__(self, of: Callable[[bytes], list[int]]):
        self.of = of

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > FLUSH:
            self.clear()
        found = self[word] = array("i", self.of(word)).tobytes()
        return found


def subword_counts(words: DataFrame, path: str, pattern: str, size: int, rank: np.ndarray) -> np.ndarray:
    """(CONTEXTS, size): how often a subword comes after each context inside a word, from the counts of all words.

    Context 0 is the begin of a word; ``rank`` gives that of a subword before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, ranks, totals = Subwords(path, pattern), rank.tolist(), np.zeros(CONTEXTS * size, np.int64)
        for batch in batches:
            keys, weights = [], []
            for word, n in zip(texts_of(batch, "word"), batch.column("n").to_pylist()):
                ids = sub.of(word)
                keys.append(ids[0])
                keys += [ranks[a] * size + b for a, b in zip(ids, ids[1:])]
                weights += [n] * len(ids)
            np.add.at(totals, np.array(keys, np.int64), np.array(weights, np.int64))
        some = np.flatnonzero(totals)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["k", "n"])

    out = np.zeros(CONTEXTS * size, np.int64)
    found = words.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(found.column("k"))] = np.asarray(found.column("n"))  # at most CONTEXTS times the vocabulary
    return out.reshape(CONTEXTS, size)


def context_ranks(counts: np.ndarray) -> np.ndarray:
    """The context of each subword: one for each of the most frequent, the last for all others."""
    rank = np.full(len(counts), CONTEXTS - 1)
    top = np.argsort(-counts, kind="stable")[: CONTEXTS - 2]
    rank[top] = np.arange(1, len(top) + 1)
    return rank


def window_starts(predictions: int) -> np.ndarray:
    return np.arange(0, max(predictions, 1), STRIDE)


def framed(ids: np.ndarray, sub: Subwords) -> np.ndarray:
    """Begin marks for the context of the first window, the ids, and the end."""
    lead = np.full(KEYS - STRIDE + 1, sub.begin, np.int32)
    return np.concatenate([lead, ids.astype(np.int32), np.array([sub.end], np.int32)])


def ids_of(text: bytes, sub: Subwords) -> np.ndarray:
    return framed(np.concatenate([sub.all(part.lower().split()) for part in segments(text)]), sub)


def encoded(texts: DataFrame, path: str, pattern: str, seed: int) -> DataFrame:
    """(chosen, near, chars, ids) of texts (id, text): hashes of the text and of id and text, characters, framed ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, kept = Subwords(path, pattern), ["chosen", "near", "chars"]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = pa.array([ids_of(text, sub).astype(sub.kind).tobytes() for text in texts_of(batch, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, "ids"])

    hashes = F.xxhash64("text", F.lit(seed)).alias("chosen"), F.xxhash64("id", "text", F.lit(seed)).alias("near")
    return texts.select(*hashes, F.length("text").alias("chars"), "text").mapInArrow(run, "chosen bigint, near bigint, chars int, ids binary")


def decoded(batch: pa.RecordBatch, kind: type) -> Iterator[np.ndarray]:
    """The framed ids of each row of ``encoded``."""
    for ids in batch.column("ids"):
        yield np.frombuffer(ids.as_buffer(), kind).astype(np.int32)


def windows_of(seq: np.ndarray) -> np.ndarray:
    """Windows of KEYS + 1 ids of a framed text, short ones filled with -1."""
    starts = window_starts(len(seq) - (KEYS - STRIDE) - 1)
    long = np.concatenate([seq, np.full(KEYS + 1, -1, np.int32)])
    return long[starts[:, None] + np.arange(KEYS + 1)]


def neighbours(coded: DataFrame, kind: type, known: np.ndarray) -> np.ndarray:
    """(size, 2 * CLASSES): how often each subword stands before and after the subwords of each ``known`` class, over all texts."""
    wide = 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(known) * wide, np.int32)
        for batch in batches:
            for ids in decoded(batch, kind):
                seq = ids[KEYS - STRIDE :].astype(np.int64)
                a, b, ones = seq[:-1], seq[1:], np.ones(len(seq) - 1, np.int32)  # add.at is slow where types differ
                np.add.at(totals, a * wide + known[b], ones)
                np.add.at(totals, b * wide + CLASSES + known[a], ones)
        some = np.flatnonzero(totals)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some].astype(np.int64))], ["k", "n"])

    out = np.zeros(len(known) * wide, np.float32)
    found = coded.select("ids").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(found.column("k"))] = np.asarray(found.column("n"))  # at most the vocabulary times 2 * CLASSES
    return out.reshape(len(known), wide)


def _sample(coded: DataFrame, kind: type, seed: int) -> np.ndarray:
    """Windows of KEYS + 1 ids (short ones filled with -1) of texts chosen by hash; all of them if there are few."""
    share = min(1.0, SAMPLE_TEXTS / max(coded.count(), 1))
    chosen = coded.where(F.pmod("chosen", F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in decoded(batch, kind):
                made = windows_of(ids)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * (KEYS + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["w"])

    rows = chosen.select("ids").mapInArrow(run, "w array<int>").orderBy(F.xxhash64("w", F.lit(seed)), "w").limit(SAMPLE_WINDOWS).collect()
    return np.array([r[0] for r in rows], np.int64).reshape(-1, KEYS + 1)


def _known(counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the most frequent ids and the end, the last one for all others; the others that occur."""
    out = np.full(len(counts), CLASSES - 1, np.int64)
    order = np.argsort(-counts, kind="stable")
    top = [i for i in order[:SINGLE] if counts[i] > 0]
    out[top] = np.arange(len(top))
    out[end] = SINGLE
    return out, np.array([i for i in order[SINGLE:] if counts[i] > 0], np.int64)


def _classes(counts: np.ndarray, near: np.ndarray, end: int, seed: int) -> np.ndarray:
    """A class for each id: the end, the most frequent ones, and groups of the others by their ``neighbours``."""
    out, rest = _known(counts, end)
    groups = CLASSES - SINGLE - 2  # the last class holds what no training text has
    if not len(rest) or not near.any():
        out[rest] = SINGLE + 1
        return out
    features = np.sqrt(near[rest] + 0.01 * near.sum(0) / max(1.0, near.sum()))
    features /= np.linalg.norm(features, axis=1, keepdims=True) + 1e-9
    weight = counts[rest].astype(np.float64)
    rng = np.random.default_rng(seed)
    k = min(groups, len(rest))
    centres = features[rng.choice(len(rest), k, replace=False, p=weight / weight.sum() if (weight > 0).sum() >= k else None)]
    for _ in range(12):
        mine = np.argmax(features @ centres.T, axis=1)
        for c in range(k):
            if (mine == c).any():
                centres[c] = (features[mine == c] * weight[mine == c, None]).sum(0)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    out[rest] = SINGLE + 1 + mine
    return out


def row_sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, width): for each number in ``at``, the sum of its rows."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable")
    numbers = at[order]
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    out[numbers[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Attention:
    """One layer of causal self-attention with a direct path from the current subword, over classes."""

    NAMES = ("E", "P", "Wq", "Wk", "Wv", "Wo", "Wb", "b")

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        init = lambda *s, scale=0.2: (rng.normal(size=s) * scale).astype(np.float32)
        self.E, self.P = init(size, WIDTH), init(KEYS, WIDTH, scale=0.05)
        self.Wq, self.Wk, self.Wv = (init(WIDTH, WIDTH) for _ in range(3))
        self.Wo, self.Wb = init(WIDTH, CLASSES), init(WIDTH, CLASSES)
        self.b = np.zeros(CLASSES, np.float32)

    @staticmethod
    def causal() -> np.ndarray:
        return np.tril(np.ones((KEYS, KEYS), np.float32))

    def gradients(self, ids: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the valid positions, and its gradients.

        Positions before the first valid column give keys and values only. Class probabilities are made for ``ROWS`` positions at
        a time and never divided by their sums: the far smaller sides of the products are.
        """
        kind, root = self.E.dtype, self.E.dtype.type(WIDTH**-0.5)
        lo = int(valid.any(0).argmax())
        n, ok = max(1, int(valid.sum())), valid[:, lo:].ravel()
        heads, outs = np.concatenate([self.Wq * root, self.Wk, self.Wv], 1), np.concatenate([self.Wo, self.Wb, self.b[None]])
        e = self.E[ids]
        x = e + self.P
        flat = x.reshape(-1, WIDTH)
        qkv = (flat @ heads).reshape(*ids.shape, 3 * WIDTH)
        q, k, v = qkv[:, lo:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        a = q @ k.swapaxes(1, 2)
        np.exp(np.clip(a, -50, 50, out=a), out=a)
        a *= self.causal()[lo:]
        a /= a.sum(-1, keepdims=True)
        z = np.ones((*a.shape[:2], 2 * WIDTH + 1), kind)
        z[..., :WIDTH], z[..., WIDTH:-1] = a @ v, e[:, lo:]
        z = z.reshape(-1, 2 * WIDTH + 1)
        dz, gouts, at_aim = np.empty((len(z), 2 * WIDTH), kind), np.zeros_like(outs), np.empty(len(z), kind)
        aim, back, ones = targets[:, lo:].ravel(), np.ascontiguousarray(outs[:-1].T), np.ones(CLASSES, kind)
        room = np.empty((min(ROWS, len(z)), CLASSES), kind)
        # no exponent can overflow within these bounds
        tame = np.einsum("ij,ij->i", z, z).max() * np.einsum("ij,ij->j", outs, outs).max() < 80**2
        for at in range(0, len(z), ROWS):
            part, t, here = z[at : at + ROWS], aim[at : at + ROWS], ok[at : at + ROWS]
            p, each = room[: len(part)], np.arange(len(part))
            np.matmul(part, outs, out=p)
            if not tame:
                p -= p.max(-1, keepdims=True)
            np.exp(p, out=p)
            sums = p @ ones
            at_aim[at : at + ROWS] = p[each, t] / sums
            p[each, t] -= sums
            share = (here / (n * sums)).astype(kind)[:, None]
            np.multiply(p @ back, share, out=dz[at : at + ROWS])
            gouts += (p.T @ (part * share)).T
        loss = float(-np.log(at_aim[ok] + 1e-30).sum() / n)
        g = {"Wo": gouts[:WIDTH], "Wb": gouts[WIDTH:-1], "b": gouts[-1]}
        dz = dz.reshape(len(ids), -1, 2 * WIDTH)
        do = dz[..., :WIDTH]
        da = do @ v.swapaxes(1, 2)
        ds = a * (da - np.einsum("...i,...i", da, a)[..., None])
        dqkv = np.zeros_like(qkv)
        np.matmul(ds, k, out=dqkv[:, lo:, :WIDTH])
        np.matmul(ds.swapaxes(1, 2), q, out=dqkv[..., WIDTH : 2 * WIDTH])
        np.matmul(a.swapaxes(1, 2), do, out=dqkv[..., 2 * WIDTH :])
        dheads = flat.T @ dqkv.reshape(-1, 3 * WIDTH)
        g |= {"Wq": dheads[:, :WIDTH] * root, "Wk": dheads[:, WIDTH : 2 * WIDTH], "Wv": dheads[:, 2 * WIDTH :]}
        dx = (dqkv.reshape(-1, 3 * WIDTH) @ heads.T).reshape(x.shape)
        g["P"] = dx.sum(0)
        dx[:, lo:] += dz[..., WIDTH:]
        g["E"] = row_sums(ids.ravel(), dx.reshape(-1, WIDTH), len(self.E))
        return loss, g

    def fit(self, ids: np.ndarray, targets: np.ndarray, valid: np.ndarray, epochs: int, seed: int) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        v = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        total = max(1, epochs * -(-len(ids) // BATCH))
        for _ in range(epochs):
            order, sums = rng.permutation(len(ids)), []
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                loss, g = self.gradients(ids[part], targets[part], valid[part])
                sums.append(loss)
                step += 1
                rate = RATE * min(1.0, step / 50) * (1 - 0.9 * step / total)
                for n in self.NAMES:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
                    update = rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)
                    setattr(self, n, (getattr(self, n) - update).astype(np.float32))
            losses.append(float(np.mean(sums)) if sums else 0.0)
        return losses


class Local:
    """A task's own copy of the weights, trained on the windows it is given; how often each embedding and all else was used."""

    def __init__(self, model: Attention, row: np.ndarray, classes: np.ndarray, seed: int):
        self.row, self.classes, self.rng = row, classes, np.random.default_rng(seed)
        self.E, self.net = model.E.copy(), copy.copy(model)
        self.squares = {n: np.zeros_like(getattr(model, n)) for n in model.NAMES}
        self.uses, self.windows = np.zeros(len(self.E), np.float32), 0
        self.seen, self.place = np.zeros(len(self.E), bool), np.zeros(len(self.E), np.int64)

    def learn(self, windows: np.ndarray) -> None:
        """Adagrad over shuffled batches; each window once."""
        order = self.rng.permutation(len(windows))
        for at in range(0, len(order), STEP):
            w = windows[order[at : at + STEP]]
            there = w >= 0
            # what stands at -1, the fill of short windows, comes after all valid positions
            rows = self.row[w[:, :-1]]
            self.seen[rows] = True
            used = np.flatnonzero(self.seen)
            self.seen[used], self.place[used] = False, np.arange(len(used))
            ids = self.place[rows]
            valid = there[:, 1:] & (np.arange(KEYS) >= KEYS - STRIDE)
            self.net.E = self.E[used]
            _, g = self.net.gradients(ids, self.classes[w[:, 1:]], valid)
            e = g.pop("E")
            self.squares["E"][used] += e * e
            self.E[used] -= RATES[0] * e / (np.sqrt(self.squares["E"][used]) + 1e-6)
            for n, d in g.items():
                self.squares[n] += d * d
                setattr(self.net, n, (getattr(self.net, n) - RATES[1] * d / (np.sqrt(self.squares[n]) + 1e-6)).astype(np.float32))
            self.uses[used] += np.bincount(ids[there[:, :-1]], minlength=len(used))
            self.windows += len(w)

    def sums(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(chunk, weighted weights, their weights): chunks of embeddings, and -1 for all else."""
        flat = np.concatenate([getattr(self.net, n).ravel() for n in self.net.NAMES if n != "E"])
        yield -1, (flat * np.float32(self.windows)).tobytes(), np.float32([self.windows]).tobytes()
        for c in range(0, len(self.E), CHUNK):
            uses = self.uses[c : c + CHUNK]
            if uses.any():
                yield c // CHUNK, (self.E[c : c + CHUNK] * uses[:, None]).tobytes(), uses.tobytes()


def train_all(coded: DataFrame, model: Attention, row: np.ndarray, classes: np.ndarray, kind: type, seed: int) -> int:
    """Trains ``model`` on all windows of all ``encoded`` texts: each task on its share, then weights are averaged by their uses.

    ``row`` gives the embedding of a subword. Returns the number of windows.
    """
    chars = coded.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    shares = coded.select("near", "ids").repartition(max(1, -(-chars // SHARE_CHARS)), "near").sortWithinPartitions("near", "ids").select("ids")
    shared = coded.sparkSession.sparkContext.broadcast((model, row, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        local, pool, held = Local(*shared.value, seed + part), [], 0
        for batch in batches:
            for ids in decoded(batch, kind):
                made = windows_of(ids)
                pool.append(made)
                held += len(made)
                if held >= POOL:
                    local.learn(np.concatenate(pool))
                    pool, held = [], 0
        if pool:
            local.learn(np.concatenate(pool))
        if local.windows:
            for chunk, sums, uses in local.sums():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([chunk]), pa.array([sums]), pa.array([uses])], ["part", "chunk", "sums", "uses"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = {n: sum(np.frombuffer(v, np.float32).astype(np.float64) for v in group[n]).astype(np.float32).tobytes() for n in ("sums", "uses")}
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "chunk": [int(group["chunk"].iloc[0])], **{n: [v] for n, v in total.items()}})

    schema = "part bigint, chunk bigint, sums binary, uses binary"
    some = cut_lineage(shares.mapInArrow(run, schema)).groupBy("chunk", F.floor(F.col("part") / FAN)).applyInPandas(add, schema)
    windows = 0
    # one row for each chunk of embeddings, and one more
    for r in some.groupBy("chunk").applyInPandas(add, schema).collect():
        sums, uses = np.frombuffer(r.sums, np.float32), np.frombuffer(r.uses, np.float32)
        if r.chunk >= 0:
            at = r.chunk * CHUNK + np.flatnonzero(uses)
            model.E[at] = sums.reshape(len(uses), -1)[uses > 0] / uses[uses > 0, None]
            continue
        windows, start = int(uses[0]), 0
        for n in model.NAMES:
            if n != "E":
                w = getattr(model, n)
                setattr(model, n, (sums[start : start + w.size] / uses[0]).reshape(w.shape))
                start += w.size
    return windows


class Scorer:
    """A fitted model in the form that scores: a table row for each subword, and the counts inside classes."""

    def __init__(self, model: Attention, used: np.ndarray, sub: Subwords, classes: np.ndarray, counts: np.ndarray, rank: np.ndarray):
        self.path, self.pattern = sub.path, sub.pattern
        self.classes = classes.astype(np.uint8)
        # a row for each subword of the training texts, and one for all others: their mean
        self.row = np.full(len(classes), len(used), np.int32)
        self.row[used] = np.arange(len(used))
        e = np.concatenate([model.E, model.E.mean(0, keepdims=True)]).astype(np.float32)
        root = np.float32(WIDTH**-0.5)
        heads = np.concatenate([model.Wq * root, model.Wk, model.Wv], 1)
        self.table, self.place = e @ heads, (model.P @ heads)[None]
        self.direct = (e @ model.Wb + model.b).astype(np.float32)
        self.out, self.ones = model.Wo, np.ones(CLASSES, np.float32)
        self.mask = Attention.causal()[KEYS - STRIDE :]
        # no exponent can overflow if these bounds hold, as they do for all but odd fits
        long = lambda t: float(np.linalg.norm(t, axis=-1).max())
        part = lambda t, i: t[..., i * WIDTH : (i + 1) * WIDTH]
        q, k, v = (long(part(self.table, i)) + long(part(self.place, i)) for i in range(3))
        self.tame = q * k < 80 and float(self.direct.max()) + v * long(self.out.T) < 80
        both, self.rank = counts.sum(0), rank
        size, mass = np.bincount(classes, minlength=CLASSES), np.bincount(classes, both, minlength=CLASSES)
        own = (both + 1.0) / (mass + size)[classes]
        groups = [np.bincount(classes, row, minlength=CLASSES)[classes] for row in counts]
        #: log10 probability of a subword inside its class, by context
        self.inside = np.array([np.log10((row + PRIOR * own) / (all_of + PRIOR)) for row, all_of in zip(counts, groups)], np.float32)

    def word(self, ids: list[int]) -> float:
        """log10 probability of the subwords of a word inside their classes."""
        total, before = 0.0, 0
        for i in ids:
            total += self.inside.item(before, i)
            before = self.rank.item(i)
        return total

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of the classes of each framed text's ids."""
        out, lead = np.zeros(len(texts)), KEYS - STRIDE
        counts = [len(window_starts(len(t) - lead - 1)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), counts)
        long = np.concatenate([np.concatenate([t, np.full(KEYS + 1, t[-1], np.int32)]) for t in texts])
        ends = np.cumsum([0] + [len(t) + KEYS + 1 for t in texts])
        starts = np.concatenate([ends[i] + window_starts(len(t) - lead - 1) for i, t in enumerate(texts)])
        stop = ends[:-1] + np.array([len(t) for t in texts])
        steps, at = np.arange(KEYS + 1), np.arange(STRIDE)
        room = {n: np.empty((_WINDOWS, *shape), np.float32) for n, shape in (
            ("x", (KEYS, 3 * WIDTH)), ("s", (STRIDE, KEYS)), ("o", (STRIDE, WIDTH)), ("l", (STRIDE, CLASSES)), ("m", (STRIDE, CLASSES))
        )}
        for a in range(0, len(starts), _WINDOWS):
            own, first = owner[a : a + _WINDOWS], starts[a : a + _WINDOWS]
            n = len(first)
            x, s, o, logits, more = (room[k][:n] for k in "xsolm")
            ids = long[first[:, None] + steps]
            rows = self.row[ids[:, :-1]]
            np.take(self.table, rows, axis=0, out=x, mode="clip")
            x += self.place
            q, k, v = x[:, lead:, :WIDTH], x[:, :, WIDTH : 2 * WIDTH], x[:, :, 2 * WIDTH :]
            np.matmul(q, k.swapaxes(1, 2), out=s)
            if not self.tame:
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            s *= self.mask
            np.matmul(s, v, out=o)
            o /= (s @ self.ones[:KEYS])[..., None]
            np.take(self.direct, rows[:, lead:], axis=0, out=logits, mode="clip")
            np.matmul(o.reshape(-1, WIDTH), self.out, out=more.reshape(-1, CLASSES))
            logits += more
            if not self.tame:
                logits -= logits.max(-1, keepdims=True)
            flat = logits.reshape(-1, CLASSES)
            target = self.classes[ids[:, lead + 1 :].ravel()]
            hit = flat[np.arange(len(target)), target].astype(np.float64)
            np.exp(flat, out=flat)
            hit -= np.log(flat @ self.ones)
            valid = first[:, None] + lead + 1 + at < stop[own][:, None]
            out += np.bincount(own, (hit.reshape(-1, STRIDE) * valid).sum(1), minlength=len(texts))
        return out / np.log(10)


def train(texts: DataFrame, words: DataFrame, path: str, pattern: str, epochs: int = EPOCHS, seed: int = 7) -> tuple[Scorer, list[float]]:
    """A scorer from training texts (id, text) and their word counts (word, n); the losses of the epochs."""
    sub = Subwords(path, pattern)
    plain = subword_counts(words, path, pattern, sub.size, np.full(sub.size, CONTEXTS - 1))
    rank = context_ranks(plain.sum(0))
    counts = subword_counts(words, path, pattern, sub.size, rank)
    total = counts.sum(0)
    coded = cut_lineage(encoded(texts, path, pattern, seed))
    classes = _classes(total, neighbours(coded, sub.kind, _known(total, sub.end)[0]), sub.end, seed)
    windows = _sample(coded, sub.kind, seed)
    some = np.unique(np.concatenate([windows[windows >= 0].ravel(), [sub.begin, sub.end]]))
    dense = np.searchsorted(some, np.where(windows >= 0, windows, sub.end))
    ids, nexts = dense[:, :-1], classes[some][dense[:, 1:]]
    valid = (windows[:, 1:] >= 0) & (np.arange(KEYS) >= KEYS - STRIDE)
    model = Attention(len(some), seed)
    losses = model.fit(ids, nexts, valid, epochs if len(ids) else 0, seed)
    # subwords outside the sample start from the mean of those in it
    used = np.union1d(some, np.flatnonzero(total))
    fitted, model.E = model.E, np.tile(model.E.mean(0), (len(used), 1))
    model.E[np.searchsorted(used, some)] = fitted
    row = np.zeros(sub.size, np.int32)
    row[used] = np.arange(len(used))
    if epochs and len(ids):
        train_all(coded, model, row, classes, sub.kind, seed)
    return Scorer(model, used, sub, classes, counts, rank), losses


class _Lookup:
    """The broadcast words by number, with their counts, subwords (one array for all) and score inside classes."""

    def __init__(self, scorer: Scorer, heavy: list[tuple[bytes, int]]):
        self.scorer, self.sub = scorer, Subwords(scorer.path, scorer.pattern)
        self.number = {w: i for i, (w, _) in enumerate(heavy)}
        self.gain = np.log10(np.array([n for _, n in heavy], np.float64) + 1)
        ids = [self.sub.of(w) for w, _ in heavy]
        self.length = np.array([len(i) for i in ids], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.ids = np.array([i for w in ids for i in w], np.int32)
        self.inside = np.array([scorer.word(i) for i in ids], np.float64)

    def _others(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
        """Subwords of words that are not broadcast, how many each has, and their score inside classes."""
        pieces = list(map(self.sub.known.__getitem__, words))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // np.int32().itemsize
        flat = np.frombuffer(b"".join(pieces), np.int32)
        context = np.zeros(len(flat), np.int64)
        context[1:] = self.scorer.rank[flat[:-1]]
        context[np.cumsum(lengths) - lengths] = 0
        return flat, lengths, float(self.scorer.inside[context, flat].sum(dtype=np.float64))

    def read(self, text: bytes) -> tuple[int, int, float, float, np.ndarray, list[bytes]]:
        """Words, those broadcast, their log10 counts, the score inside classes, framed ids, the other words."""
        total = known = 0
        gain = inside = 0.0
        parts, rest = [], []
        get = self.number.get
        for part in segments(text):
            words = part.lower().split()
            if not words:
                continue
            numbers = np.array([get(w, -1) for w in words], np.int64)
            there = numbers >= 0
            here = numbers[there]
            others = [words[i] for i in np.flatnonzero(~there).tolist()]
            flat, lengths, value = self._others(others)
            total, known = total + len(words), known + len(here)
            gain += float(self.gain[here].sum())
            inside += float(self.inside[here].sum()) + value
            # each word's place in the array of all broadcast subwords, other words behind its end
            size = np.empty(len(words), np.int64)
            size[there], size[~there] = self.length[here], lengths
            begin = np.full(len(words), len(self.ids), np.int64)
            begin[there] = self.start[here]
            ends = np.cumsum(size)
            at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
            own = np.repeat(there, size)
            ids = np.empty(len(at), np.int32)
            ids[own] = self.ids[at[own]]
            ids[~own] = flat
            parts.append(ids)
            rest += others
        whole = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return total, known, gain, inside, framed(whole, self.sub), rest


_LOOKUPS: dict[str, _Lookup] = {}
_PASS = "row bigint, n_tokens bigint, heavy bigint, gain double, score double, others array<string>"


def heavy_words(words: DataFrame, most: int = HEAVY) -> tuple[list[tuple[bytes, int]], int]:
    """The words whose count is at least a threshold under which at most ``most`` words remain; the threshold.

    The threshold comes from a histogram of counts with sixteen steps for each doubling.
    """
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1], r[2]) for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1)), F.min("n")).collect()), reverse=True)
    held, least = 0, None
    for _, n, low in sizes:
        if held + n > most:
            break
        held, least = held + n, low
    if least is None:
        return [], 1 << 62
    return [(r[0].encode(), r[1]) for r in words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()], least


def score_texts(docs: DataFrame, training: Column, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row; learns from the rows that
    ``training`` selects.

    Fixed results: null and empty texts are the end token alone; repeated rows are scored each for itself, null ids too; without
    training texts N and V are 0; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = rows.where("training").select(F.col("doc_id").alias("id"), "text")
    words = cut_lineage(count_words(own))
    ends = own.count()
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = n_words + ends, kinds + (ends > 0)
    scorer, _ = train(own, words, path, pattern, epochs)
    heavy, least = heavy_words(words)
    shared, name = spark.sparkContext.broadcast((scorer, heavy)), uuid.uuid4().hex
    end_gain = float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one look-up table per worker, for the latest broadcast
        if name not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[name] = _Lookup(*shared.value)
        look, number = _LOOKUPS[name], TaskContext.get().partitionId() << 33
        for batch in batches:
            all_texts = texts_of(batch, "text")
            at = 0
            while at < len(all_texts):
                stop, size = at, 0
                while stop < len(all_texts) and (stop == at or size + len(all_texts[stop]) < SEGMENT):
                    size += len(all_texts[stop])
                    stop += 1
                found = [look.read(t) for t in all_texts[at:stop]]
                scores = look.scorer.score([f[4] for f in found]) + [f[3] for f in found]
                part = batch.slice(at, stop - at)
                made = [
                    pa.array(range(number, number + len(found)), pa.int64()),
                    pa.array([f[0] + 1 for f in found], pa.int64()),
                    pa.array([f[1] + (ends > 0) for f in found], pa.int64()),
                    pa.array([f[2] + end_gain for f in found], pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array([[w.decode() for w in f[5]] for f in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("training"), *made], ["doc_id", "training", *[c.split()[0] for c in _PASS.split(", ")]])
                number, at = number + len(found), stop

    schema = rows.select("doc_id", "training", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _PASS.split(", "))]).schema
    passed = cut_lineage(rows.mapInArrow(run, schema))
    light = words.where(F.col("n") < least).select("word", F.log10(F.col("n") + 1).alias("g"))
    met = passed.select("row", F.explode("others").alias("word")).join(light, "word")
    sums = met.groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum("g").alias("g"))
    out = passed.drop("others").join(sums, "row", "left")
    return out.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("heavy") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("gain") + F.coalesce("g", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        "score",
    )
