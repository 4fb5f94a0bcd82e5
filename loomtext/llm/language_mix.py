"""Language identification as inference of a mixture.

Each language is a distribution over hashed character n-grams, counted over all training texts. A text
is a mixture of languages: expectation-maximisation finds the proportions that make its n-grams most
likely. The set of languages starts with the best single one and grows by the language that gains most,
as long as the gain in log likelihood exceeds a penalty for one more proportion; the text's language is the
one with the largest proportion in the chosen set, and the score is that proportion.

The model has ``languages x BUCKETS`` counts whatever the size of the corpus: tasks count their own texts,
counts are summed in Spark, and only the sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

NONE = "und"
BUCKETS = 1 << 15
ORDER = 3
SMOOTHING = 0.5
ROUNDS = 12
#: log likelihood a further language has to gain, for each n-gram's logarithm: a Bayesian criterion
PENALTY = 3.0
#: more languages than this are refused: the model is broadcast and its bound is languages * BUCKETS * 4 bytes
MAX_LANGUAGES = 256

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: bytes) -> np.ndarray:
    """Bucket of each byte n-gram of the lower-cased text in which a run of other characters is one space."""
    raw = b" ".join((b" " + text.translate(_FOLD) + b" ").split())
    codes = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    if len(codes) < ORDER:
        return np.zeros(0, np.uint32)
    h = np.zeros(len(codes) - ORDER + 1, np.uint32)
    for k in range(ORDER):
        h = h * np.uint32(0x01000193) + codes[k : len(codes) - ORDER + 1 + k]
    h = h * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Mixture:
    """Languages with their n-gram log probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTHING
        self.p = np.ascontiguousarray((p / p.sum(1, keepdims=True)).T.astype(np.float32)) if languages else None

    def _fit(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log likelihood of the languages in the columns of ``p``."""
        k = p.shape[1]
        if k == 1:
            return np.ones(1), float(n @ np.log(p[:, 0]))
        w, total = np.full(k, 1.0 / k, np.float32), n.sum()
        for _ in range(ROUNDS):
            share = n / (p @ w)
            w = w * (share @ p) / total
        return w.astype(np.float64), float(n @ np.log(p @ w))

    def infer(self, text: bytes) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, score, proportions by language) of a text that has a letter."""
        if not self.languages:
            return NONE, 0.0, []
        where, n = np.unique(grams(text), return_counts=True)
        p, n = self.p[where], n.astype(np.float32)
        if not len(where):
            return self.languages[0], 1.0 / len(self.languages), []
        single = n @ np.log(p)
        chosen = [int(np.argmax(single))]
        weights, best = np.ones(1), float(single[chosen[0]])
        charge = PENALTY * np.log(max(2.0, float(n.sum())))
        while len(chosen) < len(self.languages):
            # a language gains at most what its n-grams gain when each takes its likeliest language
            now = p[:, chosen] @ weights.astype(np.float32)
            tries = []
            for other in set(range(len(self.languages))) - set(chosen):
                bound = float(n @ np.log(np.maximum(p[:, other] / now, 1)))
                if bound > charge:
                    w, value = self._fit(p[:, [*chosen, other]], n)
                    tries.append((value, -other, w))
            if not tries or max(tries)[0] - best <= charge:
                break
            best, other, weights = max(tries, key=lambda t: t[:2])
            chosen.append(-other)
        order = sorted(range(len(chosen)), key=lambda i: (-weights[i], self.languages[chosen[i]]))
        mix = [(self.languages[chosen[i]], float(weights[i])) for i in order]
        return mix[0][0], min(1.0, max(0.0, mix[0][1])), mix


def learn(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang") -> Mixture:
    """The model of all rows that ``rows`` selects and that have a language and a text."""
    labelled = docs.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, raw in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
                if language not in sums:
                    sums[language] = np.zeros(BUCKETS, np.int64)
                sums[language] += np.bincount(grams(raw), minlength=BUCKETS)
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for language, counts in sums.items():
            some = np.flatnonzero(counts)
            names = pa.array([language] * len(some), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(some), pa.array(counts[some])], ["lang", "bucket", "n"])

    found = labelled.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = found.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    rows_found = packed.limit(MAX_LANGUAGES + 1).collect()
    if len(rows_found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows_found.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(rows_found), BUCKETS))
    for k, r in enumerate(rows_found):
        counts[k, r["b"]] = r["n"]
    return Mixture([r["lang"] for r in rows_found], counts)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and mixture (language and proportion, largest first).

    Fixed results: a null text and a text without letters are ``und`` with score 0, as is every text if
    nothing was learned; ties take the language that comes first by name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.infer(t.encode()) if has_letter(t) else (NONE, 0.0, []) for t in batch.column(text).to_pylist()]
        made = [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], pairs),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "lang_pred", "score", "mixture"])

    extra = {"lang_pred": "string", "score": "double", "mixture": "array<struct<lang:string,share:double>>"}
    schema = docs.select(*names, *[F.lit(None).cast(t).alias(n) for n, t in extra.items()]).schema
    return map_batches(docs, run, schema)
