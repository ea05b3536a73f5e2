"""Toxicity scoring with a counterfactually regularised linear model.

Features are the distinct words of a text and their leading 3 to 8 characters,
hashed. The model is a logistic regression. Beside the usual loss it penalises
score changes: in every training text that mentions an identity term, the term
is swapped for others of its kind, and the squared change of the score is added;
so is that of each pair of terms in a sentence of nothing else.
A score is a sum over distinct words, so scoring needs one cached number a word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialise, small_batches

# Groups of identity terms that a neutral text may mention; the
# terms of one group stand for each other in counterfactual sentences.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("noirs", "blancs", "arabes", "asiatiques"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("schwarze", "weiße", "araber", "asiaten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
    ("negros", "blancos", "árabes", "asiáticos"),
)

DIMENSIONS = 1 << 20
#: Share of the sample in which each pair of a group's terms counts as swapped.
MENTION_SHARE = 0.01
PREFIXES = range(3, 9)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    """Hashed features of one word: itself, and its prefixes."""
    forms = [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]
    return [zlib.crc32(f.encode("utf-8", "replace")) & (DIMENSIONS - 1) for f in forms]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the features that training kept (ascending ids), and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float


def _counts(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    for w in words:
        ids += features_of(w)
    return np.unique(np.array(ids, dtype=np.int32), return_counts=True)


def _swaps(words: set[str], groups: Sequence[Sequence[str]]) -> list[set[str]]:
    """The word sets of a text in which each identity term has been swapped, for every other of its group."""
    out = []
    for group in groups:
        for term in group:
            if term in words:
                out += [(words - {term}) | {other} for other in group if other not in words]
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    sample_rows: int = 6000,
    kept_features: int = 4096,
    penalty: float = 1.0,
    ridge: float = 0.3,
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> ToxicityModel:
    """Train on a bounded sample: about sample_rows labelled rows, half of each class.

    Labels are chosen by a hash of their key, and the chosen ones, about
    sample_rows at any size, are broadcast to the texts. Features are counted and
    the most telling chosen on the executors: the driver gets the ids of at most
    kept_features, and of each chosen text its counts of these. A null label
    teaches nothing; a null text counts as empty. Without rows of both classes
    the model scores every text 1 or 0, whichever was seen.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND key IS NOT NULL").distinct()
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(0)
    if len(n) < 2:
        return ToxicityModel(empty.astype(np.int32), empty, 30.0 if n.get(1) else -30.0)
    scale = 1 << 30
    share = {y: min(scale, math.ceil(scale * (sample_rows / 2) / c)) for y, c in n.items()}
    limit = F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < limit)
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"))
    # The bound of the broadcast is sample_rows, give or take the hash's luck.
    sample = rows.join(F.broadcast(chosen), "key").select("text", "y", F.xxhash64("key").alias("h"))
    sample = materialise(sample, "toxicity-sample")
    m = {r["y"]: r["m"] for r in sample.groupBy("y").agg(F.count("*").alias("m")).collect()}
    if max(m.values(), default=0) > sample_rows:  # a chosen key holds many rows: these are drawn from, by their texts
        thin = F.when(F.col("y") == 1, F.lit(scale * sample_rows // 2 // m.get(1, 1))).otherwise(F.lit(scale * sample_rows // 2 // m.get(0, 1)))
        sample = materialise(sample.where(F.pmod(F.xxhash64("text", "h", F.lit(1)), F.lit(scale)) < thin), "toxicity-sample")
        m = {r["y"]: r["m"] for r in sample.groupBy("y").agg(F.count("*").alias("m")).collect()}
    if len(m) < 2:
        return ToxicityModel(empty.astype(np.int32), empty, 30.0 if m.get(1) else -30.0)
    telling = _telling(sample, m, kept_features)
    if not len(telling):
        return ToxicityModel(empty.astype(np.int32), empty, float(np.log(m[1] / m[0])))
    kept, terms = telling, [list(g) for g in groups]

    def among(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        """Places of the kept features among ids, and their counts."""
        at = np.searchsorted(telling, ids)
        at[at == len(telling)] = 0
        hit = telling[at] == ids
        return at[hit].astype(np.int32).tobytes(), counts[hit].astype(np.int32).tobytes()

    def featurise(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        ids, counts, alts = [], [], []
        for t in batch.column(0).to_pylist():
            words = words_of(t)
            i, c = among(*_counts(words))
            ids.append(i)
            counts.append(c)
            here = []
            for swapped in _swaps(words, terms):
                a, b = _counts(swapped - words), _counts(words - swapped)
                here += among(np.concatenate([a[0], b[0]]), np.concatenate([a[1], -b[1]]))
            alts.append(here)
        return [pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(alts, pa.list_(pa.binary()))]

    got = add_columns(sample, "ids binary, counts binary, alts array<binary>", featurise).drop("text").collect()
    got.sort(key=lambda r: (r["h"], r["y"], bytes(r["ids"])))
    y = np.array([r["y"] for r in got], dtype=float)
    ids = [np.frombuffer(r["ids"], np.int32) for r in got]
    counts = [np.frombuffer(r["counts"], np.int32) for r in got]
    r_, c_, v_ = [], [], []
    for k, (at, val) in enumerate(zip(ids, counts)):
        r_.append(np.full(len(at), k)), c_.append(at), v_.append(val)
    X = (np.concatenate(r_), np.concatenate(c_), np.concatenate(v_).astype(float), len(got))
    r_, c_, v_, k = [], [], [], 0
    for row in got:
        alts = row["alts"]
        for j in range(0, len(alts), 2):
            at, val = np.frombuffer(alts[j], np.int32), np.frombuffer(alts[j + 1], np.int32)
            r_.append(np.full(len(at), k)), c_.append(at), v_.append(val)
            k += 1
    # A sum over words changes by the same amount in every sentence, so each pair of a group's terms is also swapped
    # as if in a small share of the sample, whether the sample has such sentences or not.
    times = math.sqrt(max(1.0, MENTION_SHARE * len(got)))
    for group in terms:
        for i, one in enumerate(group):
            for other in group[i + 1 :]:
                a, b = _counts({one}), _counts({other})
                at, val = (np.frombuffer(x, np.int32) for x in among(np.concatenate([a[0], b[0]]), np.concatenate([a[1], -b[1]])))
                r_.append(np.full(len(at), k)), c_.append(at), v_.append(val * times)
                k += 1
    D = (np.concatenate(r_), np.concatenate(c_), np.concatenate(v_).astype(float), k) if k else None
    # The sample is balanced; weights restore the classes' true shares, softened.
    prior = {c: math.sqrt(n[c] / max(1, m[c])) for c in (0, 1)}
    weight = np.where(y == 1, prior[1], prior[0])
    weight /= weight.mean()
    w, b = _train(X, y, weight, D, len(kept), ridge, penalty)
    return ToxicityModel(kept.astype(np.int32), w, b)


def _telling(sample: DataFrame, m: dict[int, int], most: int) -> np.ndarray:
    """Ids of the features whose document frequencies in the classes differ most significantly, ascending.

    Executors count, add up and choose; sample has text and y, m the rows of each class.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int32)]
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _counts(words_of(t))[0]
                found.append(np.stack([ids, np.full(len(ids), y, np.int32)]))
            ids, y = np.concatenate(found, axis=1)
            of, n = np.unique(ids.astype(np.int64) * 2 + y, return_counts=True)
            columns = [(of // 2).astype(np.int32), np.where(of % 2 == 0, n, 0), np.where(of % 2 == 1, n, 0)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["id", "d0", "d1"])

    df = sample.select("text", "y").mapInArrow(run, "id int, d0 long, d1 long").groupBy("id").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    rate = (F.col("d0") + F.col("d1")) / (m[0] + m[1])
    z = F.abs((F.col("d1") / m[1] - F.col("d0") / m[0]) / F.sqrt(rate * (1 - rate) * (1 / m[0] + 1 / m[1]) + 1e-9))
    told = df.where("d0 + d1 >= 3").select("id", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "id").limit(most)
    return np.sort(np.array([r["id"] for r in told.select("id").collect()], dtype=np.int32))


def _train(X, y, weight, D, n_features: int, ridge: float, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimise the regularised loss by gradient descent with per-feature step sizes."""
    rows, cols, vals, n = X
    w, b = np.zeros(n_features), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    g2, gb2 = np.full(n_features, 1e-8), 1e-8
    for step in range(steps):
        score = np.bincount(rows, vals * w[cols], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        err = weight * (p - y)
        grad = np.bincount(cols, vals * err[rows], minlength=n_features) + ridge * w
        if D is not None:
            change = np.bincount(D[0], D[2] * w[D[1]], minlength=D[3])
            grad += 2 * penalty * np.bincount(D[1], D[2] * change[D[0]], minlength=n_features)
        g2 += grad * grad
        gb2 += err.sum() ** 2
        w -= 0.5 * grad / np.sqrt(g2)
        b -= 0.5 * err.sum() / math.sqrt(gb2)
    return w, b


class Scorer:
    """Cached word weights of a model; one in each Python worker."""

    def __init__(self, model: ToxicityModel, cache_words: int = 1_000_000) -> None:
        self.weights = dict(zip(model.ids.tolist(), model.weights.tolist()))
        self.intercept, self.most = model.intercept, cache_words
        scorer = self

        class Cache(dict):
            def __missing__(self, word: str) -> float:
                got = sum(scorer.weights.get(f, 0.0) for f in features_of(word))
                if len(self) >= scorer.most:
                    self.clear()
                self[word] = got
                return got

        self.cache = Cache()

    def score(self, text: str | None) -> float:
        # fsum is exact, so equal texts get equal sums whatever the set's order.
        total = self.intercept + math.fsum(map(self.cache.__getitem__, words_of(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with a column score from 0 to 1; a column of that name is replaced.

    Null, empty and wordless texts get the intercept's score. Repeated rows get
    equal scores.
    """
    at = docs.drop("score").columns.index(text)
    made: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> Sequence[pa.Array]:
        if not made:
            made.append(Scorer(model))
        return [pa.array([made[0].score(t) for t in batch.column(at).to_pylist()], pa.float64())]

    return add_columns(docs, "score double", run)
