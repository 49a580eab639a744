"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Words and stems that tell toxic from clean labelled rows (by a test of their odds, not by their number) make lexicons;
groups of them and hand-written patterns vote toxic, clean or nothing on each text. The label model knows votes only: its two classes have a mean vote per voter (its accuracy)
and a covariance of votes (their correlations), fitted by expectation-maximisation, so that voters who repeat one
another count less. A logistic regression over words and stems learns the posteriors and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import small_batches, text_of, written

#: How many standard errors a feature's log odds must be from 0, and a lexicon entry's lower bound of them above 0. fit
#: tries each pair on the part of the training rows whose remainder is 3, fitted on the others, and takes the best.
TESTS = ((3.0, 2.0), (3.0, 3.0), (3.0, 4.0), (4.0, 2.0), (4.0, 3.0))
#: Bound of what is fitted on: labelled rows, those of least hash. A parameter of fit.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
_EDGE = ".,;:!?\"'()[]{}*#&%$-_…«»“”’|/\\"
_GROUPS = 10
_SHOUT, _BANGS, _LONG = re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"!{2,}"), re.compile(r"(\w)\1{3,}")


def features_of(word: str) -> list[str]:
    """A lower-case word without marks at its ends, and its stems of 3 to 5 characters."""
    w = word.strip(_EDGE)
    return [w, *(f"{w[:k]}-" for k in (3, 4, 5) if len(w) > k)] if w else []


class _Ids(dict):
    """Ids of a word's known features, kept for a bounded number of words."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(i for f in features_of(word) if (i := self.ids.get(f)) is not None)
        if len(word) <= 48:
            if len(self) >= 250_000:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str) -> list[int]:
        return sorted({i for w in set(text.lower().split()) for i in self[w]})


@dataclass
class ToxicityModel:
    """features[i] has weights[i]; score is the logistic function of bias and the weights of a text's features."""

    features: list[str]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray  # mean vote of each voter for clean and for toxic texts
    correlations: np.ndarray  # of the voters' votes within a class


def train_ids(labels: DataFrame) -> DataFrame:
    """doc_id, y, part of the labelled rows that may be learnt from: crc32 of the id's digits is not 2 modulo 4; part 1 is
    remainder 3, on which bounds are chosen."""
    fit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    own = labels.where("doc_id is not null and toxic is not null").where(fit).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return own.withColumn("part", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).cast("int"))


def _patterns(text: str) -> list[int]:
    return [int(bool(_SHOUT.search(text))), int(bool(_BANGS.search(text))), int(bool(_LONG.search(text)))]


def _votes(hits: list[np.ndarray], patterns: np.ndarray, group: np.ndarray, is_stem: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per text +1 toxic, -1 clean, 0 nothing: groups of words and of stems, how many, how few, and patterns."""
    out = np.zeros((len(hits), 2 * _GROUPS + 3), int)
    for k, h in enumerate(hits):
        t = h[toxic[h]]
        stems = is_stem[t]
        out[k, group[t[~stems]]] = 1
        out[k, _GROUPS + group[t[stems]]] = 1
        n, m = int((~stems).sum()), int(stems.sum())
        out[k, -3] = 1 if n >= 3 else -1 if not n else 0
        out[k, -2] = 1 if m >= 3 else -1 if not m else 0
        out[k, -1] = 1 if len(t) * 50 >= len(h) + 1 else -1 if not len(t) else 0
    return np.concatenate([out, patterns], 1)


def label_model(votes: np.ndarray, prior: float, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, mean votes by class, correlations within classes) from votes alone and a class balance.

    Few rounds: a normal mixture that goes on is drawn to the single voter with the sharpest split.
    """
    x = votes.astype(float)
    # a voter starts with less weight the more it repeats others: one part for itself and for each that agrees with it
    own = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    alike = np.abs(own.T @ own / len(x)) ** 4
    z = x @ (1 / np.maximum(alike.sum(1), 1))
    p = np.clip(1 / (1 + np.exp(-z)), 0.01, 0.99)
    means = np.zeros((2, x.shape[1]))
    cov = np.eye(x.shape[1])
    for _ in range(rounds):
        w = np.stack([1 - p, p])
        means = (w @ x) / np.maximum(w.sum(1), 1e-9)[:, None]
        cov = sum((w[c][:, None] * (x - means[c])).T @ (x - means[c]) for c in (0, 1)) / len(x) + 0.05 * np.eye(x.shape[1])
        a = np.linalg.solve(cov, means[1] - means[0])
        z = x @ a - (means[0] + means[1]) @ a / 2 + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    s = np.sqrt(np.diag(cov))
    return p, means, cov / np.outer(s, s)


def _logistic(rows: list[np.ndarray], target: np.ndarray, n: int, rounds: int = 200, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by full-batch Adam."""
    lens = np.array([len(r) for r in rows])
    idx, row = np.concatenate([*rows, np.empty(0, int)]).astype(int), np.repeat(np.arange(len(rows)), lens)
    w, b = np.zeros(n), float(np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = b + np.bincount(row, w[idx], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g, gb = np.bincount(idx, r[row], n) + l2 * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        w, b = w - step * m / (np.sqrt(v) + 1e-8), b - step * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def _odds(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of features in a of n1 toxic and b of n0 clean texts, and their standard errors; both smoothed by a half."""
    return np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _flat(share: float) -> float:
    """The bias of a model without evidence: the share of toxic labels, but never enough to call a text toxic."""
    share = min(max(share, 1e-6), THRESHOLD * 0.9)
    return float(np.log(share / (1 - share)))


def _train(names: list[str], hits: list[np.ndarray], patterns: np.ndarray, y: np.ndarray, far: float, least: float) -> ToxicityModel:
    """The model of these texts; the labels only make the lexicons and the balance of classes."""
    n1 = int(y.sum())
    idx, row = np.concatenate([*hits, np.empty(0, int)]).astype(int), np.repeat(y, [len(h) for h in hits])
    a, b = np.bincount(idx[row == 1], minlength=len(names)), np.bincount(idx[row == 0], minlength=len(names))
    odds, error = _odds(a, b, n1, len(y) - n1)
    tells = (np.abs(odds) >= far * error) & (a + b > 1)
    toxic = tells & (odds - error > least)
    if not n1 or n1 == len(y) or not toxic.any():
        return ToxicityModel([], np.zeros(0), _flat(n1 / max(1, len(y))), np.zeros((2, 0)), np.zeros((0, 0)))
    new = np.cumsum(tells) - 1
    own = [new[h[tells[h]]] for h in hits]
    chosen = [n for n, t in zip(names, tells, strict=True) if t]
    group = np.array([zlib.crc32(n.encode()) % _GROUPS for n in chosen])
    votes = _votes(own, patterns, group, np.array([n.endswith("-") for n in chosen]), toxic[tells])
    p, means, correlations = label_model(votes, n1 / len(y))
    weights, bias = _logistic(own, p, len(chosen))
    return ToxicityModel(chosen, weights, bias, means, correlations)


def _scores(model: ToxicityModel, names: list[str], hits: list[np.ndarray]) -> np.ndarray:
    at = {f: i for i, f in enumerate(model.features)}
    w = np.array([model.weights[at[n]] if n in at else 0.0 for n in names])
    return 1 / (1 + np.exp(-np.clip([model.bias + w[h].sum() for h in hits], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fits on at most max_labelled labelled documents, whole texts, and all their words and stems that are in more than
    one. Bounds are chosen on training rows alone (see TESTS). Without labels of both kinds, or without evidence, the
    model has no features, and its score is the share of toxic labels, below the threshold. Repeated rows count as such."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = written(train_ids(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled-ids")
    texts = written(docs.select("doc_id", text_of().alias("t")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("t", "y", "part"), "labelled")

    total = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({f for w in set(t.lower().split()) for f in features_of(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["f", "a", "b"])

    by = texts.select("t", "y").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b > 1")
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    telling = by.where(F.abs(odds) >= min(t[0] for t in TESTS) * error).select("f")  # the rest can pass no test
    names = sorted(r["f"] for r in telling.collect())  # words of max_labelled texts
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Ids(shared.value)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "part": batch["part"], "hits": [np.array(known.of(t), np.int32) for t in batch["t"]], "patterns": [_patterns(t) for t in batch["t"]]})

    got = texts.mapInPandas(found, "y int, part int, hits array<int>, patterns array<int>").toPandas()
    y, part = got["y"].to_numpy(int), got["part"].to_numpy(int)
    hits = [np.asarray(h, int) for h in got["hits"]]
    patterns = np.array(got["patterns"].tolist(), int).reshape(len(got), 3)
    pick = lambda m: [h for h, x in zip(hits, m, strict=True) if x]
    best, bounds, told = -1.0, TESTS[-1], False
    seen, held = part == 0, part == 1
    for far, least in reversed(TESTS):  # of equals the strictest
        trial = _train(names, pick(seen), patterns[seen], y[seen], far, least)
        told = told or bool(trial.features)
        said = _scores(trial, names, pick(held)) >= THRESHOLD
        right = 2 * int((said & (y[held] == 1)).sum()) / max(1, int(said.sum()) + int(y[held].sum()))
        if right > best:
            best, bounds = right, (far, least)
    if not told:  # too few rows to choose on a part of them: the strictest that all of them pass
        models = (_train(names, hits, patterns, y, *b) for b in reversed(TESTS))
        return next((m for m in models if m.features), _train(names, hits, patterns, y, *bounds))
    return _train(names, hits, patterns, y, *bounds)


def score(docs: DataFrame, model: ToxicityModel, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, in place: no shuffle.

    A null or empty text has no features, so its score is that of the bias; rows without doc_id are not held out;
    repeated rows are kept; with keep, the columns of docs come first (but for those named like one of the three, which
    are replaced), else other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    used = spark.sparkContext.broadcast(({f: i for i, f in enumerate(model.features)}, model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, w, b = used.value
        known = _Ids(ids)
        for texts in batches:
            z = np.array([b + w[known.of(t)].sum() for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    out = docs.withColumn("__score", scored(text_of()))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")] if keep else [F.col("doc_id")]
    return out.select(*own, held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")
    return score(rows, fit(docs, labels), keep=True).where("predicted = 0").select("__row.*")
