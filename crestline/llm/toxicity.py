"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words whose document frequency among toxic rows is significantly raised.  Lexicon counts,
features and scores are worked out where the texts lie; the driver sees the lexicon and the feature rows of a bounded
sample, from which it fits the trees.

Defined cases: a null or empty text scores like any text without words; repeated rows each get a row; without usable
labels every score is 0; an empty table gives no rows.  Extra columns are not read, except by ``reject``, which keeps
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import fold, keep_rows, labelled_sample, read, whole_text
from crestline.llm.wordhash import hashed_words
from crestline.session import stage

#: Labelled rows that the model may be fitted on.
SAMPLE = 20_000
#: Share of the sample, in thousandths, that trains lexicon and trees; the rest calibrates.
TRAIN = 700
#: Lexicon words: at most so many, with this z-score and log-odds at least.
LEXICON, LEAST_Z, LEAST_ODDS = 500, 3.0, 1.5
REJECT = 0.3
NEAR, SPAN = 5, 32
TREES, DEPTH, BINS, RATE = 60, 3, 64, 0.15

# fixed values: second-person words of the four languages
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes".split()

_CODES = np.zeros(256, np.int8)
_CODES[[*range(65, 91)]] = 1
_CODES[[*range(97, 123), *range(128, 256)]] = 2
_CODES[[*range(48, 58)]] = 3
_CODES[[*b"@$*!#%&+_"]] = 4
_CODES[[*b"\"'(),-./:;<=>?[\\]^`{|}~"]] = 5

FEATURES = (
    "log_words lexicon_density lexicon_count weight_density weight_max second_person near_second_person densest_span "
    "capitals symbols punctuation digits obfuscation elongation"
).split()


def features(texts: list[str | None], lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; ``lexicon`` holds sorted word hashes."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not texts:
        return out
    hashes, bounds = hashed_words(texts)
    second = np.sort(hashed_words([" ".join(SECOND_PERSON)])[0])

    def inside(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return table[at] == hashes, at

    hit, at = inside(lexicon)
    you, _ = inside(second)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), size)
    per = lambda x: np.bincount(doc, x, minlength=len(texts))
    words = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 2] = per(hit)
    out[:, 1] = out[:, 2] / words
    own = np.where(hit, weight[at] if len(weight) else 0.0, 0.0)
    out[:, 3] = per(own) / words
    np.maximum.at(out[:, 4], doc[hit], own[hit])
    out[:, 5] = per(you) / words
    place, person = np.nonzero(hit)[0], np.nonzero(you)[0]
    if len(place) and len(person):
        for side in (np.searchsorted(person, place) - 1, np.minimum(np.searchsorted(person, place), len(person) - 1)):
            near = (side >= 0) & (np.abs(person[side] - place) <= NEAR) & (doc[person[side]] == doc[place])
            out[:, 6] += np.bincount(doc[place[near]], minlength=len(texts))
        out[:, 6] /= words
    if len(place):
        # lexicon words of the same text within the next SPAN words
        ahead = np.searchsorted(place, np.minimum(place + SPAN, bounds[doc[place] + 1]))
        np.maximum.at(out[:, 7], doc[place], (ahead - np.arange(len(place))).astype(float))
    for k, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        if not len(data):
            continue
        code = _CODES[data]
        n = np.bincount(code, minlength=6)
        letter = (code == 1) | (code == 2)
        out[k, 8] = n[1] / max(1, n[1] + n[2])
        out[k, 9:12] = n[4] / len(data), n[5] / len(data), n[3] / len(data)
        odd = (code == 3) | (code == 4)
        out[k, 12] = 100 * np.count_nonzero(letter[:-2] & odd[1:-1] & letter[2:]) / words[k]
        same = data[1:] == data[:-1]
        out[k, 13] = 100 * np.count_nonzero(same[1:] & same[:-1] & letter[2:]) / words[k]
    return out


@dataclass
class Boosted:
    """Depth-limited regression trees for the logistic loss, split on quantile bins."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(mean / (1 - mean))))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        raw = np.full(len(y), model.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            inner = (1 << DEPTH) - 1
            feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << DEPTH)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, many = (1 << level) - 1, 1 << level
                best = np.full(many, 1e-6)
                for f, c in enumerate(cuts):
                    key = (node - first) * BINS + binned[:, f]
                    g = np.bincount(key, grad, many * BINS).reshape(many, BINS).cumsum(1)
                    h = np.bincount(key, hess, many * BINS).reshape(many, BINS).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    gain[(h < 1) | (total_h - h < 1)] = 0
                    gain = gain[:, : len(c)]
                    if not gain.size:
                        continue
                    top = gain.argmax(1)
                    for k in np.nonzero(gain[np.arange(many), top] > best)[0]:
                        best[k] = gain[k, top[k]]
                        feature[first + k], cut[first + k] = f, c[top[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = -RATE * np.bincount(leaf, grad, 1 << DEPTH) / (np.bincount(leaf, hess, 1 << DEPTH) + 1)
            raw += value[leaf]
            model.trees.append((feature, cut, value))
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit: mean raw score and smoothed share of each pooled block."""
    blocks: list[list[float]] = []
    order = np.argsort(raw, kind="stable")
    for r, label in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([r, label, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    base = (y.sum() + 1) / (len(y) + 2)
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate([(b[1] + base) / (b[2] + 1) for b in blocks])


@dataclass
class Model:
    lexicon: np.ndarray
    weight: np.ndarray
    trees: Boosted | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        raw = self.trees.raw(features(texts, self.lexicon, self.weight))
        level = np.interp(raw, *self.knots) if self.knots is not None else 1 / (1 + np.exp(-raw))
        # the calibrated level is flat in places; a thousandth of the raw score keeps the order
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of the words that set toxic rows apart, from document counts per word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, bounds = hashed_words(batch["text"].tolist())
            label = batch["label"].to_numpy(np.int64)
            own = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
            word = np.concatenate(own) if own else np.zeros(0, np.uint64)
            toxic = np.repeat(label, [len(w) for w in own])
            each, at = np.unique(word, return_inverse=True)
            docs, bad = np.bincount(at, minlength=len(each)), np.bincount(at, toxic, len(each)).astype(np.int64)
            yield pd.DataFrame({"word": each.view(np.int64), "docs": docs, "toxic": bad})

    train = sample.where(F.col("slot") < TRAIN)
    total, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    words = train.mapInPandas(count, "word long, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (total - toxic + 1))
    scored = words.select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    top = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    table = sorted((np.uint64(r["word"] & (1 << 64) - 1), r["odds"]) for r in top)
    return np.array([w for w, _ in table], np.uint64), np.array([o for _, o in table])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    some = stage(labelled_sample(docs, labels, "toxic", sample), "toxic-sample")
    lexicon, weight = _lexicon(some)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = features(batch["text"].tolist(), lexicon, weight)
            yield pd.DataFrame({"label": batch["label"], "slot": batch["slot"], "x": list(x)})

    table = some.mapInPandas(rows, "label int, slot int, x array<double>").toPandas()
    model = Model(lexicon, weight)
    if table["label"].nunique() < 2:
        return model
    table = table.assign(key=table["x"].map(tuple)).sort_values(["slot", "label", "key"])  # the same order on every run
    x, y, slot = np.stack(table["x"].tolist()), table["label"].to_numpy(float), table["slot"].to_numpy()
    fit, check = slot < TRAIN, slot >= TRAIN
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[check])) < 2:
        model.trees = Boosted.fit(x, y)
    else:
        model.trees = Boosted.fit(x[fit], y[fit])
        model.knots = isotonic(model.trees.raw(x[check]), y[check])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                some = batch.iloc[low : low + 512]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "score": model.score(some["text"].tolist())})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return source.mapInPandas(rate, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; every row is judged by its own text."""
    return keep_rows(docs, lambda texts: model.score(texts) < least)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
