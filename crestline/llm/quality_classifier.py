"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax output.

The vectors are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  As the output
is linear in the averaged vector, a trained model is one number per bucket and a text scores where it lies.

Defined cases: a null or empty text scores by the bias alone; repeated rows each get a row; without labels of both
classes every score is the only label, or 0; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import fold, labelled_sample, read, whole_text
from crestline.llm.wordhash import mix, word_powers
from crestline.session import stage

#: Labelled rows that the model is fitted on, at most about.
SAMPLE = 6000
BUCKETS = 1 << 16
GRAMS = (3, 4)
WIDTH = 8
EPOCHS, BATCH, RATE = 4, 64, 8.0
KEPT = 0.3
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 19
SEED = 11

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams and words of a text, in parts; case and symbols count.

    White space is the border sign of words, so n-grams at a border tell it.  Parts overlap by the n-grams' length; a
    word that a part cuts counts once in each.
    """
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8)
    for low in range(0, len(data), CHUNK):
        part = data[low : low + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        part[_SPACE[part]] = 32
        own = len(part) if len(part) < CHUNK else CHUNK
        out = []
        for n in GRAMS:
            code = np.full(max(0, min(own, len(part) - n + 1)), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                code = (code ^ part[k : k + len(code)]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            out.append(code * np.uint32(0x2C1B3C6D) >> np.uint32(16))
        word = part != 32
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(start):
            powers, back = word_powers(1 << max(12, len(part).bit_length()))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=total[1:])
            out.append((mix((total[stop] - total[start]) * back[start]) >> np.uint64(48)).astype(np.uint32))
        yield np.concatenate(out).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """Log-odds per bucket, and the bias."""

    value: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, count = 0.0, 0
        for part in buckets(text):
            total += float(self.value[part].sum())
            count += len(part)
        return float(1 / (1 + np.exp(-(self.bias + total / max(1, count)))))

    @classmethod
    def constant(cls, label: int) -> Model:
        return cls(np.zeros(BUCKETS), 40.0 if label else -40.0)

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray) -> Model:
        """Vectors and softmax weights by gradient steps over shuffled batches, at a rate that falls to nothing."""
        rows = []
        for text in texts:
            seen, times = np.unique(np.concatenate(list(buckets(text))), return_counts=True)
            rows.append((seen.astype(np.int32), (times / times.sum()).astype(np.float32)))
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        output, bias = np.zeros((WIDTH, 2), np.float32), np.log(np.array([1 - share, share]))
        steps = EPOCHS * -(-len(rows) // BATCH)
        done = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                some = order[low : low + BATCH]
                ids = np.concatenate([rows[k][0] for k in some])
                part = np.concatenate([rows[k][1] for k in some])
                first = np.cumsum([0, *[len(rows[k][0]) for k in some[:-1]]])
                mean = np.add.reduceat(vectors[ids] * part[:, None], first, axis=0)
                logit = mean @ output + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                rate = RATE * (1 - done / steps)
                back = np.repeat((p @ output.T).astype(np.float32), np.diff([*first, len(ids)]), axis=0) * part[:, None]
                output -= (rate / len(some) * mean.T @ p).astype(np.float32)
                bias -= rate / 10 * p.mean(0)
                for d in range(WIDTH):
                    vectors[:, d] -= (rate * np.bincount(ids, back[:, d], BUCKETS)).astype(np.float32)
                done += 1
        return cls((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    some = stage(labelled_sample(docs, labels, "quality", sample), "quality-sample").toPandas()
    some = some.sort_values(["slot", "doc_id", "text"], ignore_index=True)
    kinds = some["label"].unique().tolist()
    if len(kinds) < 2:
        return Model.constant(kinds[0] if kinds else 0)
    return Model.fit(some["text"].tolist(), (some["label"] > 0).to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.fromiter(map(model.score, batch["text"]), float, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return source.mapInPandas(rate, "doc_id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out), read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEPT).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE: dict[str, str] = {}
