"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary
text, one of toxic text, and windows of a document compressed with each.

The dictionaries are trained apart. The toxic one is trained on what sets toxic
documents of the sample apart: their words that are much more common there
than in ordinary ones. Windows are compressed once with the ordinary dictionary
and once with the toxic one put before it, so what both know costs the same,
and the difference in length is what the toxic dictionary alone explains. The
threshold on these differences is calibrated by a logistic regression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .carry import with_text_columns
from .session import table

#: Labelled documents that dictionaries and threshold are fitted on, at most.
SAMPLE = 3000
#: Windows of ordinary texts among them that the ordinary dictionary is trained on, at most.
SAMPLE_WINDOWS = 40_000
WINDOW_WORDS = 8
LEVEL = 6
ORDINARY_BYTES = 8192
TOXIC_BYTES = 1024
#: A word sets toxic documents apart if it is in this share of them and that many times as common there.
LEAST_SHARE = 0.03
LEAST_RATIO = 8
FLAGGED = 0.3


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's bytes. Where there are too few samples to train on, their last `size` bytes, which zstandard takes as a dictionary too."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple:
        found = []
        for data in (self.ordinary, self.toxic + self.ordinary):
            if len(data) < 8:
                data = data + b" " * 8
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0)
            found.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress)
        return tuple(found)

    @staticmethod
    def features(text: bytes, compressors: tuple) -> np.ndarray:
        """Largest difference, mean of the 4 and 8 largest, mean of all, share of large ones."""
        parts = windows(text)
        if not parts:
            return np.zeros(5)
        plain, toxic = compressors
        gain = np.array([len(plain(x)) - len(toxic(x)) for x in parts], float)
        top = -np.sort(-gain)[:8]
        return np.array([top[0], top[:4].sum() / 4, top.sum() / 8, gain.mean(), (gain >= 6).mean()])

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(features), 1)), (features - self.means) / self.scales], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Dictionaries and calibration from labelled texts; with one label only, scores are its share.

    The toxic dictionary knows the words that are in LEAST_SHARE of the toxic
    texts and LEAST_RATIO times as common there as in the others; the ordinary
    one is trained on SAMPLE_WINDOWS of the others' windows at most.
    """
    words = [set(t.lower().split()) for t in texts]
    n_toxic, n_ordinary = int(toxic.sum()), int((~toxic).sum())
    in_toxic = Counter(w for s, bad in zip(words, toxic) if bad for w in s)
    in_ordinary = Counter(w for s, bad in zip(words, toxic) if not bad for w in s)
    telling = {w for w, c in in_toxic.items() if c >= LEAST_SHARE * n_toxic and (c + 0.5) / max(n_toxic, 1) > LEAST_RATIO * (in_ordinary[w] + 0.5) / max(n_ordinary, 1)}
    marks = [b" ".join(w for w in t.lower().split() if w in telling) for t, bad in zip(texts, toxic) if bad]
    plain = [x for t, bad in zip(texts, toxic) if not bad for x in windows(t)]
    picked = np.random.default_rng(0).permutation(len(plain))[:SAMPLE_WINDOWS]
    model = Model(_trained([plain[i] for i in picked], ORDINARY_BYTES), _trained([m for m in marks if len(m) >= 8], TOXIC_BYTES), np.zeros(5), np.ones(5), np.zeros(6))
    compressors = model.compressors()
    x = np.array([Model.features(t, compressors) for t in texts])
    model.means, model.scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - model.means) / model.scales], axis=1)
    y = toxic.astype(float)
    for _ in range(50):
        p = model.scores(x)
        slope = z.T @ (p - y) + 0.01 * model.weights
        bend = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(6)
        model.weights = model.weights - np.linalg.solve(bend, slope)
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> tuple[list[bytes], np.ndarray]:
    """Labelled texts outside the held-out rows: a sample by hash of the id, of bounded size, with the labels' own shares."""
    id_ = F.col(f"`{id_col}`")
    usable = labels.select(id_.alias("id"), F.col(f"`{toxic_col}`").alias("toxic")).dropna().where(~held_out("id"))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "toxic").limit(SAMPLE)
    rows = docs.select(id_.alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most SAMPLE rows go to the executors.
    found = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "toxic", "text").limit(SAMPLE).select("text", "toxic").toArrow()
    texts = [(t or "").encode() for t in found["text"].to_pylist()]
    return texts, np.asarray(found["toxic"].to_pylist(), bool) if texts else np.zeros(0, bool)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: likelier toxic) and predicted (1 from FLAGGED on) to all columns of docs.

    Null and empty texts get the score of a text without windows. Without a
    model (no labelled rows) all scores are 0. Columns named score and
    predicted give way. Repeated rows score alike; whole texts are scored.
    """

    def step(values: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        n = len(null)
        if model is None:
            return [pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32))]
        compressors = model.compressors()
        data = values.tobytes()
        scores = model.scores(np.array([Model.features(data[a:b], compressors) for a, b in zip(offsets[:-1], offsets[1:])]))
        return [pa.array(scores), pa.array((scores >= FLAGGED).astype(np.int32))]

    return with_text_columns(docs, text_col, {"score": "double", "predicted": "int"}, step)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, toxic = sample(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, fit(texts, toxic) if len(texts) else None)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
