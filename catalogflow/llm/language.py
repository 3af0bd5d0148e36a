"""Language ID (operator 5) by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram is the product of
its letters' vectors, the first rotated twice and the second once (binding keeps their order); words
are fenced by a blank, which has a vector too. A document bundles (adds) the vectors of its trigrams,
a language those of all its training documents; the language with the largest cosine is predicted.

Learning passes over every training row: each task counts trigrams a language, bundles them and
sends one vector a language, so what reaches the driver is languages x dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, given_back, held_out

DIMENSIONS = 1024
SEED = 11
_RADIX = 1 << 21
#: Trigram vectors that a worker keeps at most (1 kB each).
KEPT = 40_000
#: Trigram vectors that are bundled at once.
AT_ONCE = 2048


@lru_cache(1)
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of a text: its letters in lower case, all else one blank (0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]])
    points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
    if len(points) < 3:
        return np.empty(0, np.int64)
    return (points[:-2] * _RADIX + points[1:-1]) * _RADIX + points[2:]


@lru_cache(8192)
def _letter_vector(point: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


class Vectors:
    """Trigram vectors, made when first needed and kept up to a bound."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.kept = dimensions, {}

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dimensions), np.int8)
        for k, code in enumerate(codes.tolist()):
            v = self.kept.get(code)
            if v is None:
                a, b, c = code // (_RADIX * _RADIX), code // _RADIX % _RADIX, code % _RADIX
                v = np.roll(_letter_vector(a, self.dimensions), 2) * np.roll(_letter_vector(b, self.dimensions), 1) * _letter_vector(c, self.dimensions)
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[code] = v
            out[k] = v
        return out

    def bundle(self, texts: list[np.ndarray]) -> np.ndarray:
        """One vector per array of trigram codes."""
        out = np.zeros((len(texts), self.dimensions), np.float64)
        if not sum(map(len, texts)):
            return out
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        codes, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        for at in range(0, len(codes), AT_ONCE):
            there = (inverse >= at) & (inverse < at + AT_ONCE)
            width = min(AT_ONCE, len(codes) - at)
            counts = np.bincount(rows[there] * width + inverse[there] - at, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ self.of(codes[at : at + width]).astype(np.float32)
        return out


def _grouped(texts: list[str | None], letters: int = 400_000) -> Iterator[list[str]]:
    """Runs of texts of about so many letters together."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(t or "")
        if size >= letters or len(held) >= 128:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # unit length, one row a language


def learn(docs: DataFrame, *, dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles from the text and lang of every row outside the held-out fold; null langs and texts
    teach nothing."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dimensions), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
                for lang in set(langs):
                    for group in _grouped([texts[i] for i in np.flatnonzero(langs == lang)]):
                        codes = np.concatenate([trigrams(t) for t in group])
                        sums[lang] = sums.get(lang, 0) + vectors.bundle([codes])[0]
        if sums:
            names = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.mapInArrow(lambda batches: given_back(run(batches)), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    languages = sorted({r.lang for r in sums})
    found = np.zeros((len(languages), dimensions))
    for r in sums:
        found[languages.index(r.lang), r.k] = r.x
    return Profiles(languages, found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9))


def predict(docs: DataFrame, profiles: Profiles, *, out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` (a name that ``docs`` does not have) of lang_pred and score.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned; else
    the language of the largest cosine (ties: the first by name) and that cosine, at least 0. Long texts
    are bundled whole, some thousand trigrams at a time.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(profiles.vectors.shape[1])
        for series in texts:
            names, scores = [], []
            for group in _grouped(series.tolist()):
                codes = [trigrams(t) for t in group]
                bundled = vectors.bundle(codes)
                norms = np.linalg.norm(bundled, axis=1)
                cosine = bundled @ profiles.vectors.T / np.maximum(norms, 1e-9)[:, None] if profiles.languages else np.zeros((len(group), 0))
                for c, row in zip(codes, cosine, strict=True):
                    known = len(c) > 0 and len(row) > 0
                    best = int(row.argmax()) if known else -1
                    names.append(profiles.languages[best] if known else "und")
                    scores.append(float(min(1.0, max(0.0, row[best]))) if known else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return given_back(run(texts))

    return docs.withColumn(out, of(F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Repeated rows give repeated rows; an empty table gives no rows; a null doc_id is not held out; where no row
    has a lang, all are ``und``.
    """
    slim = docs.select("doc_id", "text", "lang")
    found = predict(slim.select("doc_id", "text"), learn(slim))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def accept(docs: DataFrame, *, least: float = 0.05) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, any others of any name) whose language is known: neither
    ``und`` nor a cosine under ``least``."""
    (name,) = fresh(docs, "language")
    found = predict(docs, learn(docs.select("doc_id", "text", "lang")), out=name)
    return found.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
