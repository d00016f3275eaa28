"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a Spark aggregation over a bounded sample of labelled rows; the matrix of log-probabilities
(``BINS`` rows, one column per language) is broadcast. The texts of an Arrow batch are scored together: the bins of their
n-grams stand one after another, and the matrix's values for them are added up text by text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, in_batches

ORDERS = (1, 2, 3)
BINS = 1 << 15
#: About how many labelled rows the model is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: The score reported, not the choice of the language, counts a text's n-grams as at most so many independent ones, or every score would be 0 or 1.
EVIDENCE = 60.0
#: Code points that are hashed at a time.
PIECE = 1 << 19


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(text numbers, starts, bins for each order) of the n-grams of the lower-cased texts, in parts of about PIECE code points;
    ASCII other than letters counts as a space.

    Stretches of texts follow each other: which text each is of and where it starts. There is a bin for each code point,
    or BINS where no n-gram of the stretch starts. A stretch that goes on with a text starts with the last code
    points of the one before, so that no n-gram is lost or counted twice at a border; none reaches into the next text.
    """
    longest = max(ORDERS)
    held, size = [], 0
    for i, t in enumerate(texts):
        points = np.frombuffer(t.lower().encode("utf-32-le", "replace"), dtype="<u4")
        for at in range(0, len(points), PIECE):
            lead = min(at, longest - 1)
            held.append((i, lead, points[at - lead : at + PIECE]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    ends = np.cumsum([len(p) for _, _, p in parts])
    starts = np.r_[0, ends[:-1]]
    points = np.concatenate([p for _, _, p in parts])
    points = np.where((points >= 97) & (points <= 122) | (points >= 0xAA), points, np.uint32(32))
    bins = []
    for n in ORDERS:
        out = np.full(len(points), BINS, dtype=np.int64)
        whole = max(0, len(points) - n + 1)
        h = np.full(whole, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n if whole else 0):
            h = (h ^ points[i : whole + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out[:whole] = h & np.uint32(BINS - 1)
        for k in range(1, n):  # what would reach into the next stretch
            out[np.maximum(ends - k, starts)[ends - k >= starts]] = BINS
        for (_, lead, _), start in zip(parts, starts.tolist(), strict=True):
            if lead >= n:  # what the stretch before had
                out[start : start + lead - n + 1] = BINS
        bins.append(out)
    return np.array([i for i, _, _ in parts]), starts, bins


def ngram_counts(texts: list[str]) -> np.ndarray:
    """How often each bin occurs in the texts."""
    total = np.zeros(BINS, dtype=np.int64)
    for _, _, orders in grams(texts):
        for bins in orders:
            total += np.bincount(bins, minlength=BINS + 1)[:BINS]
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BINS x languages, log-probabilities
    prior: np.ndarray

    def columns(self) -> np.ndarray:
        """The weights of one language after the other, with a zero for what is no n-gram."""
        if not hasattr(self, "_columns"):
            self._columns = np.ascontiguousarray(np.vstack([self.weights, np.zeros((1, len(self.languages)))]).T)
        return self._columns

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood of each text in each language, and its number of n-grams."""
        logs, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for owners, starts, orders in grams(texts):
            for bins in orders:
                np.add.at(n, owners, np.add.reduceat((bins < BINS).astype(np.int64), starts))
                for k, column in enumerate(self.columns()):
                    np.add.at(logs[:, k], owners, np.add.reduceat(column[bins], starts))
        return logs, n

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its tempered probability; und and 0 for texts that are null or have no letter."""
        asked = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        found, scores = ["und"] * len(texts), [0.0] * len(texts)
        if asked:
            logs, n = self.sums([texts[i] for i in asked])
            best = (logs + self.prior).argmax(axis=1)
            soft = logs * np.minimum(1.0, EVIDENCE / n)[:, None] + self.prior
            p = np.exp(soft - soft.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for row, i in enumerate(asked):
                found[i], scores[i] = self.languages[best[row]], float(p[row, best[row]])
        return found, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        found, scores = self.predict_all([text])
        return found[0], scores[0]


def fit(docs: DataFrame, label: str | Column = "lang", id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> LanguageModel:
    """Rows with a null label or text are left out; of repeated rows each counts. What reaches the driver is bounded: BINS counts for each language."""
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang") if isinstance(label, str) else label.alias("lang")).filter("lang is not null")
    sample = bounded_sample(sample, "id", rows).filter("text is not null")  # the count needs no texts

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(t)
            for lang, found in texts.items():  # the last place counts documents
                sums[lang] = sums.get(lang, 0) + np.append(ngram_counts(found), len(found))
        for lang, total in sums.items():
            bins = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins), pa.array(total[bins])], names=["lang", "bin", "n"])

    counted = sample.mapInArrow(count, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((BINS + 1, len(languages)))
    for r in counted:
        counts[r["bin"], place[r["lang"]]] = r["n"]
    seen, smooth = counts[BINS], counts[:BINS] + 0.5
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)), np.log((seen + 1) / (seen.sum() + len(languages))) if languages else seen)


def predict(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text", passed: tuple = ()) -> DataFrame:
    """One row per document, repeated ones too: id, the passed columns, lang_pred, score. Passed columns can't have the names of the last two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        found, scores = shared.value.predict_all(texts)
        return {"lang_pred": found, "score": scores}

    chosen = docs.select(id, *passed, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return in_batches(chosen, chosen.columns, run, f"{schema}, lang_pred string, score double", passed=[c for c in chosen.columns if c != "_text"])
