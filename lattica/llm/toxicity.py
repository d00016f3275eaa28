"""A toxicity classifier with counterfactual regularisation.

It is fitted on a bounded sample of labelled rows. The features are the presence of words, once or
repeatedly, and of their first 4 to 8 letters; Spark counts how many documents of each class hold a feature, and
the most telling ones are weighed by logistic regression. Counterfactual pairs come from the sample's sentences:
each term that names a group is swapped for every other one of its row, and the square of the change in score is
penalised, so that which group a sentence mentions doesn't move its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, in_batches, materialised

#: Terms that name groups of people, in four languages; a term is swapped for the others of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("schwule", "lesben", "heteros", "bisexuelle", "transpersonen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("gehörlose", "blinde", "behinderte", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("immigrés", "réfugiés", "autochtones", "étrangers"),
    ("sourds", "aveugles", "handicapés", "vieux", "jeunes"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("inmigrantes", "refugiados", "autóctonos", "extranjeros"),
    ("sordos", "ciegos", "discapacitados", "ancianos", "jóvenes"),
)
#: Each term's others, of all its rows.
OTHERS = {term: tuple(dict.fromkeys(t for row in IDENTITIES if term in row for t in row if t != term)) for row in IDENTITIES for term in row}

WORD = re.compile(r"[^\W\d_]+")
BINS = 1 << 20
SENTENCE = re.compile(r"[.!?\n]+")
#: How many features the model has at most, those most telling for the label (or also against it, by a parameter of fit()), and in how
#: many labelled documents one has to occur. The README says what these parameters change on the held-out fold.
FEATURES = 4096
MIN_DOCS = 4
#: About how many labelled rows the model is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 30_000
THRESHOLD = 0.7
#: Words whose features a Python worker remembers, and how long they are at most.
KEPT_WORDS = 100_000
LONGEST = 64


def word_bins(word: str) -> list[int]:
    parts = [f"={word}", *(f"^{word[:n]}" for n in range(4, min(8, len(word)) + 1))]
    return [xxhash.xxh64_intdigest(p.encode(), 7) & (BINS - 1) for p in parts]


class Features:
    """The bins of texts; remembers the bins of short words, up to a bounded number."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen = chosen
        self.words: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        bins = word_bins(word)
        if self.chosen is not None:
            bins = [self.chosen[b] for b in bins if b in self.chosen]
        got = tuple(bins)
        if len(word) <= LONGEST:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known = self.words.get
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            for form in (w,) if n == 1 else (w, f"2{w}"):
                bins = known(form)
                if bins is None:
                    bins = self.of_word(form)
                if bins:
                    out.update(bins)
        return out


def counterfactuals(text: str | None) -> Iterator[tuple[str, str]]:
    """(sentence, sentence with one identity term swapped) for each term of each sentence and each other term of its row. The
    sentence is lower-cased; one without such terms gives none."""
    for sentence in SENTENCE.split((text or "").lower()):
        for m in WORD.finditer(sentence):
            for other in OTHERS.get(m[0], ()):
                yield sentence, sentence[: m.start()] + other + sentence[m.end() :]


@dataclass
class ToxicityModel:
    chosen: dict[int, int] = field(default_factory=dict)  # bin -> index of its weight
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -3.0

    def score(self, indices: set[int]) -> float:
        z = self.bias + float(self.weights[list(indices)].sum()) if indices else self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(bin, pos, neg): in how many labelled documents of each class a feature occurs. Each task adds up its own rows first."""

    def count(batches):
        pos, neg, features = np.zeros(BINS, dtype=np.int32), np.zeros(BINS, dtype=np.int32), Features()
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (pos if y else neg)[np.fromiter(features(t), dtype=np.int64)] += 1
        bins = np.nonzero(pos + neg)[0]
        for at in range(0, len(bins), 1 << 16):
            b = bins[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(pos[b].astype(np.int64)), pa.array(neg[b].astype(np.int64))], names=["bin", "pos", "neg"])

    return labelled.select("text", "toxic").mapInArrow(count, "bin bigint, pos bigint, neg bigint").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, toxic) of a bounded sample of the labels, one row for each id; its ids, at most about ``rows``, are broadcast.

    An id with several labels is toxic if one says so; null labels and ids don't count. Of several documents with one id
    the text that sorts first is taken, null as empty. Only the sample's texts are shuffled.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    few = materialised(bounded_sample(materialised(known, "labels"), "id", rows), "sample")
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(few), "id")
    return texts.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")


def chosen_features(data: DataFrame, toxic: int, clean: int, features: int, min_docs: int, against: bool) -> dict[int, int]:
    """bin -> index of the features with the greatest log ratio of their shares in both classes over its standard error; with against, either way."""
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    z = (F.log(p / (toxic + 1.0)) - F.log(q / (clean + 1.0))) / F.sqrt(1 / p + 1 / q)
    weighed = feature_counts(data).filter(F.col("pos") + F.col("neg") >= min_docs).select("bin", z.alias("z"))
    weighed = weighed if against else weighed.filter("z > 0")
    best = weighed.orderBy(F.abs("z").desc(), "bin").limit(features).collect()
    return {b: i for i, b in enumerate(sorted(r["bin"] for r in best))}


def fit(sample: DataFrame, penalty: float = 1.0, ridge: float = 1e-5, features: int = FEATURES, min_docs: int = MIN_DOCS, against: bool = False) -> ToxicityModel:
    """sample: as labelled_sample() gives it. With one class only, or none, every text scores low.

    What reaches the driver is bounded: the chosen features, of the sample's rows the ones they have among these,
    and by which of these swapped sentences differ, with counts.
    """
    data = materialised(sample.select("id", "text", "toxic"), "labelled")
    n = {r["toxic"]: r["count"] for r in data.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel()
    chosen = chosen_features(data, n[1], n[0], features, min_docs, against)
    found = Features(chosen)

    def rows_of(texts, toxic):
        return {"x": pa.array([sorted(found(t)) for t in texts], pa.list_(pa.int32())), "y": pa.array([int(y > 0) for y in toxic], pa.int32())}

    def changes(texts):
        lost, new = [], []
        for t in texts:
            for here, there in counterfactuals(t):
                a, b = found(here), found(there)
                if a != b:
                    lost.append(sorted(a - b))
                    new.append(sorted(b - a))
        return {"lost": pa.array(lost, pa.list_(pa.int32())), "new": pa.array(new, pa.list_(pa.int32()))}

    got = in_batches(data, ["text", "toxic"], rows_of, "x array<int>, y int").toArrow()
    x, y = (got.column(c).to_pylist() for c in ("x", "y"))
    swaps = in_batches(data, ["text"], changes, "lost array<int>, new array<int>").groupBy("lost", "new").count().collect()
    pairs = [(r["lost"], r["new"], r["count"]) for r in swaps]
    weights, bias = _descend(x, pairs, np.array(y, dtype=float), len(chosen), penalty, ridge)
    return ToxicityModel(chosen, weights, bias)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(v) for v in lists]
    return np.fromiter((i for v in lists for i in v), dtype=np.int64, count=sum(sizes)), np.repeat(np.arange(len(lists)), sizes)


def _descend(x, pairs, y, width: int, penalty: float, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Adam on: weighted log loss + ridge |w|^2 + penalty * mean squared change of the logit by a swap. Classes weigh alike.
    pairs: the features that a swap takes and those it brings, and how often it occurs."""
    cols, rows = _flat(x)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a_cols, a_rows = _flat([p[0] for p in pairs])
    b_cols, b_rows = _flat([p[1] for p in pairs])
    share = np.array([p[2] for p in pairs], dtype=float)
    share /= share.sum() or 1.0
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], minlength=len(y)) + w[width]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(cols, g[rows], minlength=width), g.sum())
        grad[:width] += 2 * ridge * w[:width]
        if pairs:
            change = 2 * penalty * share * (np.bincount(a_rows, w[a_cols], minlength=len(pairs)) - np.bincount(b_rows, w[b_cols], minlength=len(pairs)))
            grad[:width] += np.bincount(a_cols, change[a_rows], minlength=width) - np.bincount(b_cols, change[b_rows], minlength=width)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 - step / (steps + 1))
    return w[:width], float(w[width])


def score(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text", passed: tuple = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, repeated ones too: id, the passed columns, score, predicted. Null and empty texts score like texts
    without any feature. Passed columns can't have the names of the last two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Features] = {}

    def run(texts):
        features = state["features"] = state.get("features") or Features(shared.value.chosen)
        scores = [shared.value.score(features(t)) for t in texts]
        return {"score": scores, "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

    chosen = docs.select(id, *passed, F.col(text).alias("_text"))
    others = [c for c in chosen.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return in_batches(chosen, chosen.columns, run, f"{schema}, score double, predicted int", passed=others)
