"""Toxicity by two Kneser-Ney models.

The toxic and the ordinary model spell words: each letter is predicted from the ``ORDER`` - 1 signs before it in
its word, with absolute discounting. What the discount takes from a context goes, in both models, to one shared
Kneser-Ney model of shorter contexts, whose counts (in how many different contexts a letter follows) come from
both classes together. Where an expression is rare the shared part outweighs and favours neither class; where
neither class has a letter after a context, only the two backoff weights differ. A word's evidence is the
difference of its log-probabilities. A text is described by length-normalised differences: over the text, over its
strongest window, and over its strongest words. A logistic curve on labelled texts kept out of the counts
turns these into a score from 0 to 1.

Counting is one grouping in Spark over ``MAX_PER_CLASS`` labelled texts per class at most, a word once per text.
The model holds sequences of ``ORDER`` letters at most and is what tasks receive.
"""

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, query, remainder, table

MAX_PER_CLASS = 4_000       # labelled texts per class that a model is fitted on, those of the lowest hash
LEAST_PER_CLASS = 8         # labels of a class a model can be fitted on
ORDER = 6
DISCOUNT = 1.0
WINDOW = 4
STRONGEST = 3
CALIBRATION = 4             # one labelled text in so many is kept for the curve
MAX_WORDS = 300_000         # words whose evidence a worker keeps
AT_ONCE = 2_000             # words looked up at once
WORD = re.compile(r"[^\W_]+")


def sequences(word: str) -> list[tuple[str, str]]:
    """(context, sign) of each letter and of the end; ^ and $ are the ends of the word."""
    spelt = f"^{word}$"
    return [(spelt[max(0, i - ORDER + 1):i], spelt[i]) for i in range(1, len(spelt))]


class Entries:
    """Values by strings of ``ORDER`` signs at most, in sorted arrays of 32 bytes an entry."""

    def __init__(self, values: dict[str, float]):
        key, first, second = self._coded([*values])
        order = np.argsort(key)
        self.arrays = key[order], first[order], second[order], np.array([*values.values()], dtype=np.float64)[order]

    @staticmethod
    def _coded(texts: list[str]):
        """What entries are ordered by, and the two halves of the string, which tell it exactly (21 bits a sign)."""
        signs = np.array(texts, dtype=f"U{ORDER}").view(np.uint32).reshape(-1, 2, ORDER // 2).astype(np.uint64)
        first, second = (signs << np.array([42, 21, 0], dtype=np.uint64)).sum(2, dtype=np.uint64).T
        return first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F), first, second

    def get(self, texts: list[str], missing: float) -> np.ndarray:
        keys, firsts, seconds, values = self.arrays
        if not len(keys) or not texts:
            return np.full(len(texts), missing)
        key, first, second = self._coded(texts)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((firsts[at] == first) & (seconds[at] == second), values[at], missing)


@dataclass
class Model:
    """log P(sign | toxic) - log P(sign | ordinary) after a context; a context alone: of all signs new to it.

    Every worker holds both, and what dictionaries of strings take stays with a reused worker in later stages, so they are kept as
    ``Entries``.
    """

    seen: dict[str, float] | Entries       # Entries once made
    new: dict[str, float] | Entries
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.seen, self.new = Entries(self.seen), Entries(self.new)

    def __getstate__(self):
        return {"seen": self.seen, "new": self.new, "words": {}}

    def evidence(self, words: list[str]) -> dict[str, float]:
        """Evidence of distinct words, kept for later texts."""
        found = {}
        for i in range(0, len(words), AT_ONCE):
            part = words[i:i + AT_ONCE]
            spelt = [sequences(w) for w in part]
            pairs = [p for x in spelt for p in x]
            known = self.seen.get([c + s for c, s in pairs], math.nan)
            beyond = np.flatnonzero(np.isnan(known))
            known[beyond] = self.new.get([pairs[k][0] for k in beyond.tolist()], 0.0)
            known = iter(known.tolist())
            for word, x in zip(part, spelt):
                total = 0.0
                for _ in x:
                    total += next(known)
                found[word] = total
        if len(self.words) + len(found) > MAX_WORDS:
            self.words.clear()
        if len(found) <= MAX_WORDS:
            self.words.update(found)
        return found

    def features(self, text: str) -> list[float]:
        """Mean evidence of the text, of its strongest window and of its strongest words; 0 without words."""
        words = WORD.findall(text.lower())
        x = [*map(self.words.get, words)]
        if None in x:
            more = self.evidence([*dict.fromkeys(w for w, e in zip(words, x) if e is None)])
            x = [more[w] if e is None else e for w, e in zip(words, x)]
        x = np.array(x)
        if not len(x):
            return [0.0, 0.0, 0.0]
        total = np.concatenate([[0.0], np.cumsum(x)])
        w, top = min(WINDOW, len(x)), min(STRONGEST, len(x))
        return [float(x.mean()), float((total[w:] - total[:-w]).max() / WINDOW),
                float(np.maximum(np.partition(x, len(x) - top)[-top:], 0).sum() / STRONGEST)]


def sequence_counts(texts: DataFrame) -> DataFrame:
    """context, sign, t, o: how often a sign follows in the words of toxic and of ordinary texts (text, toxic)."""
    def run(batches):
        for batch in batches:
            words, counts = (Counter(), Counter()), (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                words[toxic].update(set(WORD.findall(text.as_py().lower())))
            for c in (0, 1):
                for word, n in words[c].items():
                    for pair in sequences(word):
                        counts[c][pair] += n
            keys = list(counts[0] | counts[1])
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                   pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                                  names=["context", "sign", "t", "o"])

    found = texts.select("text", "toxic").mapInArrow(run, "context string, sign string, t bigint, o bigint")
    return found.groupBy("context", "sign").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


class Shared:
    """Interpolated Kneser-Ney over shorter contexts, from the distinct longer sequences of both classes."""

    def __init__(self, pairs):
        self.count, self.total, self.kinds = Counter(), Counter(), Counter()
        level, self.signs = {c + s for c, s in pairs}, {s for _, s in pairs}
        while level:            # each distinct sequence counts once for itself without its first sign
            shorter = Counter(x[1:] for x in level if len(x) > 1)
            for x, n in shorter.items():
                if x not in self.count:
                    self.kinds[x[:-1]] += 1
                self.count[x] += n
                self.total[x[:-1]] += n
            level = set(shorter)
        self.known: dict[str, float] = {}

    def __call__(self, context: str, sign: str) -> float:
        """Probability of the sign after the context without its first sign."""
        key = context[1:] + sign
        p = self.known.get(key)
        if p is None:
            below = context[1:]
            lower = self(below, sign) if below else 1 / (len(self.signs) + 1)
            total = self.total[below]
            p = lower if not total else (max(self.count[key] - 0.75, 0) + 0.75 * self.kinds[below] * lower) / total
            self.known[key] = p
        return p


def fit_counts(texts: DataFrame, discount: float = DISCOUNT) -> Model:
    """Model of labelled texts (text, toxic 0 or 1)."""
    rows = sequence_counts(texts).toPandas()
    pairs = list(zip(rows["context"], rows["sign"]))
    shared = Shared(pairs)
    total, taken = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0.0, 0.0])
    for (context, _), *n in zip(pairs, rows["t"].tolist(), rows["o"].tolist()):
        for c in (0, 1):
            total[context][c] += n[c]
            taken[context][c] += min(n[c], discount)
    weight = {x: [taken[x][c] / n[c] if n[c] else 1.0 for c in (0, 1)] for x, n in total.items()}
    seen = {}
    for (context, sign), *n in zip(pairs, rows["t"].tolist(), rows["o"].tolist()):
        rest = shared(context, sign)
        t, o = (max(n[c] - discount, 0) / max(total[context][c], 1) + weight[context][c] * rest for c in (0, 1))
        seen[context + sign] = math.log(t / o)
    return Model(seen, {x: math.log(t / o) for x, (t, o) in weight.items()})


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (bias first) of a logistic curve that rises with every feature; ridge of 0.1 on scaled features."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([beta[:1], beta[1:] / scale])


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, column: str = "toxic", least: int = LEAST_PER_CLASS):
    """(model, curve) from documents and a table of labels.

    Learned from are rows whose crc32(doc_id as text) mod 3 is not 1 and whose label is 0 or 1 (1, where a doc_id has both).
    Of each class the ``max_per_class`` doc_ids of the lowest hash are used, or as many as the smaller class has, so that
    both models back off alike; their texts, a bounded number of ids, are picked out of the documents. A quarter of each class fits
    the curve, with the classes weighted as in all labelled rows. With fewer than ``least`` labels of a class there is no model: the
    score is the share of toxic labels throughout, and ``drop_toxic`` drops nothing.
    """
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1)).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).cast("int").alias("toxic"))
    ids = materialise(own.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < least:
        return None, np.array([sizes.get(1, 0) / max(1, sum(sizes.values()))])
    most, h = min(max_per_class, *sizes.values()), F.xxhash64(F.lit("sample"), "doc_id")
    few = [ids.where(F.col("toxic") == c).orderBy(h, "doc_id").limit(most) for c in (0, 1)]
    # 2 * max_per_class rows at most; the first of a class is always on the curve's side, the last never
    curve, own_class = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(CALIBRATION)) == 0, Window.partitionBy("toxic")
    place = F.row_number().over(own_class.orderBy(~curve, h, "doc_id"))
    few = F.broadcast(materialise(few[0].unionByName(few[1]).select(
        "doc_id", "toxic", ((curve | (place == 1)) & (place < F.count(F.lit(1)).over(own_class))).alias("curve"))))
    chosen = materialise(documents(docs).join(few, "doc_id").select("text", "toxic", "curve").repartition(
        max(2, most // 500), F.xxhash64("text")))
    model = fit_counts(chosen.where("not curve"))
    seen = features(chosen.where("curve").select("text", "toxic"), model, "toxic int").toPandas()
    y, x = seen["toxic"].to_numpy(dtype=float), seen[["f0", "f1", "f2"]].to_numpy(dtype=float)
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return model, fit_curve(x, y, weight * len(y) / weight.sum())


def features(docs: DataFrame, model: Model, *carry: str, text: str = "text") -> DataFrame:
    """The ``carry`` columns ("name type") and f0, f1, f2 of each row's text (null: empty), which may be one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split(" ", 1)[0] for c in carry]

    def run(batches):
        for batch in batches:
            found = np.array([shared.value.features(t.as_py() or "") for t in batch[text]]).reshape(-1, 3)
            yield pa.record_batch({c: batch[c] for c in names} | {f"f{i}": pa.array(found[:, i]) for i in range(3)})

    return docs.mapInArrow(run, ", ".join([*carry, "f0 double", "f1 double", "f2 double"]))


def score(docs: DataFrame, fitted) -> DataFrame:
    """doc_id and score of every row. A text without words has no evidence either way."""
    model, curve = fitted
    rows = documents(docs)
    if model is None:
        return rows.select("doc_id", F.lit(float(curve[0])).alias("score"))
    z = F.lit(float(curve[0])) + sum(F.col(f"f{i}") * float(curve[i + 1]) for i in range(3))
    return features(rows, model, "doc_id bigint").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def drop_toxic(docs: DataFrame, fitted, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` (any columns) whose text scores below the threshold, unchanged; all rows, where there is no model."""
    model, curve = fitted
    if model is None:
        return docs
    names = docs.columns
    # texts pass through the worker once: what is carried is also what is read
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{[c.lower() for c in names].index('text')}"
    found = features(hidden, model, *[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)], text=text)
    z = F.lit(float(curve[0])) + sum(F.col(f"f{i}") * float(curve[i + 1]) for i in range(3))
    return found.where(1 / (1 + F.exp(-z)) < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


@query("op2_kneser_ney_toxicity")
def op2(spark, base):
    docs = table(spark, base, "documents")
    found = score(docs, fit(docs, table(spark, base, "labels")))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))
