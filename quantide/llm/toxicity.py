"""Classifier chains for toxicity: linear models of one category after the other.

Categories are 0/1 columns of a label table, in an order. Each has a logistic model over hashed features of the text:
its words, their beginnings (which catch inflected and compounded forms), and bins of its shape (capitals, marks, word
length). A later model also gets the logits of the earlier ones. In training these are out-of-fold: each labelled
document's logit comes from a model that saw none of its fold, so later models learn from predictions as good as those
that they meet in use. The threshold of each category is the one with the best F1 on its out-of-fold
probabilities among those with a precision of at least LEAST_PRECISION; if there is none, nothing is rejected.

The models are fitted on the driver from at most LABELLED labelled documents, those with the smallest hash of the id;
each holds at most SELECTED features, those that tell most. All documents are then scored in their tasks.

Defined results: a null text is an empty one; a null label is no label for its category, and of repeated labels the
largest counts; without labels of both kinds a category has probability equal to its base rate (0 without any) and
rejects nothing; repeated rows get equal results; an empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED = 6000
SELECTED = 2048
FOLDS = 4
LEAST_DOCUMENTS = 3
BEGINNINGS = (4, 5, 6)
#: Of the documents that a threshold takes, out of fold.
LEAST_PRECISION = 0.9
PENALTY = 2e-4
STEPS = 150
#: Words whose features a worker keeps.
HELD = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def _word_features(word: str) -> tuple[int, ...]:
    own = word.encode()
    return (zlib.crc32(own), *(zlib.crc32(b"%d:" % n + word[:n].encode()) for n in BEGINNINGS if len(word) >= n))


def _shape(text: str, words: list[str]) -> list[int]:
    """Features of bins, over the whole text: words in capitals, other marks, the mean length and the number of words."""
    letters, n = sum(map(len, words)), max(len(words), 1)
    capitals = sum(map(str.isupper, words))
    marks = len(text) - letters - text.count(" ") - text.count("\n")
    bins = (10 * capitals // n, min(20 * marks // max(len(text), 1), 9), min(letters // n, 12), min(n.bit_length(), 20))
    return [zlib.crc32(b"shape:%d:%d" % (k, b)) for k, b in enumerate(bins)]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    words = _WORD.findall(text or "")
    found = set(_shape(text or "", words))
    for w in {w.lower() for w in set(words)}:
        found.update(_word_features(w))
    return np.fromiter(found, np.uint32, len(found))


@dataclass
class Model:
    """One link of the chain. keys: selected features, sorted; chain: weights of the earlier categories' logits."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    threshold: float = 2.0

    def logit(self, found: np.ndarray, before: list[float]) -> float:
        total = self.bias + float(np.dot(self.chain, before)) if len(self.chain) else self.bias
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            total += float(self.weights[at[self.keys[at] == found]].sum())
        return total


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Sample:
    """Labelled documents as a sparse 0/1 matrix: a column for each feature that enough of them have."""

    def __init__(self, docs: list[np.ndarray]):
        self.size = len(docs)
        every = np.concatenate([*docs, np.zeros(0, np.uint32)])
        ordered = np.sort(every)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        often = np.diff(np.append(first, len(ordered))) >= LEAST_DOCUMENTS
        self.keys = ordered[first[often]]
        del ordered
        # As small as can be: this is the driver.
        columns, rows = [], []
        for k, d in enumerate(docs):
            at = np.minimum(np.searchsorted(self.keys, d), max(len(self.keys) - 1, 0))
            columns.append(at[self.keys[at] == d].astype(np.int32) if len(self.keys) else np.zeros(0, np.int32))
            rows.append(np.full(len(columns[-1]), k, np.int32))
        self.column = np.concatenate([*columns, np.zeros(0, np.int32)])
        self.row = np.concatenate([*rows, np.zeros(0, np.int32)])

    def fit(self, use: np.ndarray, y: np.ndarray, before: np.ndarray) -> tuple[Model, np.ndarray]:
        """A logistic model of y (by document) over the documents in `use` and the logits before, and its logits of all
        documents."""
        n, rate = int(use.sum()), float(y[use].mean()) if use.any() else 0.0
        base = float(np.clip(rate, 1e-6, 1 - 1e-6))
        bias = math.log(base / (1 - base))
        links = before.shape[1]
        if not 0 < rate < 1:
            return Model(bias, np.zeros(0, np.uint32), np.zeros(0), np.zeros(links)), np.full(self.size, bias)
        mine = use[self.row]
        row, col = self.row[mine], self.column[mine]
        count = np.bincount(col, minlength=len(self.keys))
        hits = np.bincount(col, y[row], len(self.keys))
        told = np.abs(hits - count * rate) / np.sqrt(count * rate * (1 - rate) + 1.0)
        told[count < LEAST_DOCUMENTS] = 0
        best = np.sort(np.argsort(-told, kind="stable")[:SELECTED])
        best = best[told[best] > 0]
        k = len(best)
        place = np.full(len(self.keys), -1, np.int32)
        place[best] = np.arange(k)
        keep = place[col] >= 0
        row, col = row[keep], place[col[keep]]
        w, m, v = np.zeros(k + links + 1), np.zeros(k + links + 1), np.zeros(k + links + 1)
        w[-1] = bias
        # Positives weigh more where they are rare, up to a factor.
        weight = np.where(use, np.where(y > 0, min(math.sqrt((1 - rate) / rate), 4.0), 1.0), 0.0)
        weight /= weight.sum()
        y = np.where(use, y, 0.0)
        for step in range(1, STEPS + 1):
            z = w[-1] + np.bincount(row, w[col], self.size) + before @ w[k : k + links]
            error = (_sigmoid(z) - y) * weight
            grad = np.concatenate([np.bincount(col, error[row], k), before.T @ error, [error.sum()]])
            grad[:k] += PENALTY * w[:k]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        column = place[self.column]
        met = column >= 0
        logits = w[-1] + np.bincount(self.row[met], w[column[met]], self.size) + before @ w[k : k + links]
        return Model(float(w[-1]), self.keys[best], w[:k], w[k : k + links]), logits


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 among those with the least precision, midway to the next lower logit; above 1 if there
    is none."""
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hit / (taken + y.sum())
    f1[hit < LEAST_PRECISION * taken] = 0
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # no cut between equal probabilities
    k = int(np.argmax(f1))
    if f1[k] == 0:
        return 2.0
    low = np.clip([p[order[k]], p[order[k + 1]] if k + 1 < len(y) else 0.0], 1e-9, 1 - 1e-9)
    return float(_sigmoid(np.log(low / (1 - low)).mean()))


def train_chain(docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> tuple[list[Model], np.ndarray]:
    """The chain, and the out-of-fold probabilities; labels are documents x categories with NaN for none."""
    sample = Sample(docs)
    logits = np.zeros(labels.shape)
    chain = []
    for k in range(labels.shape[1]):
        y, known, before = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k]), logits[:, :k].copy()
        for fold in range(FOLDS):
            _, found = sample.fit(known & (folds != fold), y, before)
            logits[folds == fold, k] = found[folds == fold]
        model, _ = sample.fit(known, y, before)
        model.threshold = best_threshold(_sigmoid(logits[known, k]), y[known])
        chain.append(model)
    return chain, _sigmoid(logits)


def fit_labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED) -> list[Model]:
    """A chain from a label table with doc_id. categories: name -> SQL over the label table that is 1, 0 or null."""
    of = [F.max(F.expr(sql).cast("double")).alias(f"y{k}") for k, sql in enumerate(categories.values())]
    sample = labels.filter("doc_id is not null").groupBy("doc_id").agg(*of)
    # `limit` labels at most, and for an id that repeats one text each.
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    made = F.arrow_udf(lambda texts: pa.array([features(t).tobytes() for t in texts.to_pylist()], pa.binary()), "binary")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = source.join(F.broadcast(sample), "doc_id").withColumn("f", made("text")).drop("text")
    rows = joined.groupBy("doc_id").agg(F.min("f").alias("f"), *(F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories)))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = [np.frombuffer(r["f"], np.uint32) for r in rows]
    y = np.array([[np.nan if r[f"y{k}"] is None else r[f"y{k}"] for k in range(len(categories))] for r in rows]).reshape(len(rows), len(categories))
    folds = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in rows], np.int64)
    return train_chain(found, y, folds)[0]


class Scorer:
    """Scores of texts by a chain; keeps for each word which of the chain's features it has."""

    def __init__(self, chain: list[Model]):
        self.chain = chain
        self.wanted = set(np.concatenate([m.keys for m in chain]).tolist()) if chain else set()
        self.held: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        if len(self.held) > HELD:
            self.held.clear()
        words = _WORD.findall(text)
        found = {x for x in _shape(text, words) if x in self.wanted}
        held = self.held
        for w in set(words):
            own = held.get(w)
            if own is None:
                own = held[w] = tuple(x for x in _word_features(w.lower()) if x in self.wanted)
            if own:
                found.update(own)
        row = np.fromiter(found, np.uint32, len(found))
        logits: list[float] = []
        for m in self.chain:
            logits.append(m.logit(row, logits))
        return [float(p) for p in _sigmoid(np.array(logits))] if logits else []


def classify(df: DataFrame, chain: list[Model], names: list[str], text: str = "text", to: str = "toxicity") -> DataFrame:
    """df with a struct: a probability p_<name> and a decision is_<name> for each category."""
    ddl = ",".join([f"p_{n}:double" for n in names] + [f"is_{n}:boolean" for n in names])
    kind = pa.struct([(f"p_{n}", pa.float64()) for n in names] + [(f"is_{n}", pa.bool_()) for n in names])

    def run(texts: pa.Array) -> pa.Array:
        score = Scorer(chain)
        rows = [score(t) for t in texts.to_pylist()]
        return pa.array([{f"p_{n}": p for n, p in zip(names, r)} | {f"is_{n}": p >= m.threshold for n, p, m in zip(names, r, chain)} for r in rows], kind)

    return df.withColumn(to, F.arrow_udf(run, f"struct<{ddl}>")(text))


#: In this order: how a text is written tells something about how rude it is.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def trained(spark, sf_dir: str, docs: DataFrame) -> list[Model]:
    return fit_labelled(docs, common.table(spark, sf_dir, "labels"), CATEGORIES)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, trained(spark, sf_dir, docs), list(CATEGORIES))
    return scored.select("doc_id", "toxicity.p_low_quality", "toxicity.p_toxic", F.col("toxicity.is_toxic").alias("rejected"))


def reject_toxic(docs: DataFrame, chain: list[Model], text: str = "text") -> DataFrame:
    """docs without those that the chain's category "toxic" rejects."""
    mark = common.free_name(docs, "_toxicity")
    return classify(docs, chain, list(CATEGORIES), text, mark).filter(~F.col(f"{mark}.is_toxic")).select(*docs.columns)
