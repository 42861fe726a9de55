"""Toxicity: a factorization machine over hashed terms, which learns weights of terms and of their pairs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import ship_package

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Beginnings of a word that are terms beside the word itself, for words whose endings vary.
BEGINNINGS = (4, 5)


def terms_of(word: str) -> list[str]:
    """Terms of a blank-separated word: the runs of letters and digits in it, in lower case, and their beginnings."""
    out = []
    for w in _WORDS.findall(word.lower()):
        out.append(w)
        out += [w[:k] + "-" for k in BEGINNINGS if len(w) > k]
    return out


class Slots:
    """The hashed terms of words, remembered for the last ``memo`` words that a worker met."""

    def __init__(self, features: int, numbers: np.ndarray | None = None, memo: int = 300_000) -> None:
        self.features, self.numbers, self.known, self.memo = features, numbers, {}, memo

    def _learn(self, word: str) -> tuple[int, ...]:
        found = {xxhash.xxh64_intdigest(t) % self.features for t in terms_of(word)}
        if self.numbers is not None:  # those that the model knows
            found = {int(self.numbers[s]) for s in found} - {-1}
        if len(self.known) >= self.memo:
            self.known.clear()
        self.known[word] = tuple(found)
        return self.known[word]

    def of(self, text: str) -> set[int]:
        """The distinct slots of a text's terms; a term counts once however often it stands there."""
        out, known = set(), self.known
        for w in set(text.split()):
            found = known.get(w)
            out.update(self._learn(w) if found is None else found)
        return out


@dataclass
class FactorizationMachine:
    """Bias, a weight and a vector for each known slot: the log odds of a text are the bias, the weights of its
    slots, and for each pair of its slots the product of their vectors (Rendle, 2010)."""

    features: int
    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def numbers(self) -> np.ndarray:
        at = np.full(self.features, -1, np.int32)
        at[self.slots] = np.arange(len(self.slots))
        return at

    def log_odds(self, own: Iterable[int]) -> float:
        """Of a text with the known slots of these numbers. Pairs cost no more than terms: half of the squared sum less the squares."""
        own = np.fromiter(own, np.int64)
        v = self.factors[own]
        return self.bias + float(self.weights[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))


def _probability(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def fit_machine(
    row: np.ndarray, slot: np.ndarray, toxic: np.ndarray, prior: float, features: int, factors: int = 4,
    rounds: int = 60, rate: float = 0.05, decay: float = 1e-4, support: int = 10, telling: float = 8.0, least: float = 0.05,
) -> FactorizationMachine:
    """Fits the machine to rows whose distinct slots are listed as (row, slot), by Adam steps on the logistic loss; both labels weigh the same.

    Slots of fewer than ``support`` rows (a 20th of the toxic ones if that is less) aren't known. A slot's value is near 1 where its share among toxic
    rows lies ``telling`` standard deviations from its share among all, and falls with the square of that down to ``least``: terms
    that tell little learn slowly and are held back by the decay, but can still take part in pairs. At the
    end the bias is moved to the ``prior`` share of toxic rows, so that scores are probabilities.
    """
    n = len(toxic)
    df = np.bincount(slot, minlength=features)
    slots = np.flatnonzero(df >= max(2, min(support, int(toxic.sum()) // 20)))
    at = np.full(features, -1)
    at[slots] = np.arange(len(slots))
    known = at[slot] >= 0
    row, slot, df, m = row[known], at[slot[known]], df[slots], len(slots)
    share = toxic.mean()
    off = np.abs(np.bincount(slot, toxic[row], m) - df * share) / np.sqrt(df * share * (1 - share))
    scale = np.clip((off / telling) ** 2, least, 1)
    x = scale[slot]
    each = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)) / n
    params = [np.zeros(1), np.zeros(m), np.random.default_rng(7).normal(0, 0.01, (factors, m))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        bias, w, v = params
        z = bias[0] + np.bincount(row, x * w[slot], n)
        own = [vk[slot] * x for vk in v]
        sums = [np.bincount(row, o, n) for o in own]
        for o, a in zip(own, sums, strict=True):
            z += 0.5 * (a * a - np.bincount(row, o * o, n))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * each
        ex = error[row] * x
        slopes = [
            np.array([error.sum()]), np.bincount(slot, ex, m) + decay * w,
            np.array([np.bincount(slot, ex * (a[row] - o), m) for o, a in zip(own, sums, strict=True)]).reshape(v.shape) + decay * v,
        ]
        for p, g, a, b in zip(params, slopes, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    bias, w, v = params
    return FactorizationMachine(features, slots, float(bias[0]) + math.log(prior / (1 - prior)), w * scale, (v * scale).T.copy())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", features: int = 1 << 18, labelled: int = 1_500, **fit: float
) -> FactorizationMachine:
    """The machine of about ``labelled`` rows of each label (0 and 1), never more than twice as many, chosen by a hash of the id.

    An id is toxic if one of its rows in ``labels`` says so; of several texts of an id the greatest counts; null ids and other labels don't.
    Distinct terms of these rows come to the driver, where the machine is fitted. Without rows of both labels
    it knows no slots, and its bias alone says the share of toxic rows (none: as good as never).
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    part = F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53)
    chosen = [marked.where((F.col("_toxic") == k) & (part <= labelled / n)).limit(2 * labelled) for k, n in counts.items()]
    prior = (counts.get(1, 0) + 1e-9) / (sum(counts.values()) + 1)
    nothing = FactorizationMachine(features, np.zeros(0, np.int64), math.log(prior / (1 - prior)), np.zeros(0), np.zeros((0, 1)))
    if len(chosen) < 2:
        return nothing
    some = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 4 * labelled rows
    texts = docs.join(some, F.col(id_col) == F.col("_id")).groupBy("_id").agg(F.max("_toxic").alias("toxic"), F.max(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(features)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(slots.of(t.as_py() or "")) for t in b.column(1)], pa.list_(pa.int32()))], names=["toxic", "slots"])

    ship_package(docs.sparkSession)
    found = texts.select("toxic", "text").mapInArrow(run, "toxic int, slots array<int>").toArrow()
    # The order of rows, which varies between runs, must not matter: sums of doubles depend on it.
    order = sorted(zip(found["toxic"].to_pylist(), found["slots"].to_pylist(), strict=True))
    toxic = np.array([t for t, _ in order], float)
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    row = np.repeat(np.arange(len(order)), [len(s) for _, s in order])
    slot = np.concatenate([np.array(s, np.int64) for _, s in order])
    return fit_machine(row, slot, toxic, prior, features, **fit)


#: What a Python worker has of the machine that it used last.
_READY: dict[str, tuple[Slots, FactorizationMachine]] = {}


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: the machine's probability that its text is toxic. Rows are scored where they are read."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Slots(machine.features, machine.numbers()), machine
        slots, ready = _READY[name]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                scores = [_probability(ready.log_odds(slots.of(t.as_py() or ""))) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, folds: int = 4, held: int = 2, **fit: float
) -> DataFrame:
    """(id, held_out, score, predicted) of each row: the machine learns from rows of ``labels`` that aren't held out, and scores all rows by their text alone.

    Held out are the ids whose CRC-32, as text, modulo ``folds`` is ``held``; a null id counts as empty text. Null and empty texts
    have no terms: the bias alone scores them. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    out = lambda: F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == held
    machine = fit_toxicity(docs, labels.where(~out()), id_col, text_col, label_col, **fit)
    found = score_toxicity(docs, machine, id_col, text_col)
    return found.select(id_col, out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
