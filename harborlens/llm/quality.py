"""Quality of documents by weak labels: heuristic voters, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import ship_package

#: Words that insult; one of the voters looks for them.
INSULTS = frozenset(
    "clown coward creep degenerate disgusting dumb fool garbage idiot idiotic imbecile jerk liar loser moron moronic parasite pathetic "
    "scum sleazy stupid trash ugly useless vermin worthless".split()
)
STEM = 4
_UPPER, _LOWER, _DIGITS = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{Ll}\p{Lo}\p{M}]+"), regex.compile(r"[0-9]+")
_RUN = regex.compile(r"([^\p{L}\p{N}\s])\1+")
_CAPITALS, _SIGNS = regex.compile(r"(?!Aa)A+a?[^a-z]*"), regex.compile(r".*[^\p{L}\p{N}\s]{2}", regex.S)
_SAYING, _PLAIN = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"(A|Aa|a)[.,;:!?]?")
_STOPS, _USUAL = frozenset(".,;:!?"), ".,;:!?()\"'*#%&$|"
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def shape_of(word: str) -> str:
    """A word's shape: runs of capitals A, of other letters a, of digits 0; other signs as they are, runs of one sign as two."""
    core, end = (word[:-1], word[-1]) if word[-1:] in _STOPS else (word, "")
    if core.isalpha():  # the usual words need no patterns
        if core.islower():
            return "a" + end
        if core[0].isupper() and core[1:].islower():
            return "Aa" + end
    return _RUN.sub(r"\1\1", _DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))


def terms_of(word: str) -> tuple[str, ...]:
    """What a lexicon may hold of a word: the bare word in lower case, and its first letters with a hyphen."""
    bare = word.lower().strip(_USUAL)
    if not bare.isalpha():
        bare = _EDGES.sub("", bare)
    return (bare, bare[:STEM] + "-") if len(bare) >= STEM else (bare,) if bare else ()


#: What a word may be, as bits.
CAPITALS, SIGNS, BARE, ODD, INSULT, LISTED = 1, 2, 4, 8, 16, 32


class Words:
    """What the voters and the scorer need to know of a word, worked out once for each that a worker meets while it remembers it (the last ``memo`` words, and the ``memo`` before them)."""

    def __init__(self, lexicon: Iterable[str], features: int, weights: Sequence[float] | None = None, memo: int = 300_000) -> None:
        self.lexicon, self.features, self.weights = frozenset(lexicon), features, weights
        self.known, self.older, self.shapes, self.memo = {}, {}, {}, memo

    def _shape(self, shape: str) -> tuple[int, int]:
        """Bits and feature slot of a shape."""
        if (found := self.shapes.get(shape)) is None:
            bits = CAPITALS * (_CAPITALS.fullmatch(shape) is not None) | SIGNS * (_SIGNS.fullmatch(shape) is not None)
            bits |= BARE * (_SAYING.search(shape) is None) | ODD * (_PLAIN.fullmatch(shape) is None)
            if len(self.shapes) >= self.memo:
                self.shapes.clear()
            found = self.shapes[shape] = bits, self.slot("=" + shape)
        return found

    def learn(self, raw: bytes) -> tuple:
        """(bits, feature slots) of a word in UTF-8; with weights, the sum of the slots' weights in place of the slots."""
        if len(self.known) >= self.memo:
            self.known, self.older = {}, self.known
        if (found := self.older.get(raw)) is not None:
            self.known[raw] = found
            return found
        word = raw.decode()
        terms = terms_of(word)
        bits, slot = self._shape(shape_of(word))
        slots = [slot]
        if terms:
            slots.append(self.slot(terms[-1]))
            if terms[0] in INSULTS:
                bits |= INSULT
                slots.append(self.slot("#insult"))
            if not self.lexicon.isdisjoint(terms):
                bits |= LISTED
                slots.append(self.slot("#listed"))
        found = self.known[raw] = bits, self.value(slots)
        return found

    def slot(self, mark: str) -> int:
        return xxhash.xxh64_intdigest(mark) % self.features

    def value(self, slots: list[int]) -> list[int] | float:
        return slots if self.weights is None else sum([self.weights[s] for s in slots])


@dataclass
class Facts:
    """What the voters see of a text: its words, and shares of them."""

    n: int
    capitals: float
    signs: float
    bare: float
    plain: float
    repeats: float
    distinct: float
    insults: int
    listed: int
    has_lexicon: bool


def _facts(text: str, words: Words) -> tuple[Facts, list[tuple]]:
    """The facts of a text, and (times, slots or weight) of each of its words."""
    said = text.encode().split()  # at ASCII white space only
    n, some = len(said), max(len(said), 1)
    counted, sums, learn = [], Counter(), words.learn
    for w, c in Counter(said).items():
        bits, value = words.known.get(w) or learn(w)
        counted.append((c, value))
        if bits:
            sums[bits] += c
    again = sum(map(eq, said, said[1:]))
    counted += [(again, words.value([words.slot("#again")])), (n - len(counted), words.value([words.slot("#seen")]))]
    of = lambda bit: sum(c for bits, c in sums.items() if bits & bit)
    return Facts(
        n, of(CAPITALS) / some, of(SIGNS) / some, of(BARE) / some, 1 - of(ODD) / some if n else 0.0, again / some,
        (len(counted) - 2) / some, of(INSULT), of(LISTED), bool(words.lexicon),
    ), counted


def _bad(test: bool) -> int:
    return -1 if test else 0


#: Heuristic voters on two questions, whether a text is well formed and whether it is civil: -1 for bad, 1 for good, 0 for no view.
#: They overlap and err on purpose; EM finds how far each is right. Most look for one kind of junk or
#: abuse: where it is missing they have no view, as a document may be bad in other ways.
VOTERS = {
    "form": {
        "capitals": lambda f: _bad(f.capitals > 0.3),
        "signs": lambda f: _bad(f.signs > 0.2),
        "bare_signs": lambda f: _bad(f.bare > 0.15),
        "odd_words": lambda f: _bad(f.plain < 0.6),
        "repeats": lambda f: _bad(f.repeats > 0.2),
        "monotony": lambda f: _bad(f.distinct < 0.15 and f.n > 50),
        "prose": lambda f: 1 if f.plain > 0.7 and f.repeats < 0.05 and f.distinct > 0.2 else 0,
    },
    "tone": {
        "insults": lambda f: _bad(f.insults >= 2 and f.insults > 0.001 * f.n),
        "insult_share": lambda f: _bad(f.insults > 0.004 * f.n),
        "listed_words": lambda f: _bad(f.listed >= 2 and f.listed > 0.001 * f.n),
        "listed_share": lambda f: _bad(f.listed > 0.004 * f.n),
        "hardly_any": lambda f: 1 if f.listed + f.insults <= 0.001 * f.n else 0,
    },
}


@dataclass
class LabelModel:
    """Share of good documents, and for each voter the probabilities of its votes (-1, 0, 1) on bad and on good ones."""

    good: float
    votes: dict[str, np.ndarray]

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.log(np.array([1 - self.good, self.good]))[None, :].repeat(len(pattern), 0)
        for j, table in enumerate(self.votes.values()):
            logs += np.log(table[:, pattern[:, j] + 1]).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds[:, 1] / odds.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation (Dawid and Skene, 1979) over vote patterns and how often each occurs.

    It starts from the majority of votes and smooths each table with one vote of each
    kind; a voter's say thus depends on its agreement with the others.
    """
    p = np.clip(0.5 + 0.45 * np.sign(np.where((patterns == -1).sum(1) > 0, -1, patterns.sum(1))), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        weight = np.stack((counts * (1 - p), counts * p))
        votes = {}
        for j, name in enumerate(names):
            table = np.stack([[w[patterns[:, j] == v].sum() + 1 for v in (-1, 0, 1)] for w in weight])
            votes[name] = table / table.sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip(weight[1].sum() / max(weight.sum(), 1), 0.01, 0.99)), votes)
        before, p = p, model.posterior(patterns)
        if np.abs(p - before).max() < 1e-6:
            break
    return model


def fit_scorer(row: np.ndarray, slot: np.ndarray, share: np.ndarray, target: np.ndarray, features: int, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3, support: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft targets, by Adam steps over all rows on features scaled to their usual share.

    Features of fewer than ``support`` rows have no weight.

    Entry k says that ``share[k]`` of the words of row ``row[k]`` fall into ``slot[k]``.
    """
    n = len(target)
    often = np.bincount(slot, minlength=features) >= min(support, n // 20)
    row, slot, share = row[often[slot]], slot[often[slot]], share[often[slot]]
    scale = (np.bincount(slot, share, features) + 1e-9) / (np.bincount(slot, minlength=features) + 1e-9)
    x = share / scale[slot]
    w, bias = np.zeros(features), 0.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for k in range(1, rounds + 1):
        off = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[slot], n) + bias, -30, 30))) - target
        g = np.append(np.bincount(slot, x * off[row], features) / n + decay * w, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-5)
        w, bias = w - step[:-1], bias - step[-1]
    return w / scale, bias


def _tells(held, elsewhere, n_bad: int, n_good: int, least: int = 3, ratio: float = 20.0):  # noqa: ANN001, ANN202
    """Whether terms, held by so many bad texts and by so many others, tell these apart; numbers or arrays of them."""
    return (held >= least) & (held / max(1, n_bad) >= ratio * (elsewhere / max(1, n_good)))


def telling_terms(terms: pa.ListArray, bad: np.ndarray) -> list[set[str]]:
    """Of each row's distinct terms those from which ``fit_lexicon`` chooses. Terms are counted by their numbers; no others become Python objects."""
    words = terms.flatten().dictionary_encode()
    at, row = words.indices.to_numpy(), np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(terms.offsets.to_numpy()))
    held, elsewhere = (np.bincount(at[side[row]], minlength=len(words.dictionary)) for side in (bad, ~bad))
    kept = _tells(held, elsewhere, int(bad.sum()), int((~bad).sum()))[at]
    found = [set() for _ in range(len(terms))]
    for r, t in zip(row[kept].tolist(), words.dictionary.take(pa.array(at[kept])).to_pylist(), strict=True):
        found[r].add(t)
    return found


def fit_lexicon(terms: list[set[str]], bad: list[bool], least: int = 3, ratio: float = 20.0) -> list[str]:
    """Terms that explain the bad texts: greedily, the term that most of the texts not yet explained hold.

    A term counts only if bad texts hold it at least ``ratio`` times as often as others, and it
    must explain ``least`` texts by itself; what is only frequent in copies of one text thus stays out.
    """
    held, elsewhere = Counter(), Counter()
    for t, b in zip(terms, bad, strict=True):
        (held if b else elsewhere).update(t)
    telling = {t for t, c in held.items() if _tells(c, elsewhere[t], sum(bad), len(bad) - sum(bad), least, ratio)}
    rest, found = [t & telling for t, b in zip(terms, bad, strict=True) if b], []
    while rest:
        counts = Counter(x for t in rest for x in t)
        best = max(counts, key=lambda x: (counts[x], len(x), x), default=None)
        if best is None or counts[best] < least:
            break
        found.append(best)
        rest = [t for t in rest if best not in t]
    return found


@dataclass
class QualityModel:
    """A label model for each question, and the scorer's weights; ``score`` applies them row by row, without a shuffle."""

    labels: dict[str, LabelModel]
    weights: np.ndarray | None
    bias: float
    lexicon: list[str] = field(default_factory=list)

    def judge(self, texts: Iterable[str | None], words: Words) -> Iterator[tuple[int, float, float]]:
        """(words, posterior, score) of each text: the label models' and the scorer's probabilities of good (to all questions)."""
        questions = [
            (math.log(m.good / (1 - m.good)), [(VOTERS[q][name], np.log(t[1] / t[0]).tolist()) for name, t in m.votes.items()])
            for q, m in self.labels.items()
        ]
        for t in texts:
            facts, counted = _facts(t or "", words)
            posterior = 1.0
            for start, voters in questions:
                posterior *= _logistic(start + sum([table[vote(facts) + 1] for vote, table in voters]))
            if not facts.n:
                score = 0.0
            elif self.weights is None:
                score = posterior
            else:
                score = _logistic(sum([c * w for c, w in counted]) / facts.n + self.bias)
            yield facts.n, posterior, score

    def words(self) -> Words:
        return Words(self.lexicon, 1 if self.weights is None else len(self.weights), [0.0] if self.weights is None else self.weights.tolist())

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
        """(id, n_words, posterior, score, kept) of each row: kept where neither the scorer nor the label models find good less likely than ``threshold``.

        Texts without words (null ones too) hold nothing to judge: their score is 0 and they are not kept.
        """
        model, name = self, uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _remembered(name, model)
            for b in _pieces(batches):
                n, posterior, score = zip(*model.judge((t.as_py() for t in b.column(1)), words), strict=True)
                kept = [min(p, s) >= threshold for p, s in zip(posterior, score, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(posterior), pa.array(score), pa.array(kept)], names=["id", "n_words", "posterior", "score", "kept"])

        ship_package(docs.sparkSession)
        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(run, f"id {kind}, n_words long, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


#: The words that a Python worker knows under the model it used last.
_KNOWN: dict[str, Words] = {}


def _remembered(name: str, model: QualityModel) -> Words:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = model.words()
    return _KNOWN[name]


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _share_of(row_hash: Column, part: float) -> Column:
    """Whether a row belongs to a share of all rows, by a hash of it."""
    return F.shiftrightunsigned(row_hash, 11) <= int(min(1.0, part) * (1 << 53))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, labelled: int) -> list[str]:
    """The lexicon of about ``labelled`` rows that ``labels`` marks in ``toxic_col`` as toxic (1) or not (0)."""
    n = labels.count()
    marked = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isin(0, 1)).select(F.col(id_col).alias("_marked"), F.col(toxic_col).alias("_toxic"))
    marked = marked.where(_share_of(F.xxhash64("_marked"), labelled / max(n, 1))).dropDuplicates(["_marked"]).limit(2 * labelled)
    texts = docs.join(F.broadcast(marked), F.col(id_col) == F.col("_marked")).select(F.col(text_col).alias("text"), "_toxic").limit(2 * labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            terms = [sorted({x for w in set((t.as_py() or "").encode().split()) for x in terms_of(w.decode())}) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), b.column(1).cast(pa.int32())], names=["terms", "toxic"])

    ship_package(docs.sparkSession)
    found = texts.mapInArrow(run, "terms array<string>, toxic int").toArrow()
    bad = found["toxic"].to_numpy() == 1
    return fit_lexicon(telling_terms(found["terms"].combine_chunks(), bad), bad.tolist())


def fit_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None, toxic_col: str = "toxic",
    features: int = 1 << 16, sample: int = 4_000, labelled: int = 4_000,
) -> QualityModel:
    """Fits label model and scorer on about ``sample`` rows, chosen by a hash of id and text among all rows, never more than twice as many.

    EM finds the voters' accuracies from their votes on these rows. The scorer is a logistic
    regression on hashed words, first letters of words and word shapes, with the posteriors
    as its targets. What comes to the driver is bounded by ``sample`` texts' distinct words.
    Scoring covers all rows. Without rows of both kinds there is no scorer, and the
    posterior itself is the score. Rows are judged by their text alone.

    ``labels`` (the same id column, ``toxic_col`` 0 or 1) gives two of the voters a lexicon of words and first
    letters, learned from about ``labelled`` of its rows (see ``fit_lexicon``); without it these voters have no view.
    """
    lexicon = [] if labels is None else learn_lexicon(docs, labels, id_col, text_col, toxic_col, labelled)
    unknown = {q: LabelModel(0.5, {n: np.full((2, 3), 1 / 3) for n in names}) for q, names in VOTERS.items()}
    nothing = QualityModel(unknown, None, 0.0, lexicon)
    n_rows = docs.count()
    if not n_rows:
        return nothing
    chosen = docs.where(_share_of(F.xxhash64(id_col, text_col), sample / n_rows)).select(F.col(text_col).alias("text")).limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon, features)
        for b in _pieces(batches):
            votes, slots, shares = [], [], []
            for t in b.column(0):
                facts, counted = _facts(t.as_py() or "", words)
                if facts.n:
                    met = Counter()
                    for c, own in counted:
                        for s in own:
                            met[s] += c
                    votes.append([vote(facts) for names in VOTERS.values() for vote in names.values()])
                    slots.append(sorted(met))
                    shares.append([met[s] / facts.n for s in slots[-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))],
                names=["votes", "slots", "shares"],
            )

    ship_package(docs.sparkSession)
    found = chosen.mapInArrow(run, "votes array<int>, slots array<int>, shares array<double>").toArrow()
    if not found.num_rows:
        return nothing
    votes, model, posterior, at = np.array(found["votes"].to_pylist(), int), QualityModel({}, None, 0.0, lexicon), 1.0, 0
    for question, names in VOTERS.items():
        patterns, row, counts = np.unique(votes[:, at : at + len(names)], axis=0, return_inverse=True, return_counts=True)
        model.labels[question] = fit_labels(patterns, counts.astype(float), list(names))
        posterior, at = posterior * model.labels[question].posterior(patterns)[row.reshape(-1)], at + len(names)
    if (posterior > 0.5).any() and (posterior < 0.5).any():
        slots = found["slots"].combine_chunks()
        row = np.repeat(np.arange(len(slots)), np.diff(slots.offsets.to_numpy()))
        model.weights, model.bias = fit_scorer(row, slots.flatten().to_numpy(), found["shares"].combine_chunks().flatten().to_numpy(), posterior, features)
    return model


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit: object) -> DataFrame:
    """One row per input row: id, n_words, posterior, score, kept (see ``fit_quality`` and ``QualityModel.score``).

    Null ids and repeated rows are scored like others; other columns are ignored; an empty table gives no rows.
    """
    return fit_quality(docs, id_col, text_col, **fit).score(docs, id_col, text_col, threshold)


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit: object) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; rows are judged where they are read, and nothing is shuffled.

    Null and empty texts go. Rows with null or repeated ids and repeated rows are judged each by its
    text; columns keep their names, whatever these are; an empty table stays empty.
    """
    model, at, schema, name = fit_quality(docs, id_col, text_col, **fit), docs.columns.index(text_col), docs.schema, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _remembered(name, model)
        for b in _pieces(batches):
            kept = [min(p, s) >= threshold for _, p, s in model.judge((t.as_py() for t in b.column(at)), words)]
            yield b.filter(pa.array(kept, pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, schema)
