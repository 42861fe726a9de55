"""Conversation repair, importance resampling and toxicity: against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash

from harborlens.llm.conversations import COST, audit, costs_through, damage, edits_through, repair, repair_report
from harborlens.llm.importance import importance_weights, resample, run_hashes
from harborlens.llm.toxicity import FactorizationMachine, Slots, fit_machine, fit_toxicity, terms_of, toxicity

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_audit(codes):
    """The least (cost, edits), by taking the least unfinished edits of all from a heap."""
    heap = [(0, "", 0, 0)]
    while heap:
        cost, edits, i, q = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            return cost, edits
        ways = [("I", 3, NEXT[q, x], 0) for x in "ua" if (q, x) in NEXT]
        if i < len(codes):
            ways.append(("D", 4, q, 1))
            if codes[i] != "d":
                more = 3 * codes[i].isupper()
                ways += [("R", 3 + more, NEXT[q, x], 1) for x in "ua" if (q, x) in NEXT]
                ways += [("K", more, NEXT[q, codes[i].lower()], 1)] if (q, codes[i].lower()) in NEXT else []
        for e, c, to, eaten in ways:
            if edits[-3:] + e != "IIII":
                heapq.heappush(heap, (cost + c, edits + e, i + eaten, to))


def test_cheapest_edits():
    for n in range(4):
        for codes in map("".join, product("dsuaoSUAO", repeat=n)):
            cost, edits = brute_audit(codes)
            assert audit(codes) == edits, codes
            assert min(a + b for a, b in zip(costs_through(codes)[:4], (0, 6, 3, 0), strict=True)) == cost
    rng = random.Random(5)
    for _ in range(150):
        codes = "".join(rng.choice("uaudsUAo") for _ in range(rng.randrange(4, 8)))
        assert audit(codes) == brute_audit(codes)[1], codes


def test_long_conversations_compose():
    """Pieces that meet by their costs alone give the edits of the whole."""
    rng = random.Random(6)
    codes = "".join(rng.choice("uauaudsUAo") for _ in range(3_000))
    whole = audit(codes)
    parts = [codes[i : i + 700] for i in range(0, 3_000, 700)]
    after = [[0, 6, 3, 0]]
    for p in parts[:0:-1]:
        costs = costs_through(p)
        after.append([min(costs[4 * q + to] + after[-1][to] for to in range(4)) for q in range(4)])
    out, state = "", 0
    for p, a in zip(parts, after[::-1], strict=True):
        edits, state = edits_through(p, a, state)
        out += "".join(edits)
    assert whole.startswith(out) and set(whole[len(out) :]) <= {"I"}


WHITE = " \t\n\x0b\x0c\r"


def brute_report(rows):
    """Of one conversation's rows (turn, role, text)."""
    signed = lambda t, *seed: xxhash.xxh64_intdigest(t.encode(), *seed)
    as_long = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], as_long(signed(r[2], 42))))
    faults, seen, codes = Counter(), set(), ""
    for _, role, text in rows:
        ended = text.rstrip(WHITE)
        fault = "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        sign = role[:1] if role[:1] and role[:1] in "sua" else "o"
        codes += "d" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
    cost, edits = brute_audit(codes) if len(codes) < 8 else (None, audit(codes))
    said, at, q = [], 0, 0
    for e in edits:
        role, text = ("", "") if e == "I" else rows[at][1:]
        made = "assistant" if q == 2 else "user"
        at += e != "I"
        if e != "D":
            role = role if e == "K" else made
            said.append(f"{role}:{text}")
            q = NEXT[q, role[0]]
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()


SCHEMA = "conv_id long, turn int, role string, text string, _key string, conv string, _id long, fault string"


def test_repair_report(spark):
    rng = random.Random(8)
    said = ["Yes.", "No!", "cut of", "", " \t", None, "Yes.", "é?  \n", "a " * 20_000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(said)) for c in [*range(40), None] for t in rng.sample([*range(9), None], rng.randrange(1, 7))]
    rows += rows[:20]  # repeated rows
    rows += [(900, t, ("assistant", "user")[t % 2], f"turn {t}" + "." * (t % 5 > 0)) for t in range(3_000)]  # one conversation longer than the others together
    rows += [(901, 5, "user", "again.")] * 2_500  # and one of equal rows
    turns = spark.createDataFrame([(*r, "k", "c", 1, "f") for r in rows], SCHEMA)
    originals = spark.createDataFrame([(c,) for c in [*range(41), None, 900, 901]], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(turns, originals).collect()}
    assert got == {r.conv_id: tuple(r)[1:] for r in repair_report(turns, originals, piece_bits=2).collect()}  # pieces of four rows
    assert set(got) == {*range(41), None, 900, 901}
    assert got[40] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c in {r[0] for r in rows}:
        want = brute_report([r[1:4] for r in rows if r[0] == c])
        assert [w for w in want if w is not None] == [g for g, w in zip(got[c], want, strict=True) if w is not None], c
    assert got[901][2] == 2_499 and got[901][6] == "K" + "D" * 2_499 + "I"
    assert repair_report(turns.limit(0), originals).agg({"cost": "sum"}).first()[0] == 0


def test_repaired_rows_follow_the_grammar(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "A."), (1, 1, "assistant", "B."), (2, 0, "system", "S."), (2, 1, "user", "cut"), (3, 0, "user", "")], "conv_id long, turn int, role string, text string")
    got = repair(turns).where("edit <> 'D'").orderBy("conv", "place", "sub").collect()
    said = {c: "".join(r.role[0] for r in got if r.conv == c) for c in (1, 2, 3)}
    assert all(re.fullmatch(r"(s?(ua)+)?", s) for s in said.values()) and said[3] == ""
    assert repair(turns.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        if k:
            want[c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text] += 2 if k == 3 else 1
    assert Counter(tuple(r) for r in damage(turns).collect()) == want


TEXTS = ["a b a b", "The é'x 12a cat-dog", "", None, "word", "α β γ δ " * 30, "one two three four five six seven eight nine ten " * 3, "a b c d e f g h i j k l m n o p q r s t u v", "x" * 5_000]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ring_of_states(n):
    for t in TEXTS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1))
        count, got = run_hashes((t or "").encode(), n)
        assert count == len(words) and Counter(got) == want


def test_importance_resampling(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(TEXTS), "w", 1, 2) for i in range(60)] + [(None, TEXTS[6], "w", 1, 2)] * 2 + [(7, TEXTS[6], "w", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, weight int, score int")
    target = spark.createDataFrame([("one two three",), (None,), ("γ δ",)], "text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    features = lambda t: [zlib.crc32(x.encode()) % 50 for x in (*words(t), *(f"{a} {b}" for a, b in zip(words(t), words(t)[1:], strict=False)))]
    s, t = Counter(b for r in rows for b in features(r[1])), Counter(b for x in ("one two three", "γ δ") for b in features(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)}
    want = []
    for i, x, *_ in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= 20))
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    ranks = Counter((*w[:4], k + 1 if k < 25 * len(fit) // 100 else None) for k, w in enumerate(fit)) + Counter((*w[:4], None) for w in want if not w[4])
    got = resample(docs, target, carry=["_row"], buckets=50)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == ranks
    assert got.where("_row <> 'w'").count() == 0
    assert resample(docs.limit(0), target).count() == 0
    assert importance_weights(docs, target.limit(0), buckets=1 << 17).count() == len(rows)  # four bytes a bucket


def test_pairs_as_sums():
    rng = np.random.default_rng(1)
    m = FactorizationMachine(10, np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    for own in ([], [2], [0, 3, 5], list(range(6))):
        want = 0.3 + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for i in own for j in own if i < j)
        assert abs(m.log_odds(own) - want) < 1e-9


def test_pairs_are_learned():
    """Toxic is an insult with a mention of a group, or neither: no sum of two weights can tell."""
    rng = np.random.default_rng(2)
    n = 600
    insult, group = rng.random(n) < 0.5, rng.random(n) < 0.5
    toxic = (insult == group).astype(float)
    rows = [[0] * int(a) + [1] * int(b) + [2 + k] for a, b, k in zip(insult, group, rng.integers(0, 3, n), strict=True)]
    row, slot = np.repeat(np.arange(n), [len(r) for r in rows]), np.array([s for r in rows for s in r])
    m = fit_machine(row, slot, toxic, 0.5, 16, rounds=400, telling=1.0, least=0.5)
    at = m.numbers()
    right = np.mean([(m.log_odds([at[s] for s in r if at[s] >= 0]) > 0) == (t > 0) for r, t in zip(rows, toxic, strict=True)])
    assert right > 0.95
    m.factors[:] = 0
    assert np.mean([(m.log_odds([at[s] for s in r if at[s] >= 0]) > 0) == (t > 0) for r, t in zip(rows, toxic, strict=True)]) < 0.8


def test_toxicity(spark):
    rng = random.Random(9)
    vocabulary = [a + b + c for a in ("ta", "lo", "mi", "re") for b in ("na", "so", "ku") for c in ("r", "n", "st", "l")]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 80)))
    bad = lambda i: i % 6 == 0
    rows = [(i, prose() + (f" Grobund{rng.choice('aeiou')}! schelt{rng.choice('aeiou')}" if bad(i) else "") + " " + prose(), "x", 0.5) for i in range(600)]
    rows += [(700, None, "x", 0.5), (701, "", "x", 0.5), (None, prose(), "x", 0.5), (5, rows[5][1], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    labels = spark.createDataFrame([(i, int(bad(i))) for i in range(600)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert all(bool(r.predicted) == bad(r.doc_id) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600)
    assert all(r.predicted == 0 for r in got if r.doc_id in (700, 701))
    lies = spark.createDataFrame([(i, int(bad(i)) ^ held(i)) for i in range(600)], "doc_id long, toxic int")  # labels that are held out can't matter
    assert Counter((r.doc_id, r.score) for r in toxicity(docs, lies).collect()) == Counter((r.doc_id, r.score) for r in got)
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    machine = fit_toxicity(docs, labels)
    few = toxicity(docs, labels, labelled=30).count()
    assert few == len(rows) and len(machine.slots) == len(machine.weights) == len(machine.factors)


def test_terms():
    assert terms_of("Idiots!") == ["idiots", "idio-", "idiot-"] and terms_of("--") == [] and terms_of("a1_b") == ["a1", "b"]
    assert Slots(1 << 10).of("a a b") == Slots(1 << 10).of("b a") and COST["K"] == 0
