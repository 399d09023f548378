"""Top-k search, lexical search and conversation repair against brute force, and on odd inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from shopstream.llm import conversations, pivots, queries, ranked

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def mended(rows):
    """The contract read plainly: whole suffixes are kept and compared."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}
    # of each state, the least (cost, edits) to the end and what it leaves
    best = {"": (0, "", []), "a": (0, "", []), "u": (3, "I", ["assistant:"]), "s": (6, "II", ["user:", "assistant:"])}
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for state in ("", "s", "u", "a"):
            options = [(best[state][0] + 4, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for to in "sua":
                    if (state, to) in after:
                        cost, edits, kept = best[to]
                        if role[:1] == to:
                            options.append((cost + more, "K" + edits, [f"{role}:{text}", *kept]))
                        if to != "s":
                            options.append((cost + more + 3, "R" + edits, [f"{full[to]}:{text}", *kept]))
            new[state] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for state in ("u", "a", "", "s"):
                to = "a" if state == "u" else "u"
                new[state] = min(new[state], (new[to][0] + 3, "I" + new[to][1], [f"{full[to]}:", *new[to][2]]), key=lambda o: o[:2])
        best = new
    cost, audit, kept = best[""]
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


NAMES = "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def held(found):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in found.collect()}


@there
def test_repair_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    broken = damaged(rows)
    want = {c: mended([r for r in broken if r[0] == c]) for c in {r[0] for r in rows}}
    assert held(queries.op12_repair(spark, SF)) == want


def test_repair_of_random_and_odd_conversations(spark):
    pick = random.Random(3)
    words = ["Yes.", "no", "Why?", "", " \t", "Ok!", "Yes. ", None, "x" * 50_000 + "."]
    rows = [(c, pick.choice([None, *range(12)]), pick.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), pick.choice(words)) for c in [None, *range(9)] for _ in range(pick.randrange(1, 40))]
    rows += [(77, t // 2, "user", "again and again.") for t in range(60)]
    schema = "conv_id long, turn long, role string, text string"
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], schema + ", key string, n int")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: mended([r for r in plain if r[0] == c]) for c in {r[0] for r in rows}}
    assert held(conversations.repair(given, least_rows=3, most_bytes=60_000)) == want
    assert held(conversations.repair(given)) == want
    dropped = spark.createDataFrame([(5, 0, "user", "Hi."), (6, 1, "user", "Hi.")], schema)
    nothing = held(conversations.repair(dropped.where("conv_id = 5"), dropped))
    assert nothing[6] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and nothing[5][6] == "KI"
    assert conversations.repair(dropped.limit(0)).count() == 0 and conversations.damage(dropped.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Well. Yes!") for c in range(40) for t in (None, 0, 1, 2)] + [(None, 3, None, None)]
    found = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(found) == order(damaged(rows))


def best_products(rows, asked, k):
    out = set()
    for q, x in asked:
        scores = {}
        for v, y in rows:
            if v != q and len(x) == len(y):
                s = int(sum(int(a) * int(b) for a, b in zip(x, y)))
                scores[v] = max(s, scores.get(v, s))
        top = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]
        out |= {(q, i + 1, v, s) for i, (v, s) in enumerate(top)}
    return out


def test_products_equal_brute_force(spark):
    random_ = np.random.default_rng(5)
    centres = random_.standard_normal((6, 12)) * 3
    rows = [(i, (centres[i % 6] + random_.standard_normal(12) * (0.1 if i % 3 else 4)).tolist()) for i in range(900)]
    rows += [(1_000 + i, rows[7][1]) for i in range(300)]  # one vector, many ids: ties by id
    rows += [(2_000 + i, [1e3] + [0.0] * 11) for i in range(3)]  # far longer than the rest
    rows += [(3_000, [1.0, 2.0]), (3_050, [0.5, -1.0]), (3_051, [0.25, 0.25])]
    odd = [(3_100, None), (3_150, []), (3_200, [1.0] * 11 + [None]), (3_250, [float("nan")] * 12), (3_300, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (3_350, [1e30] + [0.0] * 11)]
    given = spark.createDataFrame([(v, x, 1, 2) for v, x in [*rows, *rows[:40], *odd]], "vec_id long, embedding array<double>, part int, dims int")
    whole = [(v, np.floor(np.array(x) * 256)) for v, x in rows]
    found = {tuple(r) for r in pivots.top_products(given, 5, every=50, block=64, q_block=4).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == best_products(whole, [r for r in whole if r[0] % 50 == 0], 5)
    assert pivots.top_products(given.limit(0), 5).count() == 0
    assert pivots.top_products(given.where("vec_id = 0"), 5).count() == 0  # a query without candidates
    own = given.where("vec_id between 101 and 103").withColumn("vec_id", given.vec_id + 10_000)
    asked = [(v + 10_000, x) for v, x in whole if 101 <= v <= 103]
    found = {tuple(r) for r in pivots.top_products(given, 3, queries=own).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == best_products(whole, asked, 3)


def test_far_annuli_are_not_visited(spark, monkeypatch):
    random_ = np.random.default_rng(6)
    centres = random_.standard_normal((8, 16)) * 20
    centres *= 80 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 8] + random_.standard_normal(16)).tolist()) for i in range(4_000)]
    sent = []
    visits = pivots._visits

    def count(pairs, *rest):
        sent.append(pairs.count())
        return visits(pairs, *rest)

    monkeypatch.setattr(pivots, "_visits", count)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pivots.top_products(given, 5, every=50, block=32, q_block=8).count()
    blocks = 4_000 / 32 * 80 / 8
    assert sum(sent) < blocks / 2


def best_documents(docs, items, k=10):
    import math

    terms = lambda text: [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    own = [(d, terms(text)) for d, text in docs]
    n, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in own) + 1)))
    out = set()
    for item in {i for i, _ in items if i is not None}:
        asked = [t for text in {x for i, x in items if i == item} for t in terms(text)]
        weights = {t: weight(t) for t in set(asked)}
        scores = {}
        for d, w in own:
            if d is not None and w:
                m = 25 + 75 * len(w) * n // total
                s = sum(weights[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
                scores[d] = max(s, scores.get(d, s))
        top = sorted([(d, s) for d, s in scores.items() if s > 0], key=lambda p: (-p[1], p[0]))[:k]
        out |= {(item, r + 1, d, s) for r, (d, s) in enumerate(top)}
    return out


def test_lexical_search_equals_brute_force(spark):
    pick = random.Random(8)
    vocabulary = ["the", "The", "a", "über", "naïve", "x1", "42", "日本", "rare", "İt", "K"] + [f"w{i}" for i in range(30)]
    text = lambda n: pick.choice(["", " ", "-"]) + "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "\x00", "_"]) for _ in range(n))
    docs = [(i, text(pick.randrange(40))) for i in range(150)] + [(500 + i, "the rare 日本 W3") for i in range(30)]
    docs += [(700, None), (701, ""), (702, "--- \n"), (None, "rare rare"), (0, "rare x1 42"), (703, "w1 " * 60_000)]
    items = [(i, text(12)) for i in range(20)] + [(3, "rare w1 w1 w2"), (3, "rare w1 w1 w2"), (30, None), (31, ""), (32, "nowhere"), (None, "rare")]
    given = spark.createDataFrame([(*d, "y", 1) for d in docs], "doc_id long, text string, item string, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, term string")
    want = best_documents(docs, items)
    rows = lambda found: {tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()}
    assert rows(ranked.search(given, asked)) == want
    assert rows(ranked.search(given, asked, block_bytes=100)) == want
    assert rows(ranked.search(given.limit(0), asked)) == set() == rows(ranked.search(given, asked.limit(0)))


def test_large_sums_are_exact():
    scorer = ranked.Scorer(ranked.Automaton(["a", "b"]), [30_000, 7], [[(0, 10**6)], [(0, 1)]], 1, 10, 100)
    assert not scorer.exact
    counted = [(2, np.array([0, 1]), np.array([10**6, 1]))]
    m = 25 + 75 * 2 * 10 // 100
    assert scorer.scores(counted)[0, 0] == 10**6 * 30_000 * (10**15 // (10**9 + 8 * m)) + 7 * (10**9 // (1000 + 8 * m))
