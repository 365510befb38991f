"""Hard negatives, source mixing and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import conversations, hard_negatives
from gaugeline.llm.hard_negatives import hard_negatives as mine
from gaugeline.llm.mixing import mix_sources
from gaugeline.llm.queries import QUERIES, damaged

# ---- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, rank int, v string, slot int, ag int"


def brute_negatives(rows, every=10, k=5, low=80, high=100):
    one = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key, own = (i, len(v)), (label, [math.floor(256 * x) for x in v])
        one[key] = min(one.get(key, own), own)
    out = set()
    for (a, n), (label, v) in one.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other) for (b, m), (other, w) in one.items() if m == n and b != a]
        for p, i, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fits = sorted(x[:2] for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:k]
            out |= {(a, i, r + 1, b, -p, -s) for r, (s, b) in enumerate(fits)}
    return out


def vectors(seed, n=160, dims=4, step=8):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-step, 3 * step) / step for _ in range(dims)], rng.choice((0, 0, 0, 1, 2))) for i in range(n)]
    rows += [(200, rows[10][1], 0), (210, rows[10][1], 1), (220, [0.0] * dims, 0), (221, [0.0] * dims, 1)]
    rows += [(10, rows[10][1], rows[10][2]), (20, rows[3][1], 9)]
    rows += [(300, None, 1), (301, [None] * dims, 1), (302, [float("nan")] * dims, 1), (303, [float("inf")] * dims, 0), (304, rows[1][1], None), (None, rows[1][1], 1)]
    rows += [(400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [1.0, 1.5], 0), (410, [], 1), (411, [], 0)]
    return rows


def found(frame):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = [tuple(r[c] for c in cols) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def with_more(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3, 1) for r in rows], VECTORS)


@pytest.mark.parametrize("seed,low,high", [(1, 80, 100), (2, 50, 90), (3, 80, 120)])
def test_hard_negatives_equal_brute_force(spark, seed, low, high):
    rows = vectors(seed)
    got = found(mine(with_more(spark, rows), every=10, low=low, high=high))
    assert got and got == brute_negatives(rows, low=low, high=high)


def test_hard_negatives_in_small_cells(spark, monkeypatch):
    rows = vectors(4)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 200)
    monkeypatch.setattr(hard_negatives, "ROW_BYTES", 1000)
    monkeypatch.setattr(hard_negatives, "STRIP", 50)
    assert found(mine(with_more(spark, rows), every=10)) == brute_negatives(rows)


def test_hard_negatives_with_large_components(spark):
    rows = [(i, [x * 1e5 for x in v], label) for i, v, label in vectors(5)[:160]]
    assert found(mine(with_more(spark, rows), every=10)) == brute_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    assert found(mine(with_more(spark, []))) == set()
    assert found(mine(with_more(spark, [(0, [1.0], 1)]))) == set()
    assert found(mine(with_more(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]))) == {(0, 1, 1, 2, 65536, 65536)}


def test_positives_search_looks_at_ties_by_id():
    ids = np.arange(50)
    a, c, s = hard_negatives.same_label_best(ids[:1], np.zeros(1), np.ones((1, 2), np.int64), ids, np.zeros(50), np.ones((50, 2), np.int64), 5)
    assert c.tolist() == [1, 2, 3, 4, 5] and set(s.tolist()) == {2}


# ---- mixing

DOCS = "doc_id long, text string, source string, size int, target string, taken int, src string, _key int"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Rounds of sharing until no source is above its limit."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        left = sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and weight[s] * rest > most * sizes[s] * left}
        if not over:
            return {s: most * sizes[s] if s in stopped else (weight[s] * rest / left if left else 0.0) for s in order}
        stopped |= over


def check_mix(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, s, 1, "t", 2, "s", 3) for i, t, s in rows], DOCS)
    got = mix_sources(frame, **how).collect()
    def words(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(i), str(s), words(t)) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets, taken = brute_targets(sizes, **how), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= how.get("most", 3) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(targets[s] - 1 < taken[s] <= targets[s] + 1e-6 for s in sizes)
    # At most one document of a source is cut; the others are taken in whole passes.
    for s in sizes:
        assert sum(r["source"] == s and r["size"] > 0 and r["taken"] % r["size"] > 0 for r in got) <= 1
    again = mix_sources(frame.repartition(3), **how).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k, source in enumerate(["b", "a", "é", "", None, "zz", "c"]):
        for _ in range(rng.choice((1, 2, 40)) if seed else 30):
            rows.append((len(rows), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 1, 5, 60)))), source))
    rows += [(rows[0][0], rows[0][1], rows[0][2])] * 60 + [(None, "x y", "a"), (None, None, "a"), (5, "\t\n ", "empty"), (6, "long " * 20000, "zz")]
    check_mix(spark, rows)


def test_mixing_with_other_weights(spark):
    check_mix(spark, [(i, "w " * (i % 13), f"s{i % 9}") for i in range(200)], weights=(7, 3), most=2)


def test_mixing_without_words_or_rows(spark):
    check_mix(spark, [(1, "", "a"), (2, None, "b")])
    check_mix(spark, [])
    check_mix(spark, [(1, "one two three", "a")])


# ---- conversations

TURNS = "conv_id long, turn long, role string, text string, conv string, repeated string, cost int"
PATTERN = re.compile(r"(s?(ua)+)?$")


def reference_report(turns):
    """Faults by a loop, repair by trying every script of edits of rising cost."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in turns))
    seen, blank, duplicate, truncated, illegal, classed = set(), 0, 0, 0, 0, []
    for k, (_, _, role, text) in enumerate(rows):
        core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        is_blank, again = core == "", (role, text) in seen
        seen.add((role, text))
        cut = not is_blank and not again and core[-1] not in ".!?"
        blank, duplicate, truncated = blank + is_blank, duplicate + (again and not is_blank), truncated + cut
        illegal += k > 0 and rows[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        classed.append((role, text, is_blank or again, cut))
    numbers = {t for known, t, _, _ in rows if known}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    best = {("",): (0, "", "")}  # initials so far -> (cost, audit, repaired), all scripts with few insertions
    def grow(states, n=2):
        for _ in range(n):
            for (letters,), (c, a, t) in list(states.items()):
                for role in ("user", "assistant"):
                    keep(states, letters + role[0], (c + 2, a + "I", t + ("\n" if t or letters else "") + role + ":"))
        return states
    def keep(states, letters, new):
        shape = shorten(letters)
        if shape is not None and ((shape,) not in states or new[:2] < states[(shape,)][:2]):
            states[(shape,)] = new
    def shorten(letters):
        if letters in ("", "s"):
            return letters
        body = letters[1:] if letters[0] == "s" else letters
        legal = body == ("ua" * len(body))[: len(body)]
        return ("u" if body[-1] == "u" else "ua") if legal and len(body) else None
    states = grow(best)
    for role, text, gone, cut in classed:
        after = {}
        for (letters,), (c, a, t) in states.items():
            keep(after, letters, (c + 3, a + "D", t))
            if not gone:
                join = "\n" if letters else ""
                if role[:1] in ("s", "u", "a") and (role[0] != "s" or not letters):
                    keep(after, letters + role[0], (c + cut, a + "K", f"{t}{join}{role}:{text}"))
                for name in ("user", "assistant"):
                    keep(after, letters + name[0], (c + 2 + cut, a + "R", f"{t}{join}{name}:{text}"))
        states = grow(after)
    cost, audit, text = min(v for (letters,), v in states.items() if letters in ("", "ua"))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def turns_of(rng, n):
    texts = ["Yes.", "No!", "cut here", "", " \t", "What? \n", None, "tail. x", "é…", "Long " * 30 + "."]
    roles = ["user", "assistant", "system", "tool", "USER", "", None, "usher"]
    plan = [(rng.choice((None, k, k, k, k, max(0, k - 1), k + 2)), rng.choices(roles, (9, 9, 3, 1, 1, 1, 1, 1))[0], rng.choice(texts)) for k in range(n)]
    return plan + rng.choices(plan, k=n // 4) if plan else plan


def reports(frame):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = conversations.repair_report(frame).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in rows}


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(11)
    return {k if k else None: turns_of(rng, rng.choice((1, 2, 3, 5, 8, 13, 60))) for k in range(150)}


def frame_of(spark, talk):
    rows = [(c, *t, "x", "y", 3) for c, turns in talk.items() for t in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS)


def test_reports_equal_brute_force(spark, talk):
    assert reports(frame_of(spark, talk)) == {c: reference_report(t) for c, t in talk.items()}


def test_audits_are_the_first_of_all_cheapest_scripts():
    """Every script of up to seven edits over three rows is tried."""
    for kinds in itertools.product([("user", "a."), ("assistant", "b"), ("system", "c."), ("tool", ""), ("user", "d")], repeat=3):
        best = None
        for n in range(3, 8):
            for script in itertools.product("DIKR", repeat=n):
                if n - script.count("I") != 3:
                    continue
                letters, cost, left = "", 0, iter(kinds)
                for e in script:
                    if e == "I":
                        letters, cost = letters + ("u" if not letters or letters[-1] in "sa" else "a"), cost + 2
                        continue
                    role, text = next(left)
                    if e == "D":
                        cost += 3
                    elif not text:
                        break
                    else:
                        letters += role[0] if e == "K" else ("u" if not letters or letters[-1] in "sa" else "a")
                        cost += (e == "R") * 2 + (text[-1] not in ".!?")
                else:
                    if PATTERN.match(letters):
                        best = min(best or (99, ""), (cost, "".join(script)))
        # Equal rows would be duplicates; the script above knows only kinds.
        if len(set(kinds)) == 3:
            talk = conversations.Conversation(0)
            for k, (role, text) in enumerate(kinds):
                talk.add(k, role, text, False)
            assert talk.audit() == best


def test_rows_of_the_repair(spark, talk):
    rows = conversations.repaired_rows(frame_of(spark, talk)).orderBy("conv_id", "position").collect()
    audits = reports(frame_of(spark, talk))
    for c in talk:
        own = [r for r in rows if r["conv_id"] == c]
        assert "".join(r["edit"] for r in own) == audits[c][6]
        left = [r for r in own if r["edit"] != "D"]
        assert PATTERN.match("".join(r["role"][0] for r in left))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == audits[c][7]


def test_giant_conversation_beyond_the_spool(spark, monkeypatch):
    rng = random.Random(3)
    turns = [(k // 2, rng.choice(("user", "assistant", "system")), rng.choice(("Same.", f"Own {k}.", f"cut {k}", ""))) for k in range(30000)]
    frame = spark.createDataFrame([(1, *t, "x", "y", 3) for t in turns] + [(2, 0, "user", "Hi.", "x", "y", 3)], TURNS)
    got = reports(frame)
    assert got[1] == reference_report(turns) and got[2][5:7] == (2, "KI")
    monkeypatch.setattr(conversations, "SPOOL", 1 << 16)
    talk = conversations.Conversation(1)
    for k in range(400000):
        talk.add(k, "user" if k % 2 else "assistant", "Some text of a long conversation.", False)
    assert talk.steps._rolled and talk.texts._rolled
    assert talk.audit() == (4, "I" + "K" * 400000 + "I")
    talk.close()


def test_damage_and_no_rows(spark):
    rows = [(c, t, "assistant", "One. Two!", "x", "y", 3) for c in range(8) for t in range(6)]
    frame = spark.createDataFrame(rows, TURNS)
    import zlib
    for r in damaged(frame).collect():
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        assert r["absent"] == (fault == 0) and r["role"] == ("user" if fault == 4 else "assistant")
        assert r["text"] == {1: "", 2: "One Two"}.get(fault, "One. Two!")
    gone = frame.withColumn("absent", F.lit(True))
    assert {tuple(r)[1:7] for r in conversations.repair_report(gone, absent="absent").collect()} == {(0,) * 6}
    assert conversations.repair_report(frame.limit(0)).collect() == []
    assert conversations.repaired_rows(frame.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_mixing", "op13_conversation_repair"])
def test_registered_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
