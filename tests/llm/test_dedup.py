import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm.components import connected
from chartloom.llm.exact_dedup import ExactDedup
from chartloom.llm.jaccard_join import NgramJaccardJoin, bands, difference, excess, identities, max_difference, max_partner, plan_band, plans, prefixes
from chartloom.llm.scratch import Scratch
from chartloom.llm.substring_dedup import SubstringDedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string"


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_corpus(seed=3, groups=14, copies=6):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 60, 150, 400]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(text))
                text[at] = rng.choice(["", f"v{rng.randrange(9)}", text[at].upper()])
            docs.append(" ".join(w for w in text if w) + rng.choice(["", " ", "\n"]))
    docs += [None, "", " \t", "one", "one", "ONE", "a b", "b a", "a b c", "a  b\x0bc", "x" * 5000, "same words " * 900]
    return list(enumerate(docs))


def sets(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    docs = near_corpus()
    s = {i: sets(t, n) for i, t in docs}
    edges = [(i, j) for i in s for j in s if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    want = roots(list(s), edges)
    df = spark.createDataFrame(docs, SHAPE).repartition(3)
    got = NgramJaccardJoin(n, percent).components(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s[i]), want[i]) for i in s}
    kept = {r["doc_id"] for r in NgramJaccardJoin(n, percent).deduplicate(df.withColumn("gone", F.lit(1))).collect()}
    assert kept == {i for i in s if want[i] == i}


def test_join_through_pivots_and_large_groups(spark):
    """A chain of edits in one bucket: each links with its neighbours only."""
    base = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(base)))
        base[i * 2] = f"changed{i}"
    s = {i: sets(t, 3) for i, t in docs}
    edges = [(i, j) for i in s for j in s if i < j and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j])]
    want = roots(list(s), edges)
    got = NgramJaccardJoin(3, 90).components(spark.createDataFrame(docs, SHAPE)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_pigeonhole_bounds():
    for percent in (80, 90):
        low, high = bands(percent, 500)
        assert all(a == b + 1 for a, b in zip(low[1:], high))
        for a, b in list(zip(low, high))[:40]:
            exact, near, spare = plan_band(int(a), int(b), percent)
            worst = max(max_difference(x, y, percent) for x in range(a, b + 1) for y in range(x, max_partner(x, percent) + 1))
            assert exact - spare + 2 * near >= worst + 1 and (not spare or not near)


def test_measured_meetings_choose_one_deletion_neighbourhoods():
    """Where sets often share a passage, fewer and larger segments read with one deletion cost less."""
    often = {i: (1e5, (0.01, 3.0, 60.0, 300.0, 900.0, 2000.0)) for i in range(60)}
    exact, near, _ = plans(90, 200, often)
    assert (near > 0).any() and (exact > 0).any()
    exact, near, _ = plans(90, 200, {i: (1e5, (0.0,) * 6) for i in range(60)})
    assert (near == 0).sum() > len(near) / 2


def test_large_buckets_are_split_by_their_differences(spark, monkeypatch):
    """Buckets are larger than ``PAIRED``: copies with edits, copies of a copy, and sets that share one passage."""
    monkeypatch.setattr("chartloom.llm.jaccard_join.PAIRED", 2)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(150)]
    other = base[:60] + [f"u{i}" for i in range(90)]
    docs = []
    for i in range(160):
        text = list(rng.choice([base, base, other]))
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(150)] = f"e{rng.randrange(4000)}"
        docs.append((i, " ".join(text)))
        if rng.random() < 0.1:
            base = text
    for n, percent in ((3, 90), (5, 80)):
        s = {i: sets(t, n) for i, t in docs}
        edges = [(i, j) for i in s for j in s if i < j and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
        got = NgramJaccardJoin(n, percent).components(spark.createDataFrame(docs, SHAPE)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == roots(list(s), edges)


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_lose_no_link(percent):
    rng = random.Random(percent)
    found = 0
    for _ in range(4000):
        pivot = set(range(rng.randrange(20, 60)))
        a = {x for x in pivot if rng.random() < 0.93} | {rng.randrange(100, 112) for _ in range(rng.randrange(5))}
        b = {x for x in a if rng.random() < 0.93} | {rng.randrange(100, 112) for _ in range(rng.randrange(4))}
        centre = {x for x in pivot if rng.random() < 0.96} | {rng.randrange(200, 203)}
        m = np.array(sorted(centre), np.uint64)
        ka, kb, kp = (difference(np.array(sorted(x), np.uint64), m) for x in (a, b, pivot))
        if not a or not b or excess(len(kp), len(pivot), percent) > min(excess(len(k), len(x), percent) for k, x in ((ka, a), (kb, b))):
            continue
        (la, pa), (lb, pb) = (prefixes((k, len(x)), (kp, len(pivot)), percent) for k, x in ((ka, a), (kb, b)))
        assert la == (100 * len(a & pivot) >= percent * len(a | pivot))
        if a != b and not (la and lb) and 100 * len(a & b) >= percent * len(a | b):
            found += 1
            if la or (not lb and excess(len(ka), len(a), percent) > excess(len(kb), len(b), percent)):
                ka, kb, la, lb, pa, pb = kb, ka, lb, la, pb, pa
            # b links, or a has the smaller excess.
            assert set(ka[: pa[3]].tolist()) & set(kb[: pb[0]].tolist()) if lb else set(ka[: pa[1]].tolist()) & set(kb[: pb[2]].tolist())
    assert found > 50


def test_join_of_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(7, long), (7, long), (7, long + " x"), (None, long + " y"), (None, "alone " + long.upper()), (3, "other words here and there"), (None, ""), (None, None), (3, "")]
    df = spark.createDataFrame(rows, SHAPE).withColumns({"rid": F.lit(1), "_rid": F.lit(2), "_ridf": F.lit(3)})
    join = NgramJaccardJoin(5, 80)
    got = join.components(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"] > 0, str(r["component_id"])) for r in got) == sorted(
        [("7", True, "7")] * 3 + [("None", True, "7")] * 2 + [("3", True, "3"), ("None", False, "None"), ("None", False, "None"), ("3", False, "3")]
    )
    kept = join.deduplicate(df)
    assert kept.columns == df.columns
    left = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect())
    assert left == [("3", ""), ("3", "other"), ("7", "w0 w1"), ("None", ""), ("None", "")]
    assert join.components(df.limit(0)).count() == join.deduplicate(df.limit(0)).count() == 0


def test_clashing_identities_are_told_apart():
    value, ends = np.array([1, 2, 3, 1, 2, 4], np.uint64), np.array([0, 3, 6])
    node, twin = identities(value, ends, {})
    assert node[0] != node[1] and twin[0] != twin[1]
    named, _ = identities(value, ends, {int(node[0]): int(twin[0]), int(node[1]): int(twin[1]) + 1})
    assert named[0] == node[0] and named[1] not in node


def test_distributed_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = roots({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (0, 10**6):
        got = {r["node"]: r["root"] for r in connected(df, Scratch(spark), f"t{limit}_", limit).collect()}
        assert all(got.get(n, n) == r for n, r in want.items())


def test_exact_groups_and_clashing_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é"), (6, "A"), (None, "a"), (2, "a")] + [(100 + i, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, SHAPE).withColumns({"_key": F.lit(0), "maybe": F.lit(1), "keep_id": F.lit(2)})
    got = ExactDedup().groups(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t for t, g in by.items() if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest())
        keep = max(i for i in by[text] if i is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(by[text]), r["doc_id"] == keep)
    kept = ExactDedup().deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 399]
    assert ExactDedup().groups(df.limit(0)).count() == ExactDedup().deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("window", [35, 5])
def test_substrings_equal_brute_force(spark, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.sample(words, k) for k in (34, 35, 36, 50, 90)]
    docs = [None, "", "one two", "x " * 36, "x " * 200, "é ü " * 40]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += rng.sample(words, rng.randrange(0, 60)) + (rng.choice(shared) if rng.random() < 0.5 else [])
        docs.append(rng.choice([" ", "\n", "  "]).join(parts))
    docs += [docs[8], docs[8], docs[9] + " tail", docs[9].upper()]
    rows = list(enumerate(docs))
    seen, starts = {}, {}
    for i, t in rows:
        starts[i] = WORD.findall(t or "")
        for k in range(len(starts[i]) - window + 1):
            seen.setdefault(tuple(starts[i][k : k + window]), []).append((i, k))
    gone = {i: set() for i, _ in rows}
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + window))
    want = {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in starts.items()}
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in SubstringDedup(window).report(df).collect()}
    assert got == want
    assert SubstringDedup(window).report(df.limit(0)).count() == 0


def test_clean_texts_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 12), ("b", 9), ("c", 7)))
    rows = [(1, f"{a} {b}"), (1, f"{c}\n{b}  tail"), (None, a), (None, a), (None, None), (2, "x  y"), (2, " ".join(["same"] * 20000)), (3, "")]
    df = spark.createDataFrame(rows, SHAPE).withColumns({"rid": F.lit(1), "_rid": F.lit(2), "key": F.lit(3), "seq": F.lit(4)})
    tool = SubstringDedup(5)
    out = tool.clean(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted([("1", ""), ("1", f"{c} tail"), ("None", ""), ("None", ""), ("None", "None"), ("2", "x  y"), ("2", ""), ("3", "")])
    lost = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in tool.report(df).collect())
    assert lost == sorted([("1", 21, 21), ("1", 17, 9), ("None", 12, 12), ("None", 12, 12), ("None", 0, 0), ("2", 2, 0), ("2", 20000, 20000), ("3", 0, 0)])
    assert tool.clean(df.limit(0)).count() == 0
