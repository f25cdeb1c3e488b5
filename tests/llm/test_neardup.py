import itertools
import random
import re

import numpy as np
import pandas as pd

from sheaf.llm import neardup as N

S = N.Settings(run=3, least_words=40, similarity=0.5)


def texts(seed=0, families=12):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(800)]
    out = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        out += [" ".join(base), " ".join(base).upper() + "!"]
    return out


def runs(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 40 else None


def truth(rows):
    same = {}
    for i, t in rows:
        if t and runs(t):
            same[t] = min(i, same.get(t, i))
    sets = {i: runs(t) for t, i in same.items()}
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    return links, {(i, same[t]) for i, t in rows if t in same}


def run(spark, rows, s=S):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, text string, a string")
    links, classes = N.near_duplicates(df, s)
    return {(r.a, r.b) for r in links.collect()}, {(r.id, r.representative) for r in classes.collect()}


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [(1000, None), (1001, ""), (1002, "too short"), rows[3]]
    assert run(spark, rows) == truth(rows)


def test_hot_bands_are_joined(spark):
    rows = list(enumerate(texts(3, 4)))
    small = N.Settings(run=3, least_words=40, similarity=0.5, hot=2)
    assert run(spark, rows, small) == truth(rows)


def test_many_copies_form_one_class(spark):
    t = texts(5, 1)[0]
    links, classes = run(spark, [(i, t) for i in range(500)])
    assert links == set() and classes == {(i, 0) for i in range(500)}


def test_different_texts_with_equal_runs_keep_all_links(spark):
    t = texts(7, 1)[0]
    words = t.split()
    near = " ".join([*words[:-4], "other", "end"])
    rows = [(1, t), (2, t.upper()), (3, t + "!"), (4, t), (5, near), (6, near + "."), (7, near)]
    links, classes = run(spark, rows)
    assert (links, classes) == truth(rows)
    assert len(links) == 10 and {(4, 1), (7, 5)} <= classes


def test_empty(spark):
    assert run(spark, []) == (set(), set())


def test_registers_merge_by_maximum_and_estimate():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**N.KEPT_BITS, 300, dtype=np.uint64)
    a, b = x[:200], x[100:]
    ka, kb, ku = N.registers(np.concatenate([a, b, x]), np.array([0, 200, 400]), S)
    assert (np.maximum(ka, kb) == ku).all()
    j = N.estimate(ka[None], kb[None], np.array([200.0]), np.array([200.0]), S.base)[0]
    assert abs(j - 1 / 3) < 0.12


def test_word_runs():
    s = N.Settings(run=2, least_words=3)
    which, x, starts = N.sets_of(["a b c", None, "A-b_c!", "a b", "a b a b a", "x y z"], s)
    sets = [set(x[p:q].tolist()) for p, q in zip(starts, starts[1:])]
    assert which == [0, 2, 4, 5] and [len(v) for v in sets] == [2, 2, 2, 2]
    assert sets[0] == sets[1] and len(sets[0] & sets[2]) == 1 and not sets[0] & sets[3]


def test_texts_with_many_stock_phrases_meet(spark):
    r = random.Random(11)
    words = lambda n: ["v%d" % r.randrange(10**9) for _ in range(n)]
    stock = words(63)  # 61 runs
    out = [stock + words(200) for _ in range(60)]
    shared = words(39)
    out += [stock[-37:] + shared + words(26), stock + shared]  # 35 and 61 of 100 runs are stock, similarity 0.587
    for _ in range(40):  # 35 of 100 runs are stock, similarity 0.504
        shared = words(32)
        out += [stock[-37:] + shared + words(33), stock[-37:] + shared + words(33)]
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    links, _ = truth(rows)
    assert len(links) == 41 and run(spark, rows)[0] == links


def test_no_pair_at_the_threshold_is_lost_at_any_cap(spark):
    r = random.Random(17)
    words = lambda n: ["u%d" % r.randrange(10**9) for _ in range(n)]
    rows, links = [], set()
    for k in range(0, 6000, 2):  # 40 of 60 runs are shared, similarity 0.5 to the dot
        shared = words(42)
        rows += [(k, " ".join(shared + words(20))), (k + 1, " ".join(shared + words(20)))]
        links.add((k, k + 1))
    for hot in (1, 200):  # under 1 no two texts are paired in a task, all by the join
        assert run(spark, rows, N.Settings(run=3, least_words=40, similarity=0.5, hot=hot))[0] == links


def test_order_of_runs_changes_nothing(spark, monkeypatch):
    rows = list(enumerate(texts(19, 6)))
    expected = truth(rows)
    for most, hot in ((0, 7), (40, 2)):
        monkeypatch.setattr(N, "ORDERED", most)
        assert run(spark, rows, N.Settings(run=3, least_words=40, similarity=0.5, hot=hot)) == expected


def test_thresholds_equal_brute_force(spark):
    rows = list(enumerate(texts(23, 5)))
    sets = {i: runs(t) for i, t in rows}
    same = dict(truth(rows)[1])
    for similarity in (0.2, 1.0):
        links = {(a, b) for a, b in itertools.combinations(sorted(set(same.values())), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
        assert run(spark, rows, N.Settings(run=3, least_words=40, similarity=similarity, hot=5))[0] == links


def test_bitmaps_differ_in_no_more_bits_than_the_sets_in_runs():
    r = np.random.default_rng(3)
    for n in (1, 60, 400):
        x = r.integers(0, 2**N.KEPT_BITS, 2 * n, dtype=np.uint64)
        bits = N.bitmaps(np.concatenate([x[:n], x[n // 2 : n + n // 2 + 1]]), np.array([0, n]))
        apart = sum(int(np.bitwise_count((v[:1] ^ v[1:]).view(np.uint64))[0]) for v in bits.values())
        assert apart <= len(set(x[:n].tolist()) ^ set(x[n // 2 : n + n // 2 + 1].tolist()))


def test_runs_of_several_batches_are_paired_once_each():
    s = N.Settings(run=3, least_words=40, similarity=0.5, hot=3)
    rows = [(7, i, 10, 20) for i in range(3)] + [(8, i, 10, 20) for i in range(6)] + [(9, 1, 10, 20), (9, 1, 10, 20), (9, 2, 10, 20)]
    for size in (1, 2, 5, 50):
        batches = [pd.DataFrame(rows[i : i + size], columns=["run", "id", "n", "most"]).assign(**dict.fromkeys(N.BITS, 0)) for i in range(0, len(rows), size)]
        out = pd.concat(list(N._pairs(s)(iter(batches))))
        assert sorted(out.loc[~out["hot"], ["a", "b"]].itertuples(index=False, name=None)) == [(0, 1), (0, 2), (1, 2), (1, 2)]
        assert sorted(out.loc[out["hot"], ["a", "b"]].itertuples(index=False, name=None)) == [(i, 8) for i in range(6)]
