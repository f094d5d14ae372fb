import random
import re

import numpy as np
import pytest

from braidwork.llm import partenum

SCHEMA = "doc_id long, text string"


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def plain(rows, percent, size=4):
    """(doc_id, size of the set, least doc_id of its component) by comparing all pairs."""
    sets = [(i, plain_set(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted([(i, len(a), find(i)) for i, a in sets])


def edited(r, words, changes):
    words = list(words)
    for _ in range(changes):
        kind, at = r.randrange(3), r.randrange(len(words))
        words[at : at + (kind > 0)] = [f"e{r.randrange(10**6)}"] * (kind < 2)
    return words


def hashes(r, n):
    return np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))


def test_linked_sets_always_share_a_signature():
    r = random.Random(1)
    for _ in range(1500):
        n = r.choice([6, 7, 8, 11, 20, 45, 90, 150, 300, 700])
        a = hashes(r, n)
        commons = np.sort(a[np.array([r.random() < 0.4 for _ in a])]) if r.random() < 0.5 else np.zeros(0, np.uint64)
        drop = r.randint(0, max(1, n * 15 // 100))
        kept = np.array(sorted(r.sample(a.tolist(), n - drop)), np.uint64)
        b = np.unique(np.concatenate([kept, hashes(r, r.randint(0, max(1, n * 8 // 100)))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(partenum.signatures(a, commons), partenum.signatures(b, commons))), (n, len(b), both)


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_bands_and_bounds_hold_for_every_pair_of_sizes(percent):
    low, high = zip(*partenum.bands(400, percent))
    of = lambda n: max(i for i, x in enumerate(low) if x <= n)
    for a in range(1, 300):
        for b in range(a, a * 100 // percent + 1):
            both = -(-percent * (a + b) // (100 + percent))  # the least that links them
            if both <= a:
                assert of(b) - of(a) in (0, 1) and a + b - 2 * both <= partenum.difference(high[of(a)], percent)


def corpus(r):
    originals = [[f"w{r.randrange(3000)}" for _ in range(r.choice([9, 12, 30, 60, 200, 500]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join(w) for w in originals]
    for w in originals:
        for changes in (0, 1, 2, 4, 8):
            texts.append(" ".join(edited(r, w, changes)))
    texts += [" ".join([f"q{r.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(40)]  # share most, and aren't linked
    texts += [" ".join(passage + [f"z{i}" for i in range(k)]) for k in range(0, 20)]
    texts += [None, "", " \n", "one", "One", "a b c", "A B C", "a b c d", "a b c d e", "x " * 400, "X " * 500]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_all_pairs(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS n", "'t' AS t").repartition(5)
    got = sorted(tuple(x) for x in partenum.similar_sets(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain(rows, 85)


def test_sets_that_stay_apart_from_the_pivot_still_meet(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SAMPLE_SETS", 1)  # nothing counts as common
    r = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(edited(r, base, 12)) for _ in range(60)]
    texts += [" ".join(edited(r, t.split(), 1)) for t in texts[:30]]
    rows = list(enumerate(texts))
    got = sorted(tuple(x) for x in partenum.similar_sets(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain(rows, 85)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (None, None), (2, "a b c d e f g h i j"), (3, None), (4, "")]
    got = partenum.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == sorted([(1, 7, 1), (1, 7, 1), (None, 7, None), (None, 0, None), (2, 7, 1), (3, 0, 3), (4, 0, 4)], key=repr)
    assert partenum.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(r, words, 500))), (3, " ".join(words[:30_000]))]
    got = {x.doc_id: x.component_id for x in partenum.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
