import random
import re
import zlib

import pytest

from braidwork.llm import spelling

SCHEMA = "doc_id long, text string"


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(n):
    form, count = {}, {}
    for w in n:
        near = [v for v in n if is_near(v, w) and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = best if best is not None and n[best] >= 2 * n[w] else None, len(near)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] is not None else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_pairs_of_a_subtree_match_all_pairs():
    r = random.Random(0)
    for _ in range(150):
        words = sorted({"".join(r.choice("abé"[: r.choice([2, 3])]) for _ in range(r.randint(1, 8))) for _ in range(r.choice([2, 5, 30, 80]))})
        got = [tuple(sorted(p)) for p in spelling.pairs_below(words, 0)]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if is_near(words[i], words[j])}


@pytest.mark.parametrize("subtree", [1, 3, 20, 8192])
def test_variants_match_all_pairs_for_any_size_of_partitions(spark, subtree):
    r = random.Random(subtree)
    words = {"".join(r.choice("abc") for _ in range(r.randint(4, 9))) for _ in range(150)} | {"aaaaa", "aaaaaa", "aaaaaaa", "aéaaa", "a×aaa", "q" * 40, "q" * 39 + "z"}
    n = {w: r.choice([3, 5, 10, 20, 40, 80]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert rows_of(spelling.variants(df, subtree)) == plain(n)


def test_vocabulary_of_odd_texts(spark):
    r = random.Random(2)
    stems = ["colour", "color", "honour", "honor", "Étésé", "Theatre", "theater", "x" * 3000]
    rows = [(i, " ".join(r.choice(stems) + r.choice([".", ",", "1", "÷", "\n"]) for _ in range(60))) for i in range(40)]
    rows += [(None, "colour COLOUR colour"), (1, None), (2, ""), (3, "12 34 ..."), (4, "colour" * 5000), (4, "colour" * 5000), (5, "colour" * 5000), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'w' AS word", "1 AS n", "2 AS run").repartition(3)
    want = plain_counts(rows)
    assert {x.word: x.n for x in spelling.vocabulary(df).collect()} == want
    assert rows_of(spelling.variants(spelling.vocabulary(df))) == plain(want)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a bc")], SCHEMA)
    assert spelling.variants(spelling.vocabulary(df)).count() == 0
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_chains_are_followed_to_their_end(spark):
    n = {"a" * (5 + i): 3 * 2**i for i in range(9)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain(n) and {x[2] for x in got} == {"a" * 13}
