import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from braidwork.llm import common, ctph, decontaminate, html, langid, lines, minhash, mixing, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: Columns of any name and type, some of which an operator uses inside.
EXTRA = ["timestamp'2020-01-02 03:04:05' AS `a date`", "1.5BD AS score", "'x' AS items", "2 AS n_words", "map('k', 1) AS _weight", "array(named_struct('y', date'2020-01-01')) AS _row", "0.5 AS _probability", "'s' AS _source", "true AS kept", "'q' AS lang_pred", "1 AS node", "'t' AS topic", "3 AS h1", "4 AS starts", "5 AS ends", "6 AS part"]


def with_extra(df):
    return df.selectExpr("*", *EXTRA)


def odd_rows(spark, texts):
    """The texts, and of the first two a repeated row each, a null id with a text, and one without."""
    df = docs(spark, texts)
    more = df.filter("doc_id < 2").unionByName(df.limit(1).selectExpr("cast(null as bigint) doc_id", "'no id at all here' text", "lang", "source", "n_chars")).unionByName(df.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    return df.unionByName(more)


def test_ranges_by_binary_search(spark):
    r = random.Random(0)
    at = sorted(r.sample(range(-500, 500), 77))
    got = spark.range(1200).selectExpr("id - 600 AS v").union(spark.sql("SELECT CAST(NULL AS BIGINT)")).select("v", common.range_index(F.col("v"), at).alias("i")).collect()
    assert all(x.i == (0 if x.v is None else sum(a <= x.v for a in at)) for x in got)


def test_every_operator_takes_odd_rows_and_any_columns(spark, tmp_path):
    r = random.Random(20)
    texts = [words(r, 60), words(r, 80), None, "", "12", "a" * 30 + "\n" + words(r, 30)] + [words(r, 40) for _ in range(20)]
    df = with_extra(odd_rows(spark, texts)).cache()
    n = len(texts) + 4
    bench = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    assert ctph.edit_study(df).count() == n and ctph.fingerprints(df).count() == n
    near = minhash.near_duplicates(df).collect()
    assert len(near) == n and [x.component_id for x in near if x.doc_id is None] == [None, None] and not any(x.kept for x in near if x.doc_id is None)
    assert langid.identify(df, langid.train(df)).count() == n
    assert decontaminate.report(df, bench).count() == n
    assert lines.dedup(df).count() == n
    assert mixing.mix(df).count() == n
    assert tokens.round_trip(df).count() == n
    labels = with_extra(spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(df, toxicity.train(df, labels)).count() == n
    for out in (minhash.dedup(df), decontaminate.decontaminate(df, bench), mixing.sample(df)):
        assert out.schema.simpleString() == df.schema.simpleString()
        one = out.filter("doc_id = 7").select("`a date`", "score", "items", "_weight", "_row").collect()
        assert one in ([], df.filter("doc_id = 7").select("`a date`", "score", "items", "_weight", "_row").collect())
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "current_timestamp() AS record", "'d' AS digest", "1 AS text")
    assert html.extract(pages).count() == 3 and warc.archive(pages, str(tmp_path / "w")).count() == 3
    none = pages.limit(0)
    assert html.extract(none).count() == 0 and warc.archive(none, str(tmp_path / "v")).count() == 0


def test_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = docs(spark, ["a b", "c"])
    tokens.round_trip(df).count()
    minhash.near_duplicates(df).count()
    assert spark.conf.get(name) == before


def test_very_long_texts(spark):
    r = random.Random(21)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(400_000)) + "\n" + "The same line again, and again; 12.\n" * 20_000
    df = docs(spark, [text, text + " tail", "short"])
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
    got = {x.doc_id: x for x in ctph.edit_study(df).collect()}
    assert got[0].near_next > 0.9 and len(got[0].fingerprint) < 1000
    bench = spark.createDataFrame([(1, text[:200])], "item_id long, text string")
    assert {x.doc_id: x.contaminated for x in decontaminate.report(df, bench).collect()} == {0: True, 1: True, 2: False}
    assert {x.doc_id: x.n_dropped for x in lines.dedup(df, min_docs=2).collect()} == {0: 20_001, 1: 0, 2: 0}
    assert langid.identify(df, langid.train(df.withColumn("doc_id", F.col("doc_id") + 3))).count() == 3
    assert toxicity.score(df, toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 3
    page = "<article>" + "<p>One, two; three.</p>" * 400_000 + "</article>"
    assert html.main_text(page).count("\n") == 399_999


# 1


def plain_ratios(found, smooth=0.25, strength=0.5):
    """The paths at or over the threshold, restated: found is (path, line)."""
    own = {}
    for path, line in found:
        own.setdefault(path, []).append(line)
    length = {p: sum(map(len, x)) / len(x) for p, x in own.items()}
    marks = {p: (1 + sum(ch in ".,;:!?…。，、！？" for line in x for ch in line)) / len(x) for p, x in own.items()}
    score = dict.fromkeys(own, 0.0)
    for i, (path, _) in enumerate(found):
        near = [found[max(i - 1, 0)][0], path, path, found[min(i + 1, len(found) - 1)][0]]
        score[path] += sum(length[p] for p in near) * smooth * sum(marks[p] for p in near) * smooth / len(own[path])
    mean = sum(score.values()) / len(score)
    spread = (sum((x - mean) ** 2 for x in score.values()) / len(score)) ** 0.5
    return {p for p, x in score.items() if x >= strength * spread} or set(score)


def test_chosen_paths_match_plain_ratios():
    r = random.Random(22)
    for _ in range(40):
        paths = html.Paths()
        body = paths.child(0, "body")
        leaves = [paths.child(paths.child(body, f"div.{k}"), "p") for k in "abcd"]
        found = [(r.choice(leaves), "x, " * r.randrange(1, 40), 0) for _ in range(r.randrange(1, 25))]
        chosen = plain_ratios([x[:2] for x in found])
        # a path's container comes with it: here each leaf's own div, which holds nothing else
        assert html.content(paths, found) == [line for path, line, _ in found if path in chosen]


def test_attributes_by_name():
    line = "Long, long text. It goes on, and on; to the end of it."
    p = f"<p>{line}</p>" * 3
    for tag in ('class="content no-sidebar"', 'class="has-sidebar"', 'class="page with-nav"', 'id=x class="site with-header"', 'data-id="search"', 'title="the hidden truth"', "data-x='class=\"ad\"'"):
        assert html.main_text(f"<div {tag}>{p}</div>").count(line) == 3, tag
    for tag in ("hidden", 'aria-hidden="true"', "style='color: red; display : none'", "class='sidebar'"):
        assert html.main_text(f"<div>{p}</div><div {tag}><p>No, no; no.</p></div>").count("No") == 0, tag
    assert html.main_text(f"<article>{p}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is it, is it.</p></article>").endswith("So x=2 is it, is it.")


def test_deep_nesting_is_linear():
    from time import perf_counter

    began = perf_counter()
    assert html.main_text("<div>a, b. " * 30_000 + "</x>" * 30_000).count("\n") == 29_999
    assert html.main_text("<div class=ad>a, b. " * 30_000) is not None
    assert perf_counter() - began < 30


def test_pages_with_open_ends_take_linear_time():
    from time import perf_counter

    for piece, times in (("<a ", 350_000), ('<a "', 250_000), ('<a b="', 170_000), ("<!", 500_000), ("<p title='", 100_000), ("<title>", 50_000), ("<script ", 125_000), ("</a ", 250_000), ("<nav>", 50_000), ("<form>", 50_000)):
        began = perf_counter()
        html.main_text(piece * times)
        html.main_text(piece * (times // 10) + ">")
        assert perf_counter() - began < 8, piece


def test_articles_are_not_lost_to_what_stands_around_them():
    line = "Long, long text. It goes on, and on; to the end of it."
    p, three = f"<p>{line}</p>", "\n".join([line] * 3)
    menu = "<ul><li><a href=x>menu</a></ul>"
    for page in (
        f"<form id=aspnetForm><div class=top>{menu}</div><div class=c>{p * 3}</div></form>",
        f"<form id=aspnetForm><article>{p * 3}</article></form><div><p>Foot, foot.</p></div>",
        f"<body><nav>{menu}<article>{p * 3}</article>",
        f"<body><nav>{menu}<div>{p * 3}</div>",
        f"<article>{p}<aside>side{p * 2}</article>",
        f"<html><head><meta x><title>t</title><body>{p * 3}",
        f"<body><noscript>{p * 3}",
    ):
        assert html.main_text(page) == three, page
    assert html.main_text(f'<body><p title="a>b>c</p>{p}') == f"b>c\n{line}"


def test_comments_bars_and_footers_beside_the_article_lose():
    line = "Long, long text. It goes on, and on; to the end of it."
    p = f"<p>{line}</p>"
    for beside in ("<section id=user-comments>{}</section>", "<div class=comments-area>{}</div>", "<div class=discussion>{}</div>", "<div>{}</div>"):
        assert html.main_text(f"<article>{p}</article>{beside.format(p * 3)}") == line, beside
    for beside in ("<div class=cookie-bar>{}</div>", "<div class=sidebar-left>{}</div>", "<div class=site-footer>{}</div>", "<div class=userComments>{}</div>", "<section id=user-comments>{}</section>"):
        assert html.main_text(f"<div class=story>{p * 3}</div>{beside.format(p)}") == "\n".join([line] * 3), beside
    links = "".join(f"<p><a href=x>{line}</a></p>" for _ in range(5))
    assert html.main_text(f"<div class=a>{p * 3}</div><div class=b>{links}</div>") == "\n".join([line] * 3)
    assert html.main_text(f"<div class=cookie-recipe>{p}</div>") == line


def plain_blocks(page):
    """Lines of a well-formed page of block elements alone, without what is in cut elements, by a stack of names."""
    import re

    out, stack, text = [], [], ""
    for piece in re.split(r"(<[^>]*>)", page):
        if not piece.startswith("<"):
            text += "" if any(x in html.NEVER for x in stack) else piece
            continue
        if line := " ".join(text.split()):
            out.append(line)
        text = ""
        if piece.startswith("</"):
            stack.pop()
        else:
            stack.append(piece[1:-1].split()[0])
    return out


def test_blocks_match_a_plain_stack():
    r = random.Random(23)

    def element(depth):
        name = r.choice(["div", "section", "article", "ul", "blockquote", "nav", "aside", "table", "footer", "h2"])
        inner = "".join(element(depth - 1) if depth and r.random() < 0.7 else f" w{r.randrange(99)}  x, " for _ in range(r.randrange(4)))
        return f"<{name}>{inner}</{name}>"

    for _ in range(200):
        page = "<body>" + "".join(element(4) for _ in range(4)) + "</body>"
        assert [line for _, line, _ in html.blocks(page)[1]] == plain_blocks(page)


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>menu</a></ul></nav><!-- c -->
    <div class="ad">Buy, now!</div><article><h1>Top &amp; title</h1><p><b>First,  part.<br><p>Second\n part&lt;.</p><p>X.</p><form><p>mail</p></form><aside>side</aside>
    <div class="comments"><p>Reader, comment.</p></div></article><footer>&copy; me</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<script>a<b"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    main = "Top & title\nFirst, part.\nSecond part<.\nX."
    assert got == [(1, main, len(main))] * 2 + [(2, "", 0), (3, "", 0), (4, "", 0)]
    assert html.main_text("<div id=c><p>One, two, three.</p><p>Four.</p></div><div class='sidebar x'><p>No.</p></div>") == "One, two, three.\nFour."


def test_pages_of_several_containers():
    line = "Long, long text. It goes on, and on; to the end of it."
    p = f"<p>{line}</p>"
    assert html.main_text(f"<div class=lead>{p * 2}</div><div class=story>{p * 3}<p>End</p></div>") == "\n".join([line] * 5 + ["End"])
    assert html.main_text(f"<body><article id=p1>{p}</article><article id=p2>{p}</article></body>") == "\n".join([line] * 2)


def test_only_whole_classes_cut_and_never_the_article():
    line = "Long, long text. It goes on, and on; to the end of it."
    p = f"<p>{line}</p>"
    assert html.main_text(f"<div class='page has-sidebar no-header'><h2>Top</h2>{p}</div><div class='box sidebar'>{p}</div>") == f"Top\n{line}"
    assert html.main_text(f"<div id=menu><article class=has-comments>{p}</article></div><div class=ad>{p * 3}</div>") == line
    assert html.main_text(f"<div class=widget>{p * 2}</div><div class=cookie-notice>{p}</div>") == f"{line}\n{line}"
    assert html.main_text(f"<article>{p}<div class=comments>{p * 3}<article>{p}</article></div></article><div class=ad>{p * 5}</div>") == line
    assert html.main_text(f"<p class=' '>a <span class=ad>no</span> b, {line}</p>") == f"a b, {line}"


# 2


def test_fingerprints(spark):
    r = random.Random(1)
    texts = ["", None, "a", words(r, 300), words(r, 300), "aaaa" * 5000, words(r, 20_000), words(r, 300) + "é" * 9]
    got = {x.doc_id: x for x in ctph.edit_study(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == ctph.fingerprint(t) and got[i].edited_fingerprint == ctph.fingerprint(edited)
    assert got[3].near_edited > 0.5 > got[3].near_next
    assert ctph.edit_study(empty(spark)).count() == 0
    assert ctph.edit_study(docs(spark, ["only one"])).first().near_next == 1.0


def plain_fingerprint(text):
    """Byte by byte, from the definition."""
    data, mask = (text or "").encode(), (1 << 64) - 1
    if not data:
        return "1::"

    def stir(h, *steps):
        for shift, factor in steps:
            h ^= h >> shift
            h = h * factor & mask
        return h

    level = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * 0x9E3779B97F4A7C15 * pow(0x2545F4914F6CDD1D, j, 1 << 64) for j in range(min(7, i + 1))) & mask
        h = stir(h, (32, 0xD6E8FEB86659FD93), (32, 1))
        level.append(min((h & -h).bit_length() - 1 if h & mask else 31, 31))

    def signs(size):
        out, at = "", 0
        while at < len(data):
            end = next((i + 1 for i in range(at, len(data)) if level[i] >= size and i + 1 - at >= 2**size / 4), len(data))
            if end - at > 4 * 2**size:
                end = max((level[i], i + 1) for i in range(at + 2**size, at + 4 * 2**size))[1]
            h = sum((b + 1) * pow(ctph.STEP, j, 1 << 64) for j, b in enumerate(data[at:end])) & mask
            out += chr(ctph.SIGNS[stir(h, (29, 0xBF58476D1CE4E5B9)) >> 58 & 63])
            at = end
        return out

    k = max((x for x in range(32) if len(data) >= ctph.LEAST * 2**x), default=0)
    return f"{2**k}:{signs(k)}:{signs(k + 1)}"


def test_fingerprints_match_a_plain_loop():
    r = random.Random(23)
    for text in ["", "a", "abc" * 3, "aaaa" * 50, words(r, 300), words(r, 2000, 10**6), "The same line, again. 12\n" * 300, words(r, 40) + "é中" * 60]:
        assert ctph.fingerprint(text) == plain_fingerprint(text), text[:30]


def test_repetitive_texts_stay_like_their_edits():
    r = random.Random(25)
    line = "Licensed under the same terms as before; see the file. Copyright 2020, all rights.\n"
    other = words(r, 5000, 10**6)
    for times in (0, 5, 40, 160, 1000):
        for n in (150, 400):
            text = line * times + words(r, n, 10**6)
            edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
            assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(edited)) >= 0.4, (times, n)
    for times in (2, 20, 200):  # what is repeated is like itself
        assert ctph.likeness(ctph.fingerprint(line * times), ctph.fingerprint(line * times * 2)) > 0.4


def test_ranges_of_more_partitions_than_rows(spark):
    r = random.Random(24)
    df = docs(spark, [words(r, 20) for _ in range(12)])
    few = sorted(map(tuple, ctph.edit_study(df).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "700")
        assert sorted(map(tuple, ctph.edit_study(df).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_common_length_by_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert ctph.common_length(a, b) == t[-1][-1]


# 3


def brute_groups(texts, size=4):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def near_copies(seed=3):
    r = random.Random(seed)
    texts = [None, "", "  ", "One", "one", "a b", "A  b\n", words(r, 3000)]
    for _ in range(6):
        base = words(r, 120, 5000).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(9)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += [words(r, 60, 5000) for _ in range(20)] + texts[8:12]
    r.shuffle(texts)
    return texts


def test_near_duplicates_match_all_pairs(spark):
    texts = near_copies()
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in enumerate(brute_groups(texts))}
    one = {r.doc_id for r in minhash.dedup(docs(spark, texts), 5).collect()}
    assert one == {i for i, (_, c) in enumerate(brute_groups(texts, 5)) if i == c}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_dedup_never_drops_another_text_of_the_same_id(spark):
    r = random.Random(25)
    a, b, x = words(r, 50, 9000), words(r, 50, 9000), words(r, 50, 9000)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, x), (3, x), (4, x), (None, a), (None, a), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id or 0, x.text or "") for x in minhash.dedup(df).collect()))
    assert got == sorted([(1, a), (2, a), (2, b), (3, x), (0, a), (0, a), (5, ""), (6, "")])


def test_many_askers_of_one_block(spark, monkeypatch):
    """One template with many texts that are not linked, and few asking nodes a task."""
    r = random.Random(26)
    base = words(r, 60, 9000).split()
    texts = []
    for _ in range(60):
        t = list(base)
        for i in range(0, 60, 7):
            t[(i + r.randrange(3)) % 60] = f"u{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += texts[:10]
    monkeypatch.setattr(minhash, "ASKING", 5)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs(spark, texts), percent=40).collect()}
    # at 40 percent the candidates may miss links, so only what is confirmed is compared: no false link
    want = brute_groups(texts)
    strict = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert strict == {i: (n, c, i == c) for i, (n, c) in enumerate(want)} and len(got) == len(texts)


def test_recall_of_candidates():
    """Of pairs at 0.8 fewer than one in a million miss."""
    from math import comb

    miss = sum(comb(minhash.K, i) * 0.8**i * 0.2 ** (minhash.K - i) for i in range(minhash.T))
    assert miss < 1e-6


# 4


def test_letters():
    assert not any(map(langid.has_letter, [None, "", "² ½ ① Ⅷ 12 !?"])) and all(map(langid.has_letter, ["ª", "中", "1 a"]))


def test_no_language_is_left_out(spark):
    r = random.Random(27)
    names = [f"q{i:03d}" for i in range(230)]
    rows = [(i, "".join(r.choices("abcdefghij", k=3)) + " " + "".join(chr(0x4E00 + 7 * (i % 230) + k % 5) for k in range(12)), names[i % 230], "s", 0) for i in range(920)]
    df = spark.createDataFrame(rows, DOCS)
    got = langid.sample(df, 1500, 300).groupBy("lang").count().collect()
    assert {x.lang for x in got} == set(names) and sum(x["count"] for x in got) < 600


def test_languages(spark):
    r = random.Random(4)
    parts = {"en": ["the", "ing", "th", "and"], "de": ["sch", "ung", "der", "ü"], "fr": ["eau", "ç", "les", "oi"], "es": ["ción", "ñ", "los", "ar"]}
    rows = [(i, " ".join("".join(r.choices(parts[a], k=3)) for _ in range(r.randrange(3, 40))), a, "s", 0) for i, a in enumerate(list(parts) * 60)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "12 34 !?", None, "s", 0), (1003, "the and thing", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df)
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "en"
    test = [x for x in rows[:240] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(got[x[0]].lang_pred == x[2] for x in test) >= 0.95 * len(test)
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.train(empty(spark))
    assert langid.identify(df.limit(1), none).first().lang_pred == "und"


# 5


def brute_hits(text, items, window=10):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for item, t in items:
        seq = decontaminate.words(t)
        k = min(window, len(seq))
        grams = {tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)} if seq else set()
        for i in range(len(w) - k + 1):
            if grams and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_decontamination_matches_brute_force(spark, block_words):
    r = random.Random(5)
    items = [(i, words(r, r.choice([3, 8, 9, 10, 11, 30]), 4)) for i in range(25)] + [(90, None), (91, ""), (92, "w1 W1-w1")]
    texts = [words(r, r.randrange(200), 4) for _ in range(30)] + [None, "", "é, " * 5, items[4][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.scan_documents(docs(spark, texts), bench, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[i].n_words, sum(got[i].ends) - sum(got[i].starts), set(got[i]["items"])) == (n, hit, found)
    assert decontaminate.report(docs(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(empty(spark), bench).count() == 0


def test_spans_are_cut(spark):
    r = random.Random(6)
    item, clean = words(r, 20), "Clean text, before. " * 8
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x.text for x in decontaminate.decontaminate(docs(spark, [clean + item + " After!", item, None, clean]), bench).collect()}
    assert got == {0: clean + " After!", 2: None, 3: clean}


# 6


def test_runs_over_several_batches(spark):
    """What add() gives are the keys no earlier batch had; all frames are read at the end, after compactions."""
    r = random.Random(28)
    pool = [f"A line that is shared by documents, number {i}" for i in range(40)]
    runs = lines.LineRuns(spark, fanout=2)
    batches, frames, seen = [], [], set()
    for k in range(7):
        texts = ["\n".join(r.sample(pool, 4)) for _ in range(5)]
        batches.append([(100 - 10 * k + i, t) for i, t in enumerate(texts)])
        frames.append(runs.add(spark.createDataFrame(batches[-1], "doc_id long, text string")))
    for batch, frame in zip(batches, frames):
        last = {}
        for i, t in batch:
            for x in t.split("\n"):
                last[lines.keys(x)[0]] = max(last.get(lines.keys(x)[0], 0), i)
        got = {np.array([x.h1, x.h2], "<i8").tobytes(): x.last for x in frame.collect()}
        assert got == {k: v for k, v in last.items() if k not in seen}
        seen |= set(last)
    total = {}
    for batch in batches:
        for _, t in batch:
            for x in t.split("\n"):
                total[lines.keys(x)[0]] = total.get(lines.keys(x)[0], 0) + 1
    assert {np.array([x.h1, x.h2], "<i8").tobytes(): x.n for x in runs.totals().collect()} == total
    assert len(runs.levels) == 2 and len(runs.retired) == 6 and runs.pairs() == sum(total.values())
    runs.release()
    assert runs.totals().count() == len(total)
    runs.drop()
    assert runs.totals() is None and not [t for t in spark.catalog.listTables() if t.name.startswith("braidwork_run")]


def test_hot_lines(spark, monkeypatch):
    """Hot keys by the broadcast, all others by the join: the same rows."""
    texts = ["A line in every one of the documents\n" + (f"A line in a few of the documents {i % 7}" if i % 2 else f"A line of one document {i}") for i in range(40)]
    df = docs(spark, texts)
    results = []
    for hot in (1, 3, 10_000):
        monkeypatch.setattr(lines, "HOT", hot)
        results.append(sorted(map(tuple, lines.dedup(df).collect())))
    assert results[0] == results[1] == results[2] and sum(x[2] for x in results[0]) == 39 + sum(max(0, n - 1) for n in [sum(1 for i in range(1, 40, 2) if i % 7 == k) for k in range(7)] if n >= 3)


def test_lines_match_brute_force(spark):
    r = random.Random(7)
    pool = [f"A line that many documents share, number {i}" for i in range(9)] + ["short", "", "  É line of twenty chars \t", "Ä" * 20]
    texts = ["\n".join(x if r.random() < 0.5 else f" {x.swapcase()}\r" for x in r.choices(pool, k=r.randrange(1, 9))) for _ in range(40)] + [None, ""]
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    got = {x.doc_id: x for x in lines.dedup(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(own), len(own) - len(kept), "\n".join(kept))
    assert lines.dedup(empty(spark)).count() == 0


# 7


def test_raking_meets_targets(spark):
    r = random.Random(8)
    cells = [(s, a, t, r.randrange(1, 1000)) for s in "xyz" for a in ("en", "de") for t in "pq"]
    targets = [{"x": 0.2, "y": 0.3, "z": 0.5}, {"en": 0.6, "de": 0.4}, {"p": 0.5, "q": 0.5}]
    f = mixing.rake(cells, targets)
    total = sum(c[3] for c in cells)
    for d in range(3):
        for v, share in targets[d].items():
            assert abs(sum(c[3] * x for c, x in zip(cells, f) if c[d] == v) / total - share) < 1e-6
    p = mixing.calibrated(cells, f, 0.5)
    assert abs(sum(c[3] * x for c, x in zip(cells, p)) / total - 0.5) < 1e-9 and p.max() <= 1
    table = spark.createDataFrame(cells, "_source string, _lang string, _topic string, n long")
    far = {tuple(x[:3]): x.factor for x in mixing.rake_table(table, targets, passes=6).select("_source", "_lang", "_topic", "factor").collect()}
    assert all(abs(far[c[:3]] - x) < 1e-2 * max(1, x) for c, x in zip(cells, f))


def test_mixing_keeps_every_row_and_all_columns(spark):
    r = random.Random(9)
    df = docs(spark, [words(r, 50) for _ in range(300)] + [None, ""]).selectExpr("*", "1 AS cell", "'q' AS topic")
    got = mixing.mix(df, share=0.5).collect()
    assert len(got) == 302 and all(0 <= x._probability <= 1 for x in got)
    # weights row by row, by plain dicts
    tokens_of = lambda t: max(1, len((t or "").split()))
    cell = {x.doc_id: (x._source, x._lang, x._topic) for x in got}
    assert all(x._tokens == tokens_of(x[common.REST].text) and x._source == x[common.REST].source for x in got)
    total = sum(x._tokens for x in got)
    want = []
    for d, power in enumerate(mixing.POWERS.values()):
        sums = {}
        for x in got:
            sums[cell[x.doc_id][d]] = sums.get(cell[x.doc_id][d], 0) + x._tokens
        raised = {k: v**power for k, v in sums.items()}
        want.append({k: v / sum(raised.values()) * total for k, v in raised.items()})
    weight = {x.doc_id: 1.0 for x in got}
    for _ in range(300):
        for d in range(3):
            have = {}
            for x in got:
                have[cell[x.doc_id][d]] = have.get(cell[x.doc_id][d], 0) + x._tokens * weight[x.doc_id]
            for i in weight:
                weight[i] *= want[d][cell[i][d]] / have[cell[i][d]]
    assert all(x._weight == pytest.approx(weight[x.doc_id], rel=1e-6) for x in got)
    c = 0.5 * total / sum(x._tokens * weight[x.doc_id] for x in got)
    if max(weight.values()) * c < 1:
        assert all(x._probability == pytest.approx(c * weight[x.doc_id], rel=1e-6) for x in got)
    kept = sum(x._tokens for x in got if x._kept) / sum(x._tokens for x in got)
    assert 0.4 < kept < 0.6
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.sample(df).columns == df.columns


def test_both_forms_of_mixing_give_the_same(spark):
    """Raking that takes more than 20 passes, and cells at probability 1 that pass on what they lack."""
    counts = [("a", "en", 60), ("a", "de", 16), ("b", "en", 14), ("b", "de", 30), ("c", "de", 11), ("c", "fr", 40), ("b", "fr", 12)]
    rows = [(i, "one two three", lang, source, 13) for i, (source, lang) in enumerate((s, g) for s, g, n in counts for _ in range(n))]
    df = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"a": 0.2, "b": 0.5}}
    near, far = ({x.doc_id: x for x in mixing.mix(df, targets, 0.8, driver_cells=n).collect()} for n in (1000, 0))
    assert len(near) == len(far) == len(rows)
    for i, x in near.items():
        assert far[i]._weight == pytest.approx(x._weight, rel=1e-8) and far[i]._probability == pytest.approx(x._probability, rel=1e-8) and far[i]._kept == x._kept
    capped = sum(x._probability == 1 for x in near.values())
    assert 0 < capped < len(rows)
    assert sum(x._probability * x._tokens for x in far.values()) == pytest.approx(0.8 * 3 * len(rows))
    assert sum(x._weight * x._tokens for x in far.values() if x._source == "b") == pytest.approx(0.5 * 3 * len(rows), rel=1e-8)


# 8


def test_a_very_long_text_in_token_files_archives_and_the_mix(spark, tmp_path):
    r = random.Random(31)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    df = docs(spark, [text, "short", None])
    n = {x.doc_id: x.n_tokens for x in tokens.round_trip(df).collect()}
    assert n[0] > 300_000 and n[2] == 1
    assert mixing.mix(df).count() == 3
    pages = spark.createDataFrame([(1, "u", f"<p>{text}</p>"), (2, "u", f"<p>{text}</p>")], "page_id long, url string, html string")
    got = {x.page_id: (x.payload_bytes, x.record_type, x.refers_to) for x in warc.archive(pages, str(tmp_path / "w")).collect()}
    assert got == {1: (len(text) + 7, "revisit", 2), 2: (len(text) + 7, "response", None)}


def test_codes_round_trip():
    r = np.random.RandomState(10)
    for n in (0, 1, 3, 4, 1001):
        x = (r.randint(0, 1 << 62, n) >> r.randint(30, 62, n)).astype(np.uint32)
        control, data = tokens.encode_ranks(x)
        assert (tokens.decode_ranks(control, data, n) == x).all()
    block = tokens.write_block([5, 6], [1, 2], np.array([7, 300, 70000], np.uint32))
    ((ids, sizes, ranks, before),) = tokens.read_blocks(block + b"\n")
    assert (ids.tolist(), sizes.tolist(), ranks.tolist(), before) == ([5, 6], [1, 2], [7, 300, 70000], 0)
    with pytest.raises(ValueError):
        list(tokens.read_blocks(block[:-6] + b"x" + block[-5:] + b"\n"))


def test_token_files_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_vocabulary())
    r = random.Random(11)
    texts = [None, "", "It's <|endoftext|> 12 ²", "İΣσ́ 中文\xa0x", "a b" * 40_000] + ["".join(r.choices("abÉñ'’.,!09 \t\nİ中", k=50)) for _ in range(60)]
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in tokens.round_trip(docs(spark, texts)).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.round_trip(empty(spark)).count() == 0


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.public_vocabulary("byte_bpe_50k.json")
    encoder = tokens.Encoder(open(path, encoding="utf-8").read())
    t = Tokenizer.from_file(path)
    texts = ["hello world", "  two  blanks\n\nlines ", "", "don't <|endoftext|> stop", "é中 1234"]
    assert encoder.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_token_files_are_cut(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 40)
    monkeypatch.setattr(tokens, "FILE_BLOCKS", 2)
    r = random.Random(29)
    df = docs(spark, [words(r, r.randrange(60)) for _ in range(50)])
    tokens.write_tokens(df, str(tmp_path / "t"), tokens.public_vocabulary())
    assert len([p for p in (tmp_path / "t" / "blocks").iterdir() if p.name.startswith("part")]) > 8
    # nothing but the folder is needed, in any session
    got = sorted(map(tuple, tokens.read_tokens(spark.newSession(), str(tmp_path / "t")).drop("ids").collect()))
    start = 0
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert [x[0] for x in got] == list(range(50))


# 9


def test_gzip_members():
    import gzip

    parts = [b"", b"x" * 100, bytes(np.random.RandomState(1).randint(0, 256, 1 << 20, dtype=np.uint8)) * 17]
    data = b"".join(warc.member(x) + b"\0" for x in parts)
    assert gzip.decompress(data) == b"".join(x + b"\r\n\r\n" for x in parts)
    assert [x for x in warc.members(data) if x] == [x + b"\r\n\r\n" for x in parts]
    with pytest.raises(ValueError):
        list(warc.members(data[:-5]))


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_both_versions(spark, tmp_path, version):
    import gzip

    http = warc.HTTP_HEAD
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(warc.arc_archive([("http://a/", http + b"same"), ("http://b/", http + b"other"), ("http://c/", b"no header")], version))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(warc.arc_archive([("http://d/", http + b"same")], version)))
    arcs = warc.read_arc(spark, str(tmp_path / "in"))
    assert sorted((x.key, x.url) for x in arcs.collect()) == [("a.arc:000000000000", "filedesc://braidwork.arc"), ("a.arc:000000000001", "http://a/"), ("a.arc:000000000002", "http://b/"), ("a.arc:000000000003", "http://c/"), ("b.arc.gz:000000000000", "filedesc://braidwork.arc"), ("b.arc.gz:000000000001", "http://d/")]
    got = {}
    for x in warc.convert_archives(arcs).collect():
        (one,) = warc.parse_warc(bytes(x.record))
        got[x.key] = one["header"]["warc-type"], one["header"].get("x-refers-to-key"), one["header"]["warc-target-uri"], one["header"]["warc-date"]
    assert {k: v[:2] for k, v in got.items()} == {"a.arc:000000000000": ("warcinfo", None), "a.arc:000000000001": ("revisit", "b.arc.gz:000000000001"), "a.arc:000000000002": ("response", None), "a.arc:000000000003": ("resource", None), "b.arc.gz:000000000000": ("warcinfo", None), "b.arc.gz:000000000001": ("response", None)}
    assert got["a.arc:000000000001"][2:] == ("http://a/", "2020-01-01T00:00:00Z")
    warc.write_warc(warc.convert_archives(arcs), str(tmp_path / "out"))
    import glob

    whole = b"".join(gzip.decompress(open(p, "rb").read()) for p in sorted(glob.glob(str(tmp_path / "out" / "part*"))))
    assert len(list(warc.parse_warc(whole))) == 6


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    body = b"<html>\nhttp://x 1.1.1.1 20200101000000 text/html 5\nWARC/1.1\r\n\r\n"
    data = warc.arc_archive([("http://a b/", body), (None, b"")], version)
    got = list(warc.parse_arc(data))
    assert [(x["url"], x["body"]) for x in got] == [("http://a%20b/", body), ("-", b"")]
    whole = b"\r\n\r\n".join(warc.warc_record(x, str(i)) for i, x in enumerate(got)) + b"\r\n\r\n"
    assert [x["block"] for x in warc.parse_warc(whole)] == [body, b""]
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-9] if version == 1 else data[:40]))


def test_archives(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in warc.archive(df, str(tmp_path / "w")).collect()}
    assert {k: (x.record_type, x.refers_to, x.payload_bytes) for k, x in got.items()} == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 16), 6: ("response", None, 200_000)}
    assert got[1].payload_digest == warc.base32_sha1(b"same")


def test_records_of_repeated_ids_and_a_hot_payload(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i}") for i in range(2000)] + [(7, "u", "hot"), (7, "u", "p7"), (7, "v", "other"), (None, "u", "hot"), (None, "u", "more")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = [next(iter(warc.parse_warc(bytes(x.record)))) for x in warc.convert_pages(df).collect()]
    ids = {}
    for x in records:
        h = x["header"]
        ids.setdefault(h["warc-record-id"], set()).add((h["x-row-key"], h["warc-payload-digest"]))
        if h["warc-type"] == "revisit":
            assert h["x-refers-to-key"] == "1998"
    assert all(len(v) == 1 for v in ids.values())
    targets = {h["warc-refers-to"] for x in records if (h := x["header"])["warc-type"] == "revisit"}
    (target,) = targets
    assert ids[target] == {("1998", "sha1:" + warc.base32_sha1(b"hot"))}
    assert sum(x["header"]["warc-type"] == "revisit" for x in records) == 667 - 1 + 1


# 10


def test_toxicity(spark):
    r = random.Random(12)
    bad = ["scum", "moron", "idiot"]
    rows, labels = [], []
    for i in range(900):
        w = words(r, r.randrange(5, 60)).split()
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, toxic))
    rows += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, "you id1ot, you sc*um m0ron", "en", "s", 0)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    assert len(got) == 903 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][2] for i in test) >= 0.95 * len(test)
    assert not got[2001].predicted
    xs, ps = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(ps) >= 0).all()
    none = toxicity.train(empty(spark), lab.limit(0))
    assert 0 <= toxicity.score(df.limit(1), none).first().score <= 1


def test_toxicity_labels_that_conflict(spark):
    df = docs(spark, ["scum moron idiot " + "x" * (i + 1) for i in range(40)] + ["good day to all " + "y" * (i + 1) for i in range(40)])
    lab = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(i, 0) for i in range(40)], "doc_id long, toxic int")
    one, two = (toxicity.train(df, lab.repartition(k)) for k in (1, 7))
    assert one.lexicon == two.lexicon and set(one.lexicon) == {"scum", "moron", "idiot"}
    assert toxicity.score(df, one).collect() == toxicity.score(df, two).collect()


def plain_draw(doc_id, text, seed=17):
    """Spark's chained xxhash64 of an int, a long and a string, as a number under 1."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
    h = xxh64_intdigest(text.encode(), h)
    return h % (1 << 40) / (1 << 40)


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    """The whole of run(), restated in plain Python: languages by the trained model, all pairs, all windows, dict raking, the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(31)
    item = words(r, 25, 9000)
    texts = [words(r, r.randrange(5, 90), 9000) for _ in range(40)]
    texts += [texts[0], texts[3] + " tail", texts[5].upper(), None, "", "12 34", item, item + " and more. " + texts[7], "Note | of | a | table " + words(r, 30, 9000), "SHOUT IT ALL NOW" + words(r, 1)]
    rows = [(i, t, "en" if i % 4 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t, lang or "en", s) for i, t, lang, s, _ in rows if t and any(map(str.isalpha, t))]
    label = brute_groups([t for _, t, _, _ in kept], corpus_pipeline.SHINGLE)
    kept = [x for k, x in enumerate(kept) if label[k][1] == k]
    clean = []
    for i, t, lang, s in kept:
        w = decontaminate.words(t)
        seq = decontaminate.words(item)
        grams = {tuple(seq[k : k + 10]) for k in range(len(seq) - 9)}
        hit = {p for k in range(len(w) - 9) if tuple(w[k : k + 10]) in grams for p in range(k, k + 10)}
        if len(hit) > corpus_pipeline.MAX_TEST_SHARE * len(w):
            continue
        at = [(m.start(), m.end()) for m in decontaminate.WORD.finditer(t.lower().encode())]
        out, last = b"", 0
        for p in sorted(hit):
            if p - 1 not in hit:
                out += t.encode()[last : at[p][0]]
            last = at[p][1]
        clean.append((i, (out + t.encode()[last:]).decode(), lang, s))
    topic = lambda t: "empty" if not t else "table" if " | " in t else "shout" if 2 * sum("A" <= ch <= "Z" for ch in t) > len(t) else "signs" if 20 * sum(ch in "|*&%#$!" for ch in t) > len(t) else "note" if len(t) < 400 else "prose"
    cells = {}
    for i, t, lang, s in clean:
        cells.setdefault((s, lang, topic(t)), []).append((i, t, max(1, len(t.split()))))
    size = {k: sum(x[2] for x in v) for k, v in cells.items()}
    total = sum(size.values())
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(400):
        for d, power in enumerate(mixing.POWERS.values()):
            sums = {}
            for k, n in size.items():
                sums[k[d]] = sums.get(k[d], 0) + n
            raised = {k: v**power for k, v in sums.items()}
            have = {}
            for k, n in size.items():
                have[k[d]] = have.get(k[d], 0) + n * factor[k]
            for k in factor:
                factor[k] *= raised[k[d]] / sum(raised.values()) * total / have[k[d]]
    full = set()
    while True:
        c = (corpus_pipeline.MIX_SHARE * total - sum(size[k] for k in full)) / max(sum(size[k] * factor[k] for k in factor if k not in full), 1e-300)
        over = {k for k in factor if k not in full and c * factor[k] >= 1}
        if not over:
            break
        full |= over
    mixed = sorted((i, t) for k, v in cells.items() for i, t, _ in v if plain_draw(i, t) < (1.0 if k in full else c * factor[k]))
    tokenizer = Tokenizer.from_file(tokens.public_vocabulary())
    want, start = {}, 0
    for i, t in mixed:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want and 20 < len(got) < len(clean) < len(kept)


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(30)
    df = with_extra(odd_rows(spark, [words(r, 60) for _ in range(10)] + [None, "", "12"])).withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang")))
    bench = spark.createDataFrame([(1, words(r, 20, 9))], "item_id long, text string")
    for name, table in (("full", df), ("none", df.limit(0)), ("no lang", df.withColumn("lang", F.lit(None).cast("string")))):
        at = str(tmp_path / name)
        table.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        docs_, kept = spark.read.parquet(f"{at}/documents.parquet"), []
        for i, (_, work) in enumerate(corpus_pipeline.STAGES):
            out = work(spark, docs_, at)
            out.write.parquet(f"{at}/s{i}")
            docs_ = spark.read.parquet(f"{at}/s{i}")
            kept.append(docs_.count())
            if i < 4:
                assert docs_.columns == table.columns and docs_.schema.simpleString() == table.schema.simpleString()
            if i == 0 and name == "full":
                assert docs_.filter("doc_id = 3").first().lang == "en"
        # letters: ten texts, two of them twice, and one without an id
        assert kept[:2] == ([0, 0] if name == "none" else [13, 11])


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    item = words(r, 30, 9000)
    texts = [words(r, 80, 9000) for _ in range(30)]
    texts += [texts[0], texts[1].replace("w", "w", 1) + " tail", None, "", "12 34", item + " " + words(r, 90, 9000), item]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs(spark, texts)
    for i, (name, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        at = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {x.doc_id for x in at.collect()}
        if i == 0:
            assert ids == set(range(len(texts))) - {32, 33, 34}
        if i == 1:
            assert 30 not in ids and 31 not in ids and {0, 1, 35, 36} <= ids
        if i == 2:
            assert 36 not in ids and 35 in ids and item not in at.filter("doc_id = 35").first().text
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, at.collect()))
