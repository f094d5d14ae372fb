"""Spelling variants: words at edit distance one, by a self-join of the vocabulary's trie with active nodes.

A node's active nodes are the nodes whose prefix is within distance one of its own. At distance nought that is the
node itself. A pair at distance one is born where two words part: between two children of a node (a replaced code
point), or between a child and its parent (an inserted or deleted one); from there it goes down equal labels alone,
and two words are near if both end at such a pair.

The trie is partitioned by prefixes that are as long as it takes for each to hold at most SUBTREE words. Below a
partition's prefix a task holds the subtree, as ranges of its sorted words, and takes pairs down level by level. Pairs
born above (in the crown) have both ends in any partitions: they meet where the labels left are equal, in groups of
at most one word for each letter of the alphabet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

#: Runs of these are words (A-Z, a-z and U+00C0 to U+00FF).
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Words of a subtree that a task holds at once.
SUBTREE = 8192


def occurrences(docs: DataFrame, misspelt: int = MISSPELT) -> DataFrame:
    """(word) of every run of every text, A-Z lower-cased; of a run of which `misspelt` divides the crc32 of `<doc_id>:<run>` (a null id as empty text) the code point at crc32 % length is gone."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.select("id", common.ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    gone = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % misspelt == 0, gone).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points or more, found LEAST_COUNT times or more. Counts are summed in each task before the shuffle."""
    return occurrences(docs).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def partitioned(words: DataFrame, most: int = SUBTREE) -> DataFrame:
    """words (word, n) with depth: the length of the shortest prefix that at most `most` words share, of lengths 0, 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    left, done, depth = words, None, 0
    while True:
        prefix = F.substring("word", 1, depth) if depth else F.lit("")
        counts = left.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("c")).filter(F.col("c") > most).select("prefix")
        # of prefixes of one length, at most one for each `most` words is large
        dealt = common.stored(left.withColumn("prefix", prefix).join(F.broadcast(counts.withColumn("large", F.lit(True))), "prefix", "left").select("word", "n", "large"), "prefixes")
        small = dealt.filter("large IS NULL").select("word", "n", F.lit(depth).alias("depth"))
        done = small if done is None else done.unionByName(small)
        left = dealt.filter("large").select("word", "n")
        if not left.limit(1).count():
            return done
        depth += 1 if depth < 4 else 1 << (depth.bit_length() - 2)


def pairs_below(words: list[str], depth: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of the sorted distinct words, all with the same prefix of that length, that are at distance one and part at that depth or below."""
    n = len(words)
    codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
    size = np.array([len(x) for x in codes], np.int64)
    flat = np.concatenate([*codes, np.zeros(1, np.uint32)]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    common_ = np.array([0] + [shared(codes[i - 1], codes[i]) for i in range(1, n)], np.int64)  # of a word and the one before
    out: list[tuple[int, int]] = []

    def settled(u, v, du, dv):
        """Pairs of single words: near if the labels left are equal."""
        same = size[u] - du == size[v] - dv
        for a, b in zip(u[same].tolist(), v[same].tolist()):
            if words[a][du:] == words[b][dv:]:
                out.append((a, b))

    def children(low, high, d):
        """(node, label, low, high) of all children of the nodes low..high at depth d."""
        first, last = np.searchsorted(begins[d], low), np.searchsorted(begins[d], high)
        k = last - first
        node = np.repeat(np.arange(len(low)), k)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        begin = begins[d][at]
        following = np.append(begins[d], n)[at + 1]
        return node, flat[start[begin] + d], begin, np.minimum(following, high[node])

    begins: dict[int, np.ndarray] = {}
    alive = np.arange(n)
    low, high = np.array([0]), np.array([n])  # nodes that are active for themselves
    active = {up: tuple(np.zeros(0, np.int64) for _ in range(5)) for up in (0, 1)}
    d = depth
    while len(low) or any(len(x[0]) for x in active.values()):
        alive = alive[size[alive] > d]
        begins[d] = alive[common_[alive] <= d]
        begins.pop(d - 2, None)
        nexts = {0: [], 1: []}
        # pairs at distance one, down equal labels; of kind 1 the second node is one level above the first, and what has just been inserted may not be the label that follows: two such words part further down
        for up, (ul, uh, vl, vh, born) in active.items():
            if not len(ul):
                nexts[up].append((ul, uh, vl, vh, born))
                continue
            du, dv = d, d - up
            ends = (size[ul] == du) & (size[vl] == dv)
            out.extend(zip(ul[ends].tolist(), vl[ends].tolist()))
            a, x, al, ah = children(ul, uh, du)
            b, y, bl, bh = children(vl, vh, dv)
            left, right = a << 21 | x, b << 21 | y
            at = np.searchsorted(right, left)
            hit = np.flatnonzero((np.append(right, -1)[at] == left) & (x != born[a]))
            nexts[up].append((al[hit], ah[hit], bl[at[hit]], bh[at[hit]], np.full(len(hit), -1)))
        # pairs born here
        many = high - low > 1
        node, label, cl, ch = children(low[many], high[many], d)
        nexts[1].append((cl, ch, low[many][node], high[many][node], label))
        first, count = np.unique(node, return_index=True)[1], np.bincount(node)
        count = count[count > 0]
        for k in np.unique(count):
            i, j = np.triu_indices(int(k), 1)
            at = first[count == k]
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            nexts[0].append((cl[i], ch[i], cl[j], ch[j], np.full(len(i), -1)))
        low, high = cl, ch
        d += 1
        for up, found in nexts.items():
            ul, uh, vl, vh, born = (np.concatenate(x) for x in zip(*found))
            single = (uh - ul == 1) & (vh - vl == 1)
            settled(ul[single], vl[single], d, d - up)
            active[up] = tuple(x[~single] for x in (ul, uh, vl, vh, born))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    other = np.flatnonzero(a[:k] != b[:k])
    return int(other[0]) if len(other) else k


def near_below(words: DataFrame) -> DataFrame:
    """(word, near, n) of words (word, n, depth), both ways: pairs that part below their partition's prefix."""
    schema = common.arrow_schema(common.T._parse_datatype_string("word string, near string, n bigint"))

    def run(batches):
        prefix, group = None, []

        def flush():
            names = [w for w, _ in group]
            found = pairs_below(names, len(prefix)) if len(group) > 1 else []
            for k in range(0, len(found), 1 << 14):
                part = found[k : k + (1 << 14)]
                both = [*part, *((j, i) for i, j in part)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in both]), pa.array([names[j] for _, j in both]), pa.array([group[j][1] for _, j in both], pa.int64())], schema=schema)

        for batch in batches:
            for p, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != prefix:
                    yield from flush()
                    prefix, group = p, []
                group.append((w, n))
        yield from flush()

    # sorted by UTF-8 bytes, which is the order of code points
    grouped = words.select(F.expr("substring(word, 1, depth)").alias("prefix"), "word", "n").repartition("prefix").sortWithinPartitions("prefix", "word")
    return grouped.mapInArrow(run, "word string, near string, n bigint")


def near_above(words: DataFrame) -> DataFrame:
    """(word, near, n) of words (word, n, depth), both ways: pairs that part above their partition's prefix.

    A word goes to what is left of it without its code point at each place of the crown, and, as a whole, to itself.
    Of a run of equal code points, only the last counts as inserted, which is where two such words part.
    """
    place = F.explode(F.expr("sequence(-1, least(depth, length(word)) - 1)")).alias("i")
    spread = words.filter("depth > 0").select("word", "n", place)
    key = F.when(F.col("i") < 0, F.col("word")).otherwise(F.expr("concat(substring(word, 1, i), substring(word, i + 2))"))
    last = F.expr("substring(word, i + 1, 1) <> substring(word, i + 2, 1)")
    met = spread.select(key.alias("key"), F.struct("word", "n", "i", last.alias("last")).alias("w")).groupBy("key").agg(F.collect_list("w").alias("ws")).filter(F.size("ws") > 1)
    both = met.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b"))
    replaced = (F.col("a.i") == F.col("b.i")) & (F.col("a.i") >= 0) & (F.col("a.word") != F.col("b.word"))
    other = ((F.col("a.i") < 0) & (F.col("b.i") >= 0) & F.col("b.last")) | ((F.col("b.i") < 0) & (F.col("a.i") >= 0) & F.col("a.last"))
    return both.filter(replaced | other).select("a.word", F.col("b.word").alias("near"), "b.n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): pointers doubled until none moves. A form is at least twice as frequent as its word, so chains are short and end."""
    at = common.stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        higher = at.select(F.col("word").alias("root"), F.col("root").alias("higher")).filter("root <> higher")
        after = common.stored(at.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        common.drop_stored(at)
        at = after.select("word", "root")
        at.stored_at = after.stored_at
        if not after.filter("moved").limit(1).count():
            return at


def variants(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct words (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word
    of largest n (ties: the smallest in code-point order), if that n is at least twice its own; its root is what
    following forms ends at. An empty table gives no rows.
    """
    dealt = common.stored(partitioned(words, subtree), "trie")
    near = near_below(dealt).unionByName(near_above(dealt))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    formed = dealt.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    formed = common.stored(formed.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    chained = followed(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(chained, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of the whole vocabulary of documents. Texts that are null or without a run have no words; rows that repeat count again; other columns than doc_id and text aren't read."""
    return variants(vocabulary(common.load(spark, sf_dir, "documents", "doc_id", "text")))


def _crc_table() -> list[int]:
    """Of the reflected polynomial, for half a byte at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in table]
    return table


OP11_SQL = rf"""
WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x)), lambda i: instr('0123456789ABCDEF', substr(x, (i + 2 - 2 * (i % 2))::BIGINT, 1)) - 1)),
    lambda c, b: xor(c >> 4, {_crc_table()}[(xor(c, b) & 15) + 1])), 4294967295) AS h FROM o),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.key UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.key),
b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM e GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, (SELECT min(e.near) FROM e WHERE e.word = v.word AND e.n = b.top) AS form, b.top AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.top >= 2 * v.n),
g AS (SELECT f.word, f.n, coalesce(c.n_near, 0) AS n_near, f.form, f.form_n FROM f LEFT JOIN b c USING (word)),
p AS (WITH RECURSIVE t AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.root AND g.form IS NOT NULL)
  SELECT t.word, t.root FROM t JOIN g ON g.word = t.root AND g.form IS NULL)
SELECT g.word, g.form, coalesce(p.root, g.word) AS root, g.n, g.n_near, g.form_n FROM g LEFT JOIN p USING (word)
"""
