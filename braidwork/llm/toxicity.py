"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of words from a lexicon that is learned from labels (words far more frequent
in toxic rows), how near they stand to second-person words, capitals, punctuation, obfuscated spellings, length.
The training rows fall into three folds by a hash of the text: lexicon, trees, calibration. All are bounded
samples; scoring runs over all rows in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

#: Second-person words of the languages that the engine learns most often.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros vuestro".split())
#: Signs that stand for letters in obfuscated spellings.
LOOKALIKE = str.maketrans("@4013$57!8", "aaoiesstib")
#: Bounds of the three training samples, rows.
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS = 15_000, 9_000, 6_000
#: A lexicon word is in at least so many toxic rows, and its share of toxic rows is so many times its share of the others; the model holds so many words at most, those of most weight.
LEXICON_MIN_ROWS, LEXICON_RATIO, LEXICON_SIZE = 3, 12.0, 4000
NEAR = 5
WORD = re.compile(r"[^\W\d_]+")
#: Signs or digits between letters, and the word around them.
INSIDE = re.compile(r"(?<=[^\W\d_])[@$!*0134578]+(?=[^\W\d_])")
SHOUT = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
UPPER = bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "_")
FEATURES = ("hits", "hit_density", "distinct_hits", "weight_density", "weight_max", "near_second_person", "second_person", "capitals", "shouts", "exclamations", "punctuation", "obfuscated", "log_words")


def plain(word: str) -> str:
    """Look-alike signs as letters."""
    return word.translate(LOOKALIKE).replace("*", "")


def obfuscated(lower: str) -> list[str]:
    """Words with signs or digits between their letters."""
    out, last = [], -1
    for m in INSIDE.finditer(lower):
        if m.start() < last:
            continue
        a, b = m.start(), m.end()
        while a and (lower[a - 1].isalpha() or lower[a - 1] in "@$!*0134578"):
            a -= 1
        while b < len(lower) and (lower[b].isalpha() or lower[b] in "@$!*0134578"):
            b += 1
        out.append(lower[a:b])
        last = b
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Of the whole text; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    lower = text.lower()
    words = WORD.findall(lower)
    n = len(words) or 1
    at = [i for i, w in enumerate(words) if w in lexicon]
    found = [words[i] for i in at]
    odd = obfuscated(lower)
    found += [w for w in map(plain, odd) if w in lexicon]
    weights = [lexicon[w] for w in found]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if at and second:
        s = np.array(second)
        k = np.searchsorted(s, at)
        gap = np.minimum(np.abs(s[np.minimum(k, len(s) - 1)] - at), np.abs(s[np.maximum(k - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    return [
        float(len(found)),
        len(found) / n,
        float(len(set(found))),
        sum(weights) / n,
        max(weights, default=0.0),
        near / n,
        len(second) / n,
        (size - len(data.translate(None, UPPER))) / size,
        len(SHOUT.findall(text)) / n,
        (data.count(b"!") + data.count(b"?")) / n,
        (size - len(data.translate(None, MARKS))) / size,
        len(odd) / n,
        float(np.log1p(len(words))),
    ]


def words_of(text: str) -> set[str]:
    """Distinct words of a text, obfuscated ones as they are meant."""
    lower = text.lower()
    return {*WORD.findall(lower), *map(plain, obfuscated(lower))}


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words of rows (text, toxic) by the log of how much larger their share of toxic rows is. Equal texts of a label count once. Counted on Spark: at most `size` words reach the driver."""

    def run(batches):
        for batch in common.pieces(batches):
            found = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
            toxic = np.repeat(np.array(batch.column(1).to_pylist(), np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.string()), pa.array(toxic)], names=["word", "toxic"])

    rows = rows.select("text", F.col("toxic").cast("bigint").alias("toxic")).dropDuplicates(["text", "toxic"])
    n = rows.agg(F.sum("toxic"), F.count("*") - F.sum("toxic")).first()
    toxic_rows, clean_rows = n[0] or 0, n[1] or 0
    counts = rows.mapInArrow(run, "word string, toxic bigint").groupBy("word").agg(F.sum("toxic").alias("k"), (F.count("*") - F.sum("toxic")).alias("others"))
    ratio = ((F.col("k") + 0.5) / (toxic_rows + 1)) / ((F.col("others") + 0.5) / (clean_rows + 1))
    known = counts.filter((F.col("k") >= LEXICON_MIN_ROWS) & (ratio >= LEXICON_RATIO)).select("word", F.log(ratio).alias("weight"), "k")
    best = known.orderBy(F.desc(F.col("k") * F.col("weight")), "word").limit(size)
    return {r["word"]: r["weight"] for r in best.collect()}


@dataclass
class Trees:
    """Boosted regression trees on binned features, as arrays of (feature, bin, left, right, value)."""

    edges: list[np.ndarray]
    base: float
    trees: list[list[tuple[int, int, int, int, float]]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree))
            node = np.zeros(len(x), int)
            for _ in range(8):
                leaf = left[node] < 0
                if leaf.all():
                    break
                goes = b[np.arange(len(x)), feature[node]] <= cut[node]
                node = np.where(leaf, node, np.where(goes, left[node], right[node]))
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: float = 0.0, l2: float = 1.0, bins: int = 64) -> Trees:
    """Logistic loss, second-order gains on histograms. A leaf holds at least `least` rows: by default one in 200 rows, 2 to 20."""
    least = least or min(20.0, max(2.0, len(y) / 200))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    trees = []
    for _ in range(rounds if len(y) else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        tree: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.append([0, 0, -1, -1, float(-rate * gs / (hs + l2))])
            best = (1e-6, 0, 0)
            if level < depth and len(rows) >= 2 * least:
                for j in range(b.shape[1]):
                    n = len(edges[j]) + 1
                    if n < 2:
                        continue
                    cg = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                    ch = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                    cn = np.cumsum(np.bincount(b[rows, j], minlength=n))[:-1]
                    gain = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
                    gain[(cn < least) | (len(rows) - cn < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[0] > 1e-6:
                _, j, k = best
                goes = b[rows, j] <= k
                left, right = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
                tree[at][:4] = [j, k, left, right]
            else:
                margin[rows] += tree[at][4]
            return at

        grow(np.arange(len(y)), 0)
        trees.append([tuple(t) for t in tree])
    return Trees(edges, base, trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins (ascending) and non-decreasing probabilities, with one imagined row of each label at the ends."""
    order = np.argsort(margin, kind="stable")
    m = np.concatenate([[margin[order[0]] if len(order) else 0.0], margin[order], [margin[order[-1]] if len(order) else 0.0]])
    v = np.concatenate([[0.0], y[order], [1.0]])
    stack: list[list[float]] = []  # sum, rows, first margin, last margin
    for a, b in zip(m, v):
        stack.append([float(b), 1.0, float(a), float(a)])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s, n, _, last = stack.pop()
            stack[-1][0] += s
            stack[-1][1] += n
            stack[-1][3] = last
    xs, ps = [], []
    for s, n, first, last in stack:
        xs += [first, last]
        ps += [s / n, s / n]
    return np.array(xs), np.array(ps)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        m = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        xs, ps = self.knots
        return np.clip(np.interp(m, xs, ps), 0, 1).tolist()


def fit(rows: DataFrame, lexicon_size: int = LEXICON_SIZE) -> Model:
    """rows (text, toxic, fold); the fold is 0 for the lexicon, 1 for the trees, 2 for calibration. Tasks make the features, so of a row a few numbers reach the driver."""
    lexicon = learn_lexicon(rows.filter("fold = 0"), lexicon_size)

    def make():
        return lambda x: {"x": [features(t, lexicon) for t in x["text"]]}

    found = sorted((r["fold"], r["toxic"], *r["x"]) for r in common.map_rows(rows.filter("fold > 0").select("fold", "toxic", "text"), make, "x array<double>", keep=("fold", "toxic"), read=("text",)).toLocalIterator())
    table = np.array(found, float).reshape(-1, 2 + len(FEATURES))
    part = [table[table[:, 0] == k] for k in (1, 2)]
    trees = boost(part[0][:, 2:], part[0][:, 1])
    return Model(lexicon, trees, isotonic(trees.margin(part[1][:, 2:]), part[1][:, 1]))


def train(docs: DataFrame, labels: DataFrame, holdout: bool = True, rows: tuple[int, int, int] = (LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS), lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learns from rows with a text and a toxic label of 0 or 1 (of a doc_id with both, 1); with holdout, not from rows whose crc32(doc_id) mod 5 is 0.

    About as many rows as `rows` says are taken for lexicon, trees and calibration, chosen by a hash of the id; the
    fold follows from the text, so equal texts share one. Null ids are not used.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if holdout:
        known = known.filter(common.id_crc() % 5 != 0)
    share = min(1.0, sum(rows) / max(known.count(), 1))
    ids = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52) < F.lit(share)))  # at most about sum(rows) rows
    cuts = [sum(rows[:i]) / sum(rows) for i in (1, 2)]
    place = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(1 << 40)) / float(1 << 40)
    fold = F.when(place < cuts[0], 0).when(place < cuts[1], 1).otherwise(2)
    return fit(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(ids, "doc_id").select("text", "toxic", fold.alias("fold")), lexicon_size)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of docs, from the whole text; null and empty texts are scored as zeros. Rows that repeat a doc_id, and those with a null one, get a row each; an empty table gives none; other columns are not read. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def each(rows):
            s = model.score(rows["text"])
            return {"doc_id": rows["doc_id"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

        return each

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, common.load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (common.id_crc() % 5 == 0).alias("held_out"), "score", "predicted")
