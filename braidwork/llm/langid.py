"""Language ID in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte n-grams (1 to 4 bytes) of the lower-cased words with a blank at both ends, as square roots of relative
frequencies. Family and pair models are linear SVMs (squared hinge, mini-batch gradient descent with momentum),
trained here on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm import common

#: Languages by family (ISO 639-1); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn mr gu pa ur ne",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIM = 1 << 12
#: Labelled rows for training, about: of each language at most, and of all languages together (each then gets fewer, none is left out).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 30_000
WORDS = re.compile(r"[^\W\d_]+")
ASCII_LETTER = re.compile("[A-Za-z]")
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """A letter by Unicode category (L*): superscripts, fractions and number forms are none."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def with_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def features(text: str, dim: int = DIM) -> np.ndarray:
    """The whole text as a unit vector; texts without a letter are all zeros."""
    data = (" " + " ".join(WORDS.findall(text.lower())) + " ").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dim, np.float32)
    shift = np.uint32(32 - (dim.bit_length() - 1))
    grams = [b * np.uint32(2654435761) >> shift]
    two = b[:-1] << np.uint32(8) | b[1:]
    grams.append((two + np.uint32(0x10000)) * np.uint32(2654435761) >> shift)
    three = two[:-1] << np.uint32(8) | b[2:]
    grams.append((three + np.uint32(0x2000000)) * np.uint32(2246822519) >> shift)
    if len(b) > 3:
        four = three[:-1] << np.uint32(8) | b[3:]
        grams.append((four ^ four >> np.uint32(15)) * np.uint32(3266489917) >> shift)
    counts = np.zeros(dim, np.float32)
    for g in grams:
        counts += np.bincount(g, minlength=dim)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def linear_svm(x: np.ndarray, y: np.ndarray, weights: np.ndarray, reg: float = 1e-5, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """y in -1, 1. Squared hinge loss."""
    rng = np.random.RandomState(seed)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    n, batch = len(y), 128
    for epoch in range(epochs):
        rate = 1.0 / (1 + 0.2 * epoch)
        order = rng.permutation(n)
        for i in range(0, n, batch):
            k = order[i : i + batch]
            slack = np.maximum(0, 1 - y[k] * (x[k] @ w + b)) * y[k] * weights[k]
            vw = 0.8 * vw + x[k].T @ slack / len(k) - reg * w
            vb = 0.8 * vb + float(slack.mean())
            w += rate * vw
            b += rate * vb
    return w, float(b)


class Model:
    """families: name -> sorted languages; family_w: one-versus-rest planes; pair_w: (a, b) -> plane, positive for a."""

    def __init__(self, families, family_w, pair_w):
        self.families, self.family_w, self.pair_w = families, family_w, pair_w
        self.names = sorted(families)
        self.planes, self.bias, self.at = [], [], {}
        for key, (w, b) in list(family_w.items()) + list(pair_w.items()):
            self.at[key] = len(self.planes)
            self.planes.append(w)
            self.bias.append(b)
        self.matrix = np.stack(self.planes, 1) if self.planes else np.zeros((DIM, 0), np.float32)
        self.bias = np.array(self.bias, np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        rows = [features(t) if has_letter(t) else None for t in texts]
        margins = {}
        good = [i for i, r in enumerate(rows) if r is not None]
        if good:
            m = np.stack([rows[i] for i in good]) @ self.matrix + self.bias
            margins = dict(zip(good, m))
        sure = lambda z: 1 / (1 + np.exp(-np.clip(4 * z, -30, 30)))
        for i in range(len(texts)):
            if i not in margins or not self.names:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            z = margins[i]
            family, p = self.names[0], 1.0
            if len(self.names) > 1:
                own = np.array([z[self.at[f]] for f in self.names])
                best = int(own.argmax())
                family = self.names[best]
                p = float(sure(own[best] - np.delete(own, best).max()))
            members = self.families[family]
            votes = {a: 0 for a in members}
            ties = {a: 0.0 for a in members}
            for j, a in enumerate(members):
                for b in members[j + 1 :]:
                    v = float(z[self.at[(a, b)]])
                    votes[a if v >= 0 else b] += 1
                    ties[a] += v
                    ties[b] -= v
            top = max(members, key=lambda a: (votes[a], ties[a]))
            for b in members:
                if b != top:
                    v = float(z[self.at[(top, b)]]) if (top, b) in self.at else -float(z[self.at[(b, top)]])
                    p = min(p, float(sure(v)))
            langs.append(top)
            scores.append(p)
        return langs, scores


def fit(x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF) -> Model:
    """x: a row of features() for each language in langs."""
    lang = np.array(langs)
    family = np.array([family_of.get(a, a) for a in langs])
    families = {f: sorted(str(a) for a in set(lang[family == f])) for f in sorted(map(str, set(family)))}

    def plane(rows: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
        y = np.where(positive, 1.0, -1.0).astype(np.float32)
        share = np.where(positive, 0.5 / max(positive.mean(), 1e-9), 0.5 / max(1 - positive.mean(), 1e-9)).astype(np.float32)
        return linear_svm(rows, y, share)

    family_w = {f: plane(x, family == f) for f in families} if len(families) > 1 else {}
    pair_w = {}
    for members in families.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                k = (lang == a) | (lang == b)
                pair_w[(a, b)] = plane(x[k], lang[k] == a)
    return Model(families, family_w, pair_w)


def sample(labelled: DataFrame, per_language: int, rows: int) -> DataFrame:
    """(doc_id, text, lang): about per_language rows of each language at most, fewer where all languages would come to more than `rows`; chosen by a hash of the id and text, and of every language at least the row with the least hash."""
    picked = labelled.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    sizes = picked.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    sizes = sizes.withColumn("languages", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row per language
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(float(per_language)), F.lit(float(rows)) / F.col("languages")))
    chosen = picked.select("doc_id", "h", "lang").join(sizes, "lang").filter((F.col("h") == F.col("least")) | (F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < wanted / F.col("n")))
    # bounded by `rows` and the number of languages: a semi-join without a shuffle of texts
    return picked.join(F.broadcast(chosen.select("doc_id", "h", "lang")), ["doc_id", "h", "lang"], "left_semi").select("doc_id", "text", "lang")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, holdout: bool = True, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows with an id, a text that has a letter and a lang; with holdout, not from rows whose crc32(doc_id) mod 4 is 2.

    Every language is learned. Tasks make the features, so of each sampled row DIM numbers reach the driver. Rows
    that repeat count as often as they are there. Without such rows the model knows no language.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & with_letter(F.col("text")))
    if holdout:
        known = known.filter(common.id_crc() % 4 != 2)

    def make():
        return lambda rows: {"lang": rows["lang"], "x": [features(t).astype("<f2").tobytes() for t in rows["text"]]}

    found = [(r["lang"], r["x"]) for r in common.map_rows(sample(known, per_language, rows).select("text", "lang"), make, "lang string, x binary").toLocalIterator()]
    found.sort()  # the same order for the same rows: training is repeatable
    x = np.frombuffer(b"".join(v for _, v in found), "<f2").reshape(-1, DIM).astype(np.float32)
    return fit(x, [a for a, _ in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text), from the whole text alone.

    Texts that are null, empty or have no letter are 'und' with score 0, as are all if nothing was learned. Rows
    that repeat a doc_id, and those with a null one, get a row each; an empty table gives none. Other columns are
    not read. One pass, no shuffle.
    """
    return predicted(docs, model).select("doc_id", "lang_pred", "score")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, lang_pred, score) and the other columns of docs packed, whatever their names and types."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def each(rows):
            langs, scores = model.predict(rows["text"])
            return {"lang_pred": langs, "score": scores}

        return each

    return common.map_rows(common.packed(docs, "doc_id", "text"), make, "lang_pred string, score double", keep=("doc_id", "text", common.REST), read=("text",))


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (common.id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")
