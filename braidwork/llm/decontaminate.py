"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is over words. Streaming a document through it gives, at each word, the length of the longest
suffix that occurs in some item. Where that is a window's length or more, the window's words are hit; items
shorter than a window are found as marked states on the chain of suffix links.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

#: Bytes of a word: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Words of the items in one automaton. More items make further blocks, and a pass over all documents for each block: one automaton is alive at a time, on the driver and in each worker.
BLOCK_WORDS = 400_000


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only. A null has no words."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Generalised suffix automaton of items (id, words). items_at[state]: items with the window that ends there; short[state]: (length, item) of items shorter than a window."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        items = [(i, w) for i, w in items if w]
        for _, seq in items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.items_at: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, seq in items:
            for end, state, length in self._walk(seq):
                if length >= window:
                    self.items_at.setdefault(self._suffix_state(state, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(self._suffix_state(state, len(seq)), []).append((len(seq), item))
        #: The nearest state up the chain of links, the state itself included, that has short items.
        self.mark = [-1] * len(self.next)
        if self.short:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.mark[s] = s if s in self.short else self.mark[self.link[s]]

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def _suffix_state(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _walk(self, seq: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, state, longest match that ends there) for each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for end, word in enumerate(seq, 1):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(word)
            if to is not None:
                state = to
                n += 1
            yield end, state, n

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end), merged and ascending, and the items with occurring windows."""
        nxt, link, length, window, mark = self.next, self.link, self.length, self.window, self.mark
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = n = 0
        marked = bool(self.short)
        for end, word in enumerate(seq, 1):
            to = nxt[state].get(word)
            if to is None:
                while state:
                    state = link[state]
                    to = nxt[state].get(word)
                    if to is not None:
                        n = length[state] + 1
                        state = to
                        break
                else:
                    n = 0
                    to = root.get(word)
                    if to is not None:
                        state, n = to, 1
            else:
                state = to
                n += 1
            hit = 0
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items_at[at]
                hit = window
            if marked and n:
                s = mark[state]
                while s > 0:
                    for size, item in self.short[s]:
                        if size <= n:
                            found.add(item)
                            hit = max(hit, size)
                    s = mark[link[s]]
            if hit:
                start = end - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        return spans, found


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items as lists of at most block_words words (or of one item), streamed to the driver partition by partition."""
    block, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        seq = words(text)
        if block and n + len(seq) > block_words:
            yield block
            block, n = [], 0
        if seq:
            block.append((item, seq))
            n += len(seq)
    if block:
        yield block


_automata: dict[str, Automaton] = {}


def automaton_of(key: str, block: list[tuple[int, list[bytes]]], window: int) -> Automaton:
    """One for each worker process, so it outlives a task; the one of another block goes."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(block, window)
    return _automata[key]


FOUND = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>"
CLEAN = ", clean string"


def scan_block(rows: DataFrame, block: list[tuple[int, list[bytes]]], window: int, keep: tuple[str, ...], cut: bool = False) -> DataFrame:
    """FOUND and the columns in keep for every row of rows (text, …): hit word spans and items of one block; with cut also `clean`, the text without the spans. The broadcast holds at most BLOCK_WORDS words, or one item."""
    sent, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def make():
        automaton = automaton_of(key, sent.value, window)

        def each(rows):
            out = {k: [] for k in ("n_words", "starts", "ends", "items", "clean")}
            for text in rows["text"]:
                seq = words(text)
                spans, found = automaton.scan(seq)
                add(out, text, len(seq), spans, found, cut)
            return out

        return each

    return common.map_rows(rows, make, FOUND + CLEAN * cut, keep=keep, read=("text",))


def add(out: dict[str, list], text: str | None, n_words: int, spans: list[tuple[int, int]], items: Iterable[int], cut: bool) -> None:
    out["n_words"].append(n_words)
    out["starts"].append([a for a, _ in spans])
    out["ends"].append([b for _, b in spans])
    out["items"].append(sorted(items))
    if cut:
        out["clean"].append(without(text, spans) if spans else text)


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """doc_id, text, n_words, starts and ends (hit word spans), items, and the other columns of docs packed, for every row of docs; with cut, `clean` (the text without the spans, made in the same pass) in place of text.

    A null or empty text has no words; items without words are never found; with an empty benchmark nothing is
    hit; rows that repeat an id, and those with a null one, get a row each. One block of items takes one pass without
    a shuffle. More blocks take a pass each, which writes the spans of the texts that it hits; these meet the
    documents by the hash of the text.
    """
    rows = common.packed(docs, "doc_id", "text")
    keep = ("doc_id", common.REST) if cut else ("doc_id", "text", common.REST)
    blocks = item_blocks(benchmark, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return scan_block(rows, first, window, keep, cut)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts, hits = rows.select("text", digest.alias("h")), []
    for block in itertools.chain([first, second], blocks):
        hits.append(common.stored(scan_block(texts, block, window, ("h",)).filter("size(items) > 0").select("h", "starts", "ends", "items"), "hits").dropDuplicates(["h"]))
    every = functools.reduce(DataFrame.unionByName, hits).groupBy("h").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("starts", "ends", "items")))
    # word counts, and the union of spans, without an automaton
    joined = rows.withColumn("h", digest).join(every, "h", "left").select("doc_id", "text", common.REST, *(F.col(x).alias(f"all_{x}") for x in ("starts", "ends", "items")))

    def make():
        def each(rows):
            out = {k: [] for k in ("n_words", "starts", "ends", "items", "clean")}
            for text, a, b, items in zip(rows["text"], rows["all_starts"], rows["all_ends"], rows["all_items"]):
                add(out, text, len(words(text)), merged(sorted(zip(a or [], b or []))), set(items or []), cut)
            return out

        return each

    return common.map_rows(joined, make, FOUND + CLEAN * cut, keep=keep, read=("text", "all_starts", "all_ends", "all_items"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the characters of the word spans."""
    data = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in WORD.finditer(data.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs; see scan_documents."""
    found = scan_documents(docs, benchmark, window)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    n_hit = total(F.col("ends")) - total(F.col("starts"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, max_words: int | None = None) -> DataFrame:
    """docs without test passages, columns as in docs, of any name and type: hit spans are cut out of the texts; documents of which more than max_share of the words, or more than max_words words, are hit go.

    n_chars, where there is such a column, follows the text. Null and empty texts stay as they are; repeated rows and
    null ids are treated like any others; an empty table gives none.
    """
    found = scan_documents(docs, benchmark, window, cut=True)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rule = hit <= F.col("n_words") * F.lit(max_share)
    if max_words is not None:
        rule &= hit <= max_words
    own = {"doc_id": F.col("doc_id"), "text": F.col("clean")}
    if "n_chars" in docs.columns:
        given = F.col(common.REST).getField("n_chars")
        own["n_chars"] = F.when(F.size("starts") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(given)
    return common.unpacked(found.filter(rule), docs.columns, own)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(common.load(spark, sf_dir, "documents", "doc_id", "text"), common.load(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dg.k FROM dg JOIN g ON dg.g = g.g AND dg.k = g.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
