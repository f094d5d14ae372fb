"""Token ids in a binary format: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

Ids are replaced by their ranks (most frequent first). A rank takes 1 to 4 bytes; its length less 1 is two bits of
a control byte, four ids to a byte, and control bytes stand apart from data bytes, so a decoder looks the control
bytes up in a table of lengths and gathers all data with numpy. A file is a sequence of blocks, each with whole
documents, and ends as Spark's text writer ends it, with the separator after each block:

    magic "BWTK", version, number of documents, of ids, of data bytes, of ids before the block (little-endian 64-bit)
    doc ids (64-bit), ids per document (64-bit), control bytes, data bytes, crc32 of all before it (32-bit)

Files hold ascending ranges of doc_id; the order of their names is the order of the documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import common

MAGIC, VERSION, SEPARATOR = b"BWTK", 2, "\n"
HEAD = struct.Struct("<4sIQQQQ")
END_ID = 2
#: Ids of a block, about: a document of more has a block of its own.
BLOCK_IDS = 1 << 18
#: Blocks of a file at most: about 64 MB, since an id takes two bytes or less on average.
FILE_BLOCKS = 128
#: Words, and pre-tokens, that a worker remembers, about 700 bytes each; once full, others are encoded each time.
REMEMBERED = 1_200_000
#: Documents that are encoded together: each batch meets the memory once per distinct word.
BATCH_DOCS = 1024
#: Chunks are cut at these only: whatever else counts as white space is left to the tokenizer.
CUT = re.compile(r"[ \t\r\n]+")
#: Lengths of the four ranks of each control byte, and their offsets in the data.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks under 2**32."""
    r = ranks.astype("<u4")
    length = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    four = r.view(np.uint8).reshape(-1, 4)
    data = four[np.arange(4) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Table lookup of lengths, then a gather per byte place."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(length)
    start = end - length
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for place in range(4):
        has = length > place
        out[has] |= d[start[has] + place] << np.uint32(8 * place)
    return out


def write_block(doc_ids: list[int], sizes: list[int], ranks: np.ndarray, before: int = 0) -> bytes:
    control, data = encode_ranks(ranks)
    out = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ranks), len(data), before) + np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + control + data
    return out + struct.pack("<I", zlib.crc32(out))


def read_blocks(content: bytes):
    """(doc ids, ids per document, ranks, ids before) of each block of a file; ValueError where a check sum doesn't hold."""
    at = 0
    while at < len(content):
        magic, version, docs, n, size, before = HEAD.unpack_from(content, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"no block at byte {at}")
        a = at + HEAD.size
        b = a + 8 * docs
        c = b + 8 * docs
        d = c + -(-n // 4)
        end = d + size
        if zlib.crc32(content[at:end]) != struct.unpack_from("<I", content, end)[0]:
            raise ValueError(f"the block at byte {at} is damaged")
        yield np.frombuffer(content[a:b], "<i8"), np.frombuffer(content[b:c], "<i8"), decode_ranks(content[c:d], content[d:end], n), before
        at = end + 4 + len(SEPARATOR)


#: Texts without these are cut into pre-tokens here; others only at blanks, and the tokenizer does the rest.
NOT_PLAIN = r"[^\t\n\r -~\x{a1}-\x{ff}]"
#: The pre-token pattern of CLIP-like vocabularies, in terms of lower-case Latin-1 text.
CLIP_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKEN = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\r a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def byte_letters() -> dict[int, str]:
    """Characters from 128 to 255 as the byte-level letters of their UTF-8 bytes: printable bytes are themselves, the n-th other byte is the letter 256 + n."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class Encoder:
    """Whole texts to ids. With the one pre-token pattern known here, whose pre-tokens never hold a blank, words and pre-tokens are remembered; with any other tokenizer whole texts go through it."""

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.bare = None
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}
        parts = json.loads(definition)
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = any(x.get("type") == "Lowercase" for x in (parts.get("normalizer") or {}).get("normalizers") or [])
        self.plain = lower and (steps[0].get("pattern") or {}).get("Regex") == CLIP_SPLIT
        self.special = [x["content"] for x in parts.get("added_tokens") or []]

        #: Which ids end a pre-token: with such a suffix, many pre-tokens are encoded as one text and told apart again.
        suffix = (parts.get("model") or {}).get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix and self.plain:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

            # pre-tokens are lower-case Latin-1 by then: the model alone, on their bytes as byte-level letters, gives the same ids
            if all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in steps[1:]) and len(steps) == 2:
                self.bare = Tokenizer(self.tokenizer.model)
                self.bare.pre_tokenizer = CharDelimiterSplit(" ")
                self.letters = byte_letters()

    def _learn(self, pieces: list[str], whole: bool) -> list[bytes]:
        """Ids of each piece; whole: each is one pre-token."""
        if whole:
            text, by = (" ".join(pieces), self.tokenizer) if self.bare is None else (" ".join([p if p.isascii() else p.translate(self.letters) for p in pieces]), self.bare)
            ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(pieces) and (not len(at) or at[-1] == len(ids)):
                data, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
                return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of strings, one text after the other, and the number of ids of each text (0 for a null).

        Words are cut and numbered by Arrow, so Python sees a distinct word of the column once.
        """
        known = self.known  # a pre-token is the word of itself alone
        texts = pc.fill_null(texts, "")
        if not self.plain:
            held = self._learn(texts.to_pylist(), False)
            return np.frombuffer(b"".join(held), "<u4"), np.array([len(x) // 4 for x in held], np.int64)
        odd = np.array(pc.match_substring_regex(texts, NOT_PLAIN))
        for x in self.special:
            odd |= np.array(pc.match_substring(texts, x))
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        cut = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = list(map(known.get, words))
        new = [i for i, ids in enumerate(own) if ids is None]
        parts = [PRE_TOKEN.findall(words[i]) for i in new]
        pieces = list({c for part in parts for c in part if c not in known})
        learned = {}
        for i in range(0, len(pieces), 20_000):
            some = pieces[i : i + 20_000]
            learned.update(zip(some, self._learn(some, True)))
        for i, part in zip(new, parts):
            own[i] = b"".join([learned[c] if c in learned else known[c] for c in part])
        if len(known) < self.remembered:
            known.update(learned)
            known.update((words[i], own[i]) for i in new)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(own), "<u4")
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)] if len(flat) else np.zeros(0, "<u4")
        places = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        before = np.concatenate([[0], ends])[places]
        counts = np.diff(before)
        if odd.any():
            held = [ids[a:b] for a, b in zip(before, before[1:])]
            for i in np.flatnonzero(odd):
                chunks = [c for c in CUT.split(texts[int(i)].as_py()) if c]
                held[i] = np.frombuffer(b"".join(self._learn(chunks, False)), "<u4")
            ids, counts = np.concatenate(held), np.array([len(x) for x in held])
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        at = np.concatenate([[0], np.cumsum(counts)])
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(definition: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process, so what it remembers outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = definition, remembered
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, remembered)
    return _encoders[key]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n, ids, counts): a row with the ids of the whole text (a null is empty) and end_id for every row of docs, and a row with the counts of all ids for each task.

    Ids are 16-bit integers where the vocabulary allows and 32-bit ones else; counts are 64-bit, one per id.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    schema = "doc_id bigint, n bigint, ids binary, counts binary"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))
    width = np.dtype(kind).itemsize

    def run(batches):
        encoder = encoder_of(sent.value, remembered)
        total = np.zeros(size, np.int64)
        for batch in common.pieces(batches, BATCH_DOCS):
            ids, counts = encoder.encode_column(batch.column(1))
            total += np.bincount(ids, minlength=size)
            total[end_id] += len(counts)
            ends = np.cumsum(counts)
            data = np.insert(ids.astype(kind), ends, end_id)
            at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
            cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1), cells, pa.nulls(len(ends), pa.binary())], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=arrow)

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    out.kind, out.size = kind, size
    return out


def ranking(tokens: DataFrame, size: int) -> np.ndarray:
    """Ids by descending count over all documents (ties by id): one number per id of the vocabulary reaches the driver."""
    arrow = common.arrow_schema(common.T._parse_datatype_string("id bigint, n bigint"))

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.frombuffer(cell.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow)

    count = np.zeros(size, np.int64)
    counts = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id bigint, n bigint")
    for r in counts.groupBy("id").agg(F.sum("n")).toLocalIterator():
        count[r[0]] = r[1]
    return np.lexsort((np.arange(size), -count)).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, remembered: int = REMEMBERED) -> None:
    """Tokenizes docs (doc_id, text) and writes the files to path/blocks in ascending doc_id order: a task per range of ids, FILE_BLOCKS blocks a file. The id of each rank goes to path/ranks, a row per id of the vocabulary; the two are all that a reader needs."""
    spark = docs.sparkSession
    made = tokenize(docs, vocabulary, end_id, remembered)
    kind, size = made.kind, made.size
    held_at = common.scratch_path(spark, "ids")
    made.write.option("compression", "zstd").parquet(held_at)
    tokens = spark.read.schema(made.schema).parquet(held_at)
    id_of = ranking(tokens, size)
    common.local_table(spark, list(enumerate(id_of.tolist())), "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    tokens = tokens.filter("ids IS NOT NULL").select("doc_id", "n", "ids")
    rank_of = np.empty(size, np.uint32)
    rank_of[id_of] = np.arange(size, dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)
    at = common.cuts(tokens, "doc_id", common.parts_of(spark))
    parts = tokens.withColumn("part", common.range_index(F.col("doc_id"), at))
    sums = parts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per range
    before, total = {}, 0
    for r in sums:
        before[r["part"]] = total
        total += r["n"]
    starts = spark.sparkContext.broadcast(before)
    arrow = pa.schema([pa.field("part", pa.int64()), pa.field("block", pa.binary())])

    def run(batches):
        rank = sent.value
        part, ids, sizes, held, n, at = None, [], [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([write_block(ids, sizes, rank[np.concatenate(held)], at)], pa.binary())], schema=arrow)

        for batch in common.pieces(batches, BATCH_DOCS):
            for p, doc_id, cell in zip(*(batch.column(i) for i in range(3))):
                p, doc_id, own = p.as_py(), doc_id.as_py(), np.frombuffer(cell.as_py(), kind)
                if ids and (p != part or n + len(own) > BLOCK_IDS):
                    yield block()
                    at += n
                    ids, sizes, held, n = [], [], [], 0
                if p != part:
                    part, at = p, starts.value[p]
                ids.append(NO_ID if doc_id is None else doc_id)
                sizes.append(len(own))
                held.append(own)
                n += len(own)
        if ids:
            yield block()

    # ranges are numbered in order, and a range's number is its partition's, so files ascend
    dealt = parts.select("part", "doc_id", "ids").repartitionById(len(at) + 1, "part").sortWithinPartitions("part", "doc_id")
    blocks = dealt.mapInArrow(run, "part bigint, block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")
    common.discard(spark, held_at)


#: Stands for a null doc_id in files.
NO_ID = -(1 << 63)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (BINARY, little-endian 32-bit) of every document in the files under path, written by any session."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # a row per id of the vocabulary
    table = np.empty(len(ranks), np.uint32)
    for r in ranks:
        table[r["rank"]] = r["id"]
    sent = spark.sparkContext.broadcast(table)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))

    def run(batches):
        id_of = sent.value
        for batch in batches:
            for cell in batch.column(0):
                for doc_ids, sizes, ranks, start in read_blocks(cell.as_py()):
                    ids = id_of[ranks].astype("<u4")
                    out, at = [], 0
                    for doc_id, n in zip(doc_ids.tolist(), sizes.tolist()):
                        own = ids[at : at + n].tobytes()
                        out.append((None if doc_id == NO_ID else doc_id, start + at, n, zlib.crc32(own), own))
                        at += n
                    for i in range(0, len(out), common.BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + common.BATCH_ROWS]), arrow)], schema=arrow)

    return spark.read.format("binaryFile").load(f"{path}/blocks").select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """Writes docs and reads the files back: doc_id, start, n_tokens, ids_crc32 and ids of every row.

    A null or empty text is the end id alone. Null doc_ids come first. Rows that repeat a doc_id are each written,
    in any order among themselves. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = common.scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary or public_vocabulary(), end_id, remembered)
    return read_tokens(spark, path)


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.load(spark, sf_dir, "documents", "doc_id", "text")).drop("ids")
