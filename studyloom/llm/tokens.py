"""Token ids of whole texts, their canonical Huffman file format, and its reader.

Format: a folder with two Parquet tables. `codebook` has (token_id, bits): the length of each id's canonical code, at
most 16. `blocks` has a row per block of whole documents, in ascending doc_id order by (shard, first_token): also n, doc_ids,
n_tokens, checkpoints, payload. payload is the bit stream, first bit highest; checkpoints are the bit offsets of every
256th id, so a block decodes on its own and its checkpoints decode side by side. The bytes ride in Parquet so that any
store Spark writes to, and its commit protocol, hold them.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, few_texts, remove, shared_path

END_ID, MAX_BITS, LANE, BLOCK = 2, 16, 256, 65_536
SLICE, CACHED, HELD = 1_000_000, 400_000, 200_000
#: ASCII marks; a run of them behind letters, at a word's end, is a piece of its own.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
MARK_BYTES = MARKS.encode()

PLAIN = "shard int, at long, doc_id long, width int, ids binary"


@lru_cache(maxsize=1)
def unsound_letters() -> frozenset[str]:
    """Letters that, as the tokenizer sees them (composed by NFC, then lower-cased), are no longer letters only: a combining mark
    that comes out (of U+0130, or of a letter that doesn't compose) joins with the marks behind it."""
    blocks = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000))  # ideographs and Hangul syllables between stay what they are
    every = (c for lo, hi in blocks for c in map(chr, range(lo, hi)) if c.isalpha())
    return frozenset(c for c in every if not all(x.isalpha() for x in unicodedata.normalize("NFC", c).lower()))


class WordTokenizer:
    """Encodes texts word by word with a cache; for tokenizers whose pieces never cross ASCII white space and that
    lower-case their input (so A-Z can be lowered before, but for texts that may hold a special token)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # one small value of a large file, which parsing would hold whole
            found = re.search(r'"end_of_word_suffix"\s*:\s*"([^"]*)"', f.read())
        suffix = found.group(1) if found else ""
        size = self.model.get_vocab_size()
        # The ids that end a word.
        self.last = np.fromiter((bool(suffix) and (self.model.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the words that were met first, which are the common ones."""
        self.index = {w: k for w, k in self.index.items() if k < HELD}
        self.starts, self.lengths = self.starts[:HELD], self.lengths[:HELD]
        self.flat = self.flat[: int(self.starts[-1] + self.lengths[-1])]

    def learn(self, words: list[bytes]) -> None:
        """Hold the ids of the words, none of which is held. Those of letters only are encoded many at a time, as each ends at its end-of-word id;
        those of letters with marks behind are put together from the ids of both; the others are encoded one by one."""
        plain, others, halves, ended = [], [], [], []
        index, unsound = self.index, unsound_letters()
        for w in words:
            letters = w.rstrip(MARK_BYTES)
            if not letters.isalpha():  # not ASCII letters only
                text = letters.decode("utf-8", "replace")
                if not (text.isalpha() and unsound.isdisjoint(text)):
                    others.append(w)
                    continue
            if len(letters) == len(w):
                plain.append(w)
            else:
                ended.append(w)
                halves += (letters, w[len(letters) :])
        new = {h for h in halves if h not in index}
        plain = list(dict.fromkeys([*plain, *(h for h in new if h[:1] not in MARK_BYTES)]))
        others = list(dict.fromkeys([*others, *(h for h in new if h[:1] in MARK_BYTES)]))
        spans = [x.ids for x in self._encoded([b" ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)])]
        flat = np.fromiter(chain.from_iterable(spans), np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(plain):
            self._add(plain, flat, np.diff(ends, prepend=0))
        else:
            others = list(dict.fromkeys([*others, *plain]))
        ids = [x.ids for x in self._encoded(others)]
        self._add(others, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        if ended:
            at = np.fromiter(map(index.__getitem__, halves), np.int64, len(halves))
            self._add(ended, self.gather(halves), self.lengths[at].reshape(-1, 2).sum(axis=1))

    def _encoded(self, words: list[bytes]) -> list:
        return self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)

    def _add(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.index.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def gather(self, words: list[bytes]) -> np.ndarray:
        return self.placed(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))[0]

    def placed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after another, and how many each has."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    @staticmethod
    def slices(text: str | None) -> Iterator[bytes]:
        """The text's bytes, lowered, in parts of about SLICE bytes that end at white space."""
        raw = (text or "").encode("utf-8", "replace")
        raw = raw if b"<|" in raw else raw.translate(ASCII_LOWER)
        at = 0
        while len(raw) - at > SLICE:
            cut = re.compile(rb"[ \t-\r]").search(raw, at + SLICE)
            if not cut:
                break
            yield raw[at : cut.end()]
            at = cut.end()
        yield raw[at:]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held: list[bytes] = []
        size, first = 0, 0
        for k, text in enumerate(texts):
            if len(text or "") > SLICE:
                if held:
                    yield from self._flush(held)
                    held, size = [], 0
                parts = []
                for part in self.slices(text):
                    parts += self._flush([part])
                yield np.concatenate(parts)
                continue
            held.append(next(self.slices(text)))
            size += len(text or "")
            if size > SLICE:
                yield from self._flush(held)
                held, size = [], 0
        if held:
            yield from self._flush(held)

    def _flush(self, held: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; every distinct word is looked up once."""
        if len(self.index) > CACHED:
            self.trim()
        words = pc.ascii_split_whitespace(pa.array(held, pa.binary()).cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        entry = np.fromiter((-1 if k is None else k for k in map(self.index.get, distinct)), np.int64, len(distinct))
        fresh = np.flatnonzero(entry < 0)
        new = [distinct[i] for i in fresh.tolist()]
        self.learn(new)
        entry[fresh] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        flat, n = self.placed(entry[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(n)])[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol of an optimal prefix code of at most `limit` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < len(leaves))
    bits, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for is_leaf in reversed(kinds):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(bits), np.uint64)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = np.uint64(1) << (np.uint64(MAX_BITS) - bits[order].astype(np.uint64))
    starts = np.cumsum(spans) - spans
    codes[order] = starts >> (np.uint64(MAX_BITS) - bits[order].astype(np.uint64))
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit lookahead: the symbol and its length (length 1 where no code leads)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (MAX_BITS - bits[order].astype(np.int64))
    symbols, lengths = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    n = int(spans.sum())
    symbols[:n], lengths[:n] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return symbols, lengths


def pack_bits(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids and the bit offset of every LANE-th one."""
    n = bits[ids].astype(np.uint64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ends) else 0
    word = (at >> np.uint64(5)).astype(np.int64)
    wide = codes[ids] << (np.uint64(64) - (at & np.uint64(31)) - n)
    out = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::LANE].astype(np.int64)


def unpack_bits(payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int], symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of several blocks, all their checkpoints decoded side by side."""
    base = np.cumsum([0, *map(len, payloads)])
    raw = np.frombuffer(b"".join([*payloads, bytes(LANE * MAX_BITS // 8 + 8)]), np.uint8).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = np.concatenate([c + 8 * b for c, b in zip(checkpoints, base)]).astype(np.int64)
    out = np.zeros((LANE, len(at)), np.uint32)
    for k in range(LANE):
        look = (three[np.minimum(at >> 3, len(three) - 1)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = symbols[look]
        at += lengths[look]
    flat, lane, found = out.T.reshape(-1), 0, []
    for c, n in zip(checkpoints, counts):
        found.append(flat[lane * LANE : lane * LANE + n])
        lane += len(c)
    return found


def ordered_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> (shard, at, doc_id, width, ids): each text's ids and end_id as little-endian bytes of `width`
    each, rows in ascending doc_id order; `at` counts the ids of the same shard (a range of doc_id) before the row."""
    small = end_id < 1 << 16 and tokenizer(path).model.get_vocab_size() <= 1 << 16
    kind, width = ("<u2", 2) if small else ("<u4", 4)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [np.append(x, np.uint32(end_id)) for x in tokenizer(path).encode_all(part.column("text").to_pylist())]
                ends = at + np.cumsum([len(x) for x in ids])
                starts, at = [at, *ends[:-1].tolist()], int(ends[-1])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(starts, pa.int64()), part.column("doc_id"), pa.array([width] * n, pa.int32()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["shard", "at", "doc_id", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = few_texts(rows).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(encode, PLAIN)


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids")):
        yield np.frombuffer(ids.as_buffer(), "<u2" if width == 2 else "<u4").astype(np.uint32)


def token_counts(tokens: DataFrame) -> DataFrame:
    """(width, ids) -> (token_id, n) over all texts; one partial row per id and task enters the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in unpacked(batch):
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token_id", "n"])

    return tokens.select("width", "ids").mapInArrow(count, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of all texts (null: empty), each with end_id behind, in ascending doc_id order (null first, ties by
    a hash of the text). Other columns are not read; an empty table writes an empty codebook and no blocks.

    A very long text is encoded in parts that end at white space. Ids are made once, into a plain table in that order (one file
    per range of doc_id), counted, and coded from it; the plain table goes once the blocks are written.
    """
    spark = docs.sparkSession
    plain = f"{folder}/plain"
    ordered_ids(docs, path, end_id).write.option("compression", "zstd").parquet(plain)
    tokens = spark.read.schema(PLAIN).parquet(plain)
    counts = token_counts(tokens).collect()  # one row per vocabulary id at most
    seen = np.zeros(max([end_id, *(r.token_id for r in counts)]) + 1, np.int64)
    for r in counts:
        seen[r.token_id] = r.n
    bits = code_lengths(seen)
    codes = canonical_codes(bits)
    book = [(int(i), int(bits[i])) for i in np.flatnonzero(bits)]
    spark.createDataFrame(book, "token_id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, first, shard = [], [], 0, 0, None

        def row() -> pa.RecordBatch:
            payload, checks = pack_bits(np.concatenate(held), bits, codes)
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_token": [first], "n": [size], "doc_ids": [names], "n_tokens": [[len(x) for x in held]], "checkpoints": [checks.tolist()], "payload": [payload]}, schema=schema)

        for batch in rows:
            for mine, at, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), unpacked(batch)):
                if held and (size >= BLOCK or mine != shard or at != first + size):
                    yield row()
                    held, names, size = [], [], 0
                if not held:
                    shard, first = mine, at
                held.append(ids)
                names.append(doc_id)
                size += len(ids)
        if held:
            yield row()

    schema = pa.schema([("shard", pa.int32()), ("first_token", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
    ddl = "shard int, first_token long, n long, doc_ids array<long>, n_tokens array<int>, checkpoints array<long>, payload binary"
    tokens.mapInArrow(blocks, ddl).write.option("compression", "none").parquet(f"{folder}/blocks")
    remove(spark, plain)


def read_tokens(spark, folder: str) -> DataFrame:
    """Read the format: (doc_id, shard, start long, n_tokens long, ids_crc32 long, tokens array<int>)."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # one row per vocabulary id at most
    bits = np.zeros(max([0, *(r.token_id for r in book)]) + 1, np.uint8)
    for r in book:
        bits[r.token_id] = r.bits

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lengths = decode_table(bits)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("shard", "first_token", "n", "doc_ids", "n_tokens", "checkpoints", "payload")}
            for k in range(0, batch.num_rows, 16):  # blocks side by side
                part = {c: v[k : k + 16] for c, v in cols.items()}
                ids = unpack_bits(part["payload"], [np.asarray(c, np.int64) for c in part["checkpoints"]], part["n"], symbols, lengths)
                for shard, first, names, counts, flat in zip(part["shard"], part["first_token"], part["doc_ids"], part["n_tokens"], ids):
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crcs = [crc(flat[a:b]) for a, b in zip(starts, ends)]
                    tokens = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int32()), pa.array(first + starts), pa.array(np.asarray(counts, np.int64)), pa.array(crcs, pa.int64()), tokens], names=["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32", "tokens"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(decode, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long, tokens array<int>")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row per written file
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(shards, "shard").select("doc_id", "shard", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "tokens")


def op4_token_huffman(spark, sf_dir: str) -> DataFrame:
    from .common import table

    folder = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, default_path())
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
