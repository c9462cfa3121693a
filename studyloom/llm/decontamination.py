"""Benchmark decontamination by an FM-index per shard of the training texts.

A shard holds the words of some hundred documents, as ids of a vocabulary of its own. Its suffixes are sorted, the words before
them (the Burrows-Wheeler transform) are kept in a wavelet tree, and every STEP-th suffix's place is kept. Test phrases are
searched backwards, all at once, by ranks in the tree; the places of what is found come from walking to the next place that is
kept; spans of a document that overlap or touch are merged. The index is a table, built once for any number of test sets.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_texts, materialize, replaced_text, table, whole_row, written
from .licenses import WORD_BYTES, words_of

#: Words of a window, words of a shard (one row of the index; sorting needs it below 2**20), every which suffix's place is kept, and
#: phrases with their items that are searched at a time (what is broadcast).
WINDOW, SHARD, STEP, PHRASES = 10, 1 << 19, 8, 200_000
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
INDEX = (
    "words binary, counts binary, levels array<binary>, marks binary, samples binary, starts binary, "
    "docs array<struct<key: long, doc_id: long, n_words: long, piece: int, offset: long>>"
)
ENTRY = pa.list_(pa.struct([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("piece", pa.int32()), ("offset", pa.int64())]))
FOUND = "key long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


class Bits:
    """A row of bits with the number of ones before any place."""

    def __init__(self, packed: np.ndarray):
        """packed: the bits in bytes, lowest first."""
        self.packed = packed
        self.blocks = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        return cls(np.packbits(bits, bitorder="little"))

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """A sequence of whole numbers, one row of bits for each binary digit, highest first; a row lies in the order in which the digits
    before it, the last of them first, sort the sequence (zeros before ones), so that a tree's nodes are runs of a row."""

    def __init__(self, levels: list[Bits], n: int, symbols: int):
        self.levels, self.n = levels, n
        self.zeros = [n - int(bits.ones(np.array([n]))[0]) for bits in levels]
        self.first = self.down(np.arange(symbols), np.zeros(symbols, np.int64))

    @classmethod
    def of(cls, sequence: np.ndarray, symbols: int) -> WaveletTree:
        levels, n = [], len(sequence)
        for digit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> digit) & 1 == 1
            levels.append(Bits.of(ones))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        return cls(levels, n, symbols)

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length `at` ends among the leaves, along the digits of `symbol`."""
        for k, bits in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (len(self.levels) - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before place `at`."""
        return self.down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.at(at), bits.ones(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of fewer than 2**20 symbols below 2**20, by prefix doubling; a key holds both ranks and the place, so that a plain
    sort orders it."""
    n, rank, step = len(symbols), symbols.astype(np.int64), 1
    place, low = np.arange(n), (1 << 21) - 1
    while True:
        key = rank << 42 | place
        key[: max(n - step, 0)] |= rank[step:] + 1 << 21
        key.sort()
        order = key & low
        key >>= 21
        fresh = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        if not n or fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2


@dataclass
class FMIndex:
    """Pieces of text as words, each ended by symbol 0, to be searched backwards."""

    words: list[bytes]  # of symbols 1, 2, 3...
    before: np.ndarray  # how many symbols are smaller than each, with the total at the end
    tree: WaveletTree  # over the symbol before each suffix, in the suffixes' order
    marks: Bits  # suffixes whose place is kept
    samples: np.ndarray  # their places
    starts: np.ndarray  # of pieces

    @classmethod
    def of(cls, pieces: list[np.ndarray], words: list[bytes]) -> FMIndex:
        sizes = np.array([len(p) + 1 for p in pieces])
        starts = np.cumsum(sizes) - sizes
        text = np.concatenate([v for p in pieces for v in (p, [0])]).astype(np.int64)
        # Ends differ from each other while suffixes are sorted, so that no comparison runs over an end.
        ends = np.cumsum(text == 0) - 1
        order = sorted_suffixes(np.where(text == 0, ends, text + len(pieces) - 1))
        tree = WaveletTree.of(text[order - 1], len(words) + 1)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words) + 1))])
        # A piece's start is always kept, so that no walk leaves its piece.
        kept = ((np.arange(len(text)) - np.repeat(starts, sizes)) % STEP == 0)[order]
        return cls(words, before, tree, Bits.of(kept), order[kept], starts)

    def row(self) -> list:
        pack = lambda a: a.astype(np.int32).tobytes()
        return [b" ".join(self.words), pack(self.before), [b.packed.tobytes() for b in self.tree.levels], self.marks.packed.tobytes(), pack(self.samples), pack(self.starts)]

    @classmethod
    def from_row(cls, words: bytes, before: bytes, levels: list[bytes], marks: bytes, samples: bytes, starts: bytes) -> FMIndex:
        unpack = lambda b: np.frombuffer(b, np.int32).astype(np.int64)
        bits = lambda b: Bits(np.frombuffer(b, np.uint8))
        totals, words = unpack(before), words.split()
        return cls(words, totals, WaveletTree([bits(b) for b in levels], int(totals[-1]), len(words) + 1), bits(marks), unpack(samples), unpack(starts))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one length, a row of symbols each -> those that stand in the text and the ends of their suffixes' range."""
        alive = np.arange(len(phrases))
        low, high = self.before[phrases[:, -1]], self.before[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[alive, k]
            low, high = (self.before[symbol] + self.tree.rank(symbol, v) for v in (low, high))
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def places(self, at: np.ndarray) -> np.ndarray:
        """The places of suffixes, given by their number in the order."""
        found, walked, still = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(still):
            marked = self.marks.at(at)
            found[still[marked]] = self.samples[self.marks.ones(at[marked])] + walked
            still, at = still[~marked], at[~marked]
            symbol, rank = self.tree.access(at)
            at, walked = self.before[symbol] + rank, walked + 1
        return found


def build_index(docs: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc_id, text, ...) -> INDEX, a row a shard; finds phrases of up to `window` words.

    Documents of a partition are put into shards as they come, equal texts of a shard once. A text longer than a shard is cut into
    pieces that overlap by window - 1 words. A null or empty text has no words and is in no piece; each row is a document of its
    own, told by key; a null doc_id stays; an empty table gives an empty index; other columns are not read.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = count(TaskContext.get().partitionId() << 33)
        fresh = lambda: (defaultdict(count(1).__next__), [], [], {})
        ids, pieces, docs, known = fresh()
        held = 0

        def record() -> pa.RecordBatch:
            values = FMIndex.of(pieces, list(ids)).row() if pieces else [b"", b"", [], b"", b"", b""]
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds)), pa.array([docs], ENTRY)], names=["words", "counts", "levels", "marks", "samples", "starts", "docs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                clean = (text.as_py() or "").encode("utf-8", "replace").translate(WORD_BYTES)
                place = {"key": next(key), "doc_id": doc_id}
                if clean in known and held < shard:
                    n_words, piece = known[clean]
                    held += 1
                    docs.append(place | {"n_words": n_words, "piece": piece, "offset": 0})
                    continue
                words = clean.split()
                place["n_words"] = len(words)
                for start in range(0, max(1, len(words) - window + 1), shard - window + 1):
                    part = words[start : start + shard]
                    if held and held + len(part) > shard:
                        yield record()
                        ids, pieces, docs, known = fresh()
                        held = 0
                    if part:
                        pieces.append(np.array([ids[w] for w in part]))
                    docs.append(place | {"piece": len(pieces) - 1 if part else -1, "offset": start})
                    held += len(part) + 1
                if len(words) <= shard:
                    known[clean] = (len(words), docs[-1]["piece"])
        if docs:
            yield record()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few_texts(rows).mapInArrow(build, INDEX)


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text, ...) -> (phrase, item string): all runs of `window` consecutive words, the whole text where it has fewer, none
    where it has none. A null item_id is an empty string; a phrase that an item repeats is there once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, names = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} - {b""}
                phrases += found
                names += [item] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(names, pa.string())], names=["phrase", "item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return few_texts(rows).mapInArrow(cut, "phrase binary, item string").distinct()


class PhraseSet:
    """Phrases by their length, as rows of places in a list of words, with the items that they come from."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        items = defaultdict(list)
        for phrase, item in pairs:
            items[phrase].append(item)
        split = {p: p.split() for p in items}
        self.words = sorted({w for ws in split.values() for w in ws})
        at, lengths = {w: i for i, w in enumerate(self.words)}, defaultdict(list)
        for p, ws in split.items():
            lengths[len(ws)].append(p)
        self.groups = [(n, np.array([[at[w] for w in split[p]] for p in ps]), [items[p] for p in ps]) for n, ps in sorted(lengths.items())]

    def hits(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Places of all phrases in the index: where they start and end, and the items of each."""
        known = dict(zip(index.words, range(1, len(index.words) + 1)))
        symbols = np.array([known.get(w, 0) for w in self.words], np.int64)
        starts, ends, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for n, rows, names in self.groups:
            phrases = symbols[rows]
            whole = np.flatnonzero((phrases > 0).all(axis=1))
            alive, low, high = index.search(phrases[whole])
            counts = high - low
            at = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
            places = index.places(at)
            starts.append(places)
            ends.append(places + n)
            items += [names[whole[i]] for i, c in zip(alive, counts) for _ in range(c)]
        return np.concatenate(starts), np.concatenate(ends), items


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The union of spans, in order; spans that touch are one."""
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cuts = np.flatnonzero(starts[1:] > ends[:-1])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[np.concatenate([[0], cuts + 1])], ends[np.concatenate([cuts, [len(ends) - 1]])])]


def search_index(index: DataFrame, phrases: DataFrame, block: int = PHRASES) -> DataFrame:
    """INDEX and (phrase, item) -> FOUND, one row a document: the spans of words inside any occurrence, and the items they are of.

    Phrases are searched about `block` at a time, as many passes over the index as that takes: that many are broadcast, whatever
    the size of the test set.
    """
    spark = index.sparkSession
    phrases, _ = written(phrases, "phrases")
    blocks = max(1, -(-phrases.count() // block))
    part = F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks))

    def searched(k: int) -> DataFrame:
        shared = spark.sparkContext.broadcast([(bytes(r["phrase"]), r["item"]) for r in phrases.where(part == k).collect()])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = PhraseSet(shared.value)
            for batch in batches:
                for row in batch.to_pylist():
                    spans, items = found_in(row, phrases)
                    docs = row["docs"]
                    columns = [pa.array([d[c] for d in docs], pa.int64()) for c in ("key", "doc_id", "n_words")]
                    spans = pa.array([[{"start": s["start"] + d["offset"], "end": s["end"] + d["offset"]} for s in spans.get(d["piece"], ())] for d in docs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                    names = pa.array([items.get(d["piece"], ()) for d in docs], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*columns, spans, names], names=["key", "doc_id", "n_words", "spans", "items"])

        return index.mapInArrow(search, FOUND)

    found = searched(0)
    for k in range(1, blocks):
        found = found.unionByName(searched(k))
    joined = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return joined.withColumn("spans", merged_spans(F.col("spans")))


def found_in(row: dict, phrases: PhraseSet) -> tuple[dict, dict]:
    """For each piece of a shard that holds a phrase: its merged spans, from the piece's start, and the items."""
    if not row["starts"]:
        return {}, {}
    index = FMIndex.from_row(*(row[c] for c in ("words", "counts", "levels", "marks", "samples", "starts")))
    starts, ends, items = phrases.hits(index)
    pieces = np.searchsorted(index.starts, starts, side="right") - 1
    order = np.argsort(pieces, kind="stable")
    cuts = np.flatnonzero(np.diff(pieces[order])) + 1
    spans, names = {}, {}
    for at in np.split(order, cuts) if len(order) else ():
        piece = int(pieces[at[0]])
        spans[piece] = merged(starts[at] - index.starts[piece], ends[at] - index.starts[piece])
        names[piece] = sorted(set(chain.from_iterable(items[i] for i in at)))
    return spans, names


def merged_spans(spans: Column) -> Column:
    """The union of an array of spans of start and end, in order; spans that touch are one."""
    def grown(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start: long, end: long>>"), grown)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = PHRASES) -> DataFrame:
    """(doc_id, text, ...) and (item_id, text, ...) -> one row per document: doc_id, n_words, spans (words to remove, from 0, end
    exclusive, merged, in order) and items (those with an occurring window, as strings, sorted).

    What build_index and phrases_of say of nulls, empty and long texts, repeated rows and empty tables holds; without items no
    document has spans; columns with other names are not read.
    """
    index = materialize(build_index(docs, window, shard), "fm_index")
    return search_index(index, phrases_of(items, window), block).drop("key")


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words of all test passages cut out of `text`, from a span's first letter to its last; all else stays byte for
    byte (n_chars follows where a text is cut).

    A null text stays null. Repeated rows are each cut; an empty table stays empty; rows ride as one struct, so that no column
    name clashes.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("doc_id"), whole_row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    held = materialize(numbered, "numbered")
    spans = contaminated(held.select("doc_id", "text"), items, window).where(F.size("spans") > 0).select("doc_id", "spans")
    spans = materialize(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "short"])

    short = few_texts(held.select("doc_id", "text").join(spans, "doc_id")).mapInArrow(cut, "doc_id long, short string")
    out = held.select("doc_id", "row").join(short, "doc_id", "left")
    return replaced_text(out.select("row", F.col("short").alias("text")), docs.columns)


def cut_words(text: str, spans: list[dict]) -> str:
    """text without the words of each span and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, start = [], 0
    for s in spans:
        kept.append(text[start : places[s["start"]][0]])
        start = places[s["end"] - 1][1]
    return "".join(kept) + text[start:]


def op11_fm_index(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
