"""License scans over a positional index of rare licence words.

Templates (licence notices and short grants) are indexed under the rarest words of one of their mandatory key phrases: word
-> postings (template, position). A file's words are looked up there, those of highest inverse document frequency first;
the places in which all of a template's rare words stand at the same relative position as in the template intersect to
its alignments; an alignment counts once all mandatory key phrases stand in it and enough of the template's words do. As a
phrase stands word for word, no template that would be verified is missed. Document frequencies are those of the whole corpus.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_texts, table
from .license_texts import NOTICES

#: bytes.translate table: A-Z to a-z; ASCII other than letters and digits to a space.
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Rarest words under which a template is indexed, share of its words that an alignment needs, and words it may be off by.
RARE, COVER, SLACK = 3, 0.6, 6


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


#: The base phrases, exact and in full; then the notices.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (*(Template(label, text, (text,), True) for label, text in BASE), *(Template(label, text, phrases) for label, text, phrases in NOTICES))


def places_of(phrase: list[bytes], words: list[bytes]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


class PositionalIndex:
    """Templates, the inverse document frequency of their phrases' words, and word -> postings (template, position)."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int], documents: int):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.phrases = [[words_of(p) for p in t.phrases] for t in templates]
        self.vocabulary = frozenset(w for ps in self.phrases for p in ps for w in p)
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.indexed: list[list[bytes]] = []
        self.rarest: dict[bytes, list[int]] = defaultdict(list)
        for k, phrases in enumerate(self.phrases):
            rarest = [sorted(set(p), key=lambda w: (-self.idf[w], w))[:RARE] for p in phrases]
            best = max(range(len(phrases)), key=lambda i: (sum(self.idf[w] for w in rarest[i]), -i))
            rare, phrase = rarest[best], phrases[best]
            at = places_of(phrase, self.words[k])
            if not at:
                raise ValueError(f"a phrase of template {k} does not stand in it")
            self.indexed.append(rare)
            self.rarest[rare[0]].append(k)
            for w in rare:
                self.postings[w] += [(k, at[0] + i) for i, x in enumerate(phrase) if x == w]

    def alignments(self, words: list[bytes]) -> dict[int, list[int]]:
        """template -> the starts that all of its rare words agree on."""
        seen = self.postings.keys() & set(words)
        # Looked up by their rarest word; the others must be there too before any place is sought.
        likely = {k for w in seen for k in self.rarest.get(w, ()) if seen.issuperset(self.indexed[k])}
        if not likely:
            return {}
        held = sorted({w for k in likely for w in self.indexed[k]}, key=lambda w: (-self.idf[w], w))
        places: dict[bytes, list[int]] = {w: [] for w in held}
        for at, w in enumerate(words):
            if w in places:
                places[w].append(at)
        starts: dict[int, set[int]] = {}
        met: Counter = Counter()
        for w in held:
            mine: dict[int, set[int]] = defaultdict(set)
            for k, position in self.postings[w]:
                if k in likely:
                    mine[k].update(at - position for at in places[w])
            for k, found in mine.items():
                starts[k] = starts[k] & found if k in starts else found
                met[k] += 1
        return {k: sorted(s) for k, s in starts.items() if s and met[k] == len(self.indexed[k])}

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words) of the verified alignments in a file's words: of the base phrases all, of
        other templates the best, then the first."""
        out = []
        for k, starts in sorted(self.alignments(words).items()):
            if self.templates[k].base:  # the phrase itself, consecutively
                wanted = self.words[k]
                out += [(k, s, 1.0) for s in starts if s >= 0 and words[s : s + len(wanted)] == wanted]
                continue
            share, start = max(((self.verified(k, words, s), -s) for s in starts), default=(0.0, 0))
            if share:
                out.append((k, max(0, -start), share))
        return out

    def verified(self, k: int, words: list[bytes], start: int) -> float:
        """The share of template k's words that stand around `start`; 0 unless all mandatory phrases do."""
        wanted = self.words[k]
        near = words[max(0, start - SLACK) : max(0, start + len(wanted) + SLACK)]
        if not all(places_of(phrase, near) for phrase in self.phrases[k]):
            return 0.0
        share = sum((Counter(wanted) & Counter(near)).values()) / len(wanted)
        return share if share >= COVER else 0.0


def licence_word_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """(text) -> (word binary, n): in how many documents each licence word stands, and under b'' all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[b""] += batch.num_rows
            for text in batch.column("text"):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return few_texts(texts).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, n_words, places (array of template, label, base, start, share).

    A null or empty text has no words and no places; a very long one is scanned whole. Repeated rows are scanned each on its
    own; places come in the order of templates and starts; of alignments of a template that tie in share the first counts. An
    empty table gives an empty result; other columns are not read.
    """
    vocabulary = PositionalIndex(templates, {}, 0).vocabulary
    counts = {bytes(r.word): r.n for r in licence_word_frequency(docs, vocabulary).collect()}  # a row per licence word
    index = PositionalIndex(templates, counts, counts.get(b"", 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                sizes.append(len(words))
                places.append([{"template": k, "label": templates[k].label, "base": templates[k].base, "start": s, "share": v} for k, s, v in index.scan(words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, kind)], names=["doc_id", "n_words", "places"])

    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few_texts(rows).mapInArrow(scan, "doc_id long, n_words long, places array<struct<template: int, label: string, base: boolean, start: long, share: double>>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
