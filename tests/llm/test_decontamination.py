"""The FM-index against plain searches."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, spans string, items string, key long"
R = random.Random(3)
VOCABULARY = [f"{a}{b}" for a in "xyz" for b in ("", "ö", "7")]


def text(n, glue=(" ", "\n", ", ", "-", "  ")):
    return "".join(R.choice(VOCABULARY) + R.choice(glue) for _ in range(n))


ITEMS = [(i, text(n)) for i, n in enumerate((14, 25, 10, 10, 3, 1, 0, 11, 40))] + [(20, None), (None, text(12)), (21, "The Lazy DOG; and the quick brown fox said ’ö’ twice")]


def passage(k):
    return " ".join(WORD.findall((ITEMS[k][1] or "").translate(LOW)))


def made():
    texts = [None, "", " .,;", text(1), text(9), text(300), text(5000)]
    texts += [text(30) + passage(k) + " " + text(30) for k in range(9)] + [passage(1) + " " + passage(1), passage(0) + " " + passage(7), passage(8).upper()]
    texts += ["the lazy dog and THE QUICK BROWN FOX said ö twice", passage(10), text(400) + passage(8) + " " + text(900) + passage(8)]
    rows = [(i, t, "a", "b", i) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, text(40) + passage(8), None, None, None)] + [(90 + i, rows[13][1], None, None, None) for i in range(30)]


CORPUS = made()


def plain(docs, items, window=D.WINDOW):
    phrases = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases[tuple(w[i : i + window])].add("" if item is None else str(item))
    out = []
    for d, t, *_ in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for p, which in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names |= which
        out.append((d, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    return collections.Counter(out)


def told(df):
    return collections.Counter((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), tuple(r["items"])) for r in df.collect())


@pytest.mark.parametrize(("window", "shard", "block"), [(10, 1 << 19, 200_000), (10, 40, 9), (3, 64, 30)])
def test_contaminated_equals_a_plain_search(spark, window, shard, block):
    docs = spark.createDataFrame(CORPUS, DOCS).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert told(D.contaminated(docs, items, window, shard, block)) == plain(CORPUS, ITEMS, window)


def test_spans_are_merged_and_apart(spark):
    docs, items = spark.createDataFrame(CORPUS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in D.contaminated(docs, items, shard=40).collect():
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_index_search_and_places():
    for seed in range(20):
        r = np.random.default_rng(seed)
        pieces = [r.integers(1, 6, r.integers(1, 60)) for _ in range(r.integers(1, 8))]
        index = D.FMIndex.from_row(*D.FMIndex.of(pieces, [b"w%d" % i for i in range(1, 6)]).row())
        for n in (1, 2, 3, 5):
            phrases = r.integers(1, 6, (20, n))
            got = {}
            for a, low, high in zip(*index.search(phrases)):
                got[tuple(phrases[a])] = sorted(index.places(np.arange(low, high)).tolist())
            for p in map(tuple, phrases.tolist()):
                want = sorted(int(index.starts[k] + i) for k, x in enumerate(pieces) for i in range(len(x) - n + 1) if tuple(x[i : i + n].tolist()) == p)
                assert got.get(p, []) == want


def test_suffixes_are_sorted():
    for seed in range(30):
        r = np.random.default_rng(seed)
        s = np.concatenate([r.integers(1, 4, r.integers(0, 300)), [0]])
        assert D.sorted_suffixes(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(CORPUS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert told(D.contaminated(docs, none)) == plain(CORPUS, [])
    assert D.without_spans(docs.limit(0), items).columns == docs.columns


def test_words_of_passages_are_cut_and_no_others(spark):
    docs, items = spark.createDataFrame(CORPUS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.without_spans(docs, items).collect()
    want = []
    for row, (_, _, hit, _) in ((row, k) for row in CORPUS for k in plain([row], ITEMS)):
        t = row[1]
        if hit:
            at, keep, cut = [m.span() for m in WORD.finditer(t.translate(LOW))], [True] * len(t), set(hit)
            for i in hit:
                keep[at[i][0] : at[i + 1][0] if i + 1 in cut else at[i][1]] = [False] * ((at[i + 1][0] if i + 1 in cut else at[i][1]) - at[i][0])
            t = "".join(c for c, k in zip(t, keep) if k)
        want.append((row[0], t, *row[2:]))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(CORPUS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = collections.Counter(map(tuple, D.op11_fm_index(spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for (d, n, hit, names), k in plain(CORPUS, ITEMS).items():
        want[(d, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))] += k
    assert got == want
