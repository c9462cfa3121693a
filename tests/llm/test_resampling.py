"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from studyloom.llm import resampling as S

DOCS = "doc_id long, text string, rank string, score string, row long"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
R = random.Random(8)


def text(n):
    return " ".join(R.choice("abcdéx") + R.choice(["", "1", "Ü", "."]) * R.randrange(3) for _ in range(n))


def made():
    rows = [(i, text(R.randrange(0, 60)), "a", "b", i) for i in range(300)] + [(1000, None, "a", "b", 0), (1001, "", None, None, None), (1002, text(40_000), "a", "b", 0)]
    return rows + [rows[5]] * 3 + [(2000 + i, rows[9][1], None, None, None) for i in range(100)] + [(None, text(30), None, None, None), (77, text(25), "x", "y", 1)]


ITEMS = [(1, "abc x x x1 é"), (2, None), (3, ""), (4, "New words, éé x")]


CORPUS = made()


def plain(docs, items, longest=1, percent=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % S.BUCKETS for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = (collections.Counter(b for x in table for b in features(x[1])) for table in (docs, items))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + S.BUCKETS) / ((s[b] + 1) * (big_t + S.BUCKETS))))
    out = []
    for d, x, *_ in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 55), (1, 100), (1, 0)])
def test_resample(spark, longest, percent):
    docs, items = spark.createDataFrame(CORPUS, DOCS).repartition(4), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = S.resample(docs, items, percent=percent, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, got)) == plain(CORPUS, ITEMS, longest, percent)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(CORPUS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert S.resample(docs.limit(0), items).count() == 0
    got = S.resample(docs, items.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, got)) == plain(CORPUS, [])


def test_a_task_keeps_few_buckets(monkeypatch):
    monkeypatch.setattr(S, "KEPT", 3)
    known = S.Buckets(10)
    words = [b"a", b"b", b"c", b"d", b"a", b"e"]
    assert known.of(words, 1) == [zlib.crc32(w) % 10 for w in words] and len(known) <= 3
