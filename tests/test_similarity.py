"""The prefix filter against all pairs."""

import random

import pytest

from studyloom.operators import similarity


@pytest.mark.parametrize(("least", "split"), [(0.18, 50_000), (0.5, 3), (1.0, 50_000), (0.01, 2)])
def test_all_pairs_that_share_enough(spark, monkeypatch, least, split):
    monkeypatch.setattr(similarity, "SPLIT", split)
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    some = lambda n: sorted({r.choice(words) for _ in range(n)})
    large = [(i, some(r.randrange(0, 30))) for i in range(80)] + [(100, None)]
    small = [(i, some(r.randrange(0, 12))) for i in range(60)] + [(100, None), (101, ["nowhere"])]
    got = similarity.held_share(*(spark.createDataFrame(t, f"{c} long, words array<string>") for t, c in ((large, "lid"), (small, "rid"))), least).collect()
    want = {(a, b): len(set(x) & set(y)) / len(y) for a, x in large for b, y in small if x and y and len(set(x) & set(y)) / len(y) >= least}
    assert {(g.lid, g.rid): g.score for g in got} == want and len(got) == len(want) > 0


def test_the_most_common_words_have_no_list(spark):
    sets = spark.createDataFrame([(1, [f"r{i}" for i in range(9)] + ["the"])], "rid long, words array<string>")
    frequencies = spark.createDataFrame([("the", 10**9), *((f"r{i}", i) for i in range(9))], "word string, df long")
    rows = similarity.prefixes(sets, frequencies, 0.2).collect()
    assert {r.word for r in rows if r.listed} == {f"r{i}" for i in range(9)} and {(r.needed, r.few) for r in rows} == {(2, 1)}
