"""The interval join of credential parts against all pairs, over the edges of its buckets."""

import random

import pytest

from studyloom.llm import secrets

NAMES = secrets.KINDS
STRONG = len(secrets.STRONG)


def parts(seed):
    r, rows = random.Random(seed), set()
    for doc in (1, 2, None):
        for _ in range(r.choice([5, 30, 60])):
            edge = secrets.BUCKET * r.randrange(0, 8)
            s = max(0, edge + r.choice([-260, -257, -256, -255, -20, -1, 0, 1, 255, 256, 257, r.randrange(-300, 300)]))
            rows.add((doc, 7, s, r.randrange(len(NAMES)), s + r.choice([1, 5, 20, 255, 256, 600])))
    return sorted(rows, key=str)


def linked(rows, scope):
    out = set()
    for doc, h, s, k, e in rows:
        if k < STRONG:
            continue
        near = [x for x in rows if (x[0], x[1]) == (doc, h) and x[2] < e + scope and s < x[4] + scope]
        others = {NAMES[x[3]] for x in near if x[2] >= e or s >= x[4]}
        if any(x[3] < STRONG and x[2] < e and s < x[4] for x in near):
            continue
        identified, secret, place = others & {"access", "weak_id"}, others & {"assign", "hex", "weak_secret"}, others & {"endpoint"}
        if (NAMES[k] == "weak_id" and secret) or (NAMES[k] == "weak_secret" and (identified or place)) or (NAMES[k] == "endpoint" and identified and secret):
            out.add((doc, s, k, e))
    return out


@pytest.mark.parametrize(("seed", "scope"), [(1, secrets.SCOPE), (2, secrets.SCOPE), (5, 40), (4, 2000)])
def test_links_of_all_pairs(spark, seed, scope):
    rows = parts(seed)
    table = spark.createDataFrame(rows, "doc_id long, text_hash long, s int, k int, e int")
    got = [(r.doc_id, r.span.s, r.span.k, r.span.e) for r in secrets.linked_parts(table, scope).collect()]
    assert len(got) == len(set(got)) and set(got) == linked(rows, scope) != set()
