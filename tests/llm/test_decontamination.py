"""The positional index against plain loops over words."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyglass.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size, near):
    """(doc number, item id) to (hit positions, number of proximity matches), for pairs that meet."""
    texts = [words(t) for _, t in docs]
    frequency = Counter(w for t in texts for w in t)
    out = {}
    for item, text in items:
        w = words(text)
        windows = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        for d, t in enumerate(texts):
            hit, close = set(), 0
            for g in windows:
                rare = min(range(len(g)), key=lambda k: (frequency[g[k]], k))
                for p, x in enumerate(t):
                    if tuple(t[p:p + len(g)]) == g:
                        hit |= set(range(p, p + len(g)))
                    close += x == g[rare] and set(g) <= set(t[max(0, p - near):p + near + 1])
            if close:
                old = out.get((d, item), (set(), 0))
                out[d, item] = (old[0] | hit, old[1] + close)
    return out


def check(spark, docs, items, size, near, **more):
    d = spark.createDataFrame([(i, i, t) for i, (_, t) in enumerate(docs)], "doc_id long, clash long, text string")
    p = spark.createDataFrame(items, "item_id string, text string")
    index = dc.build_index(d, block_words=more.pop("block_words", dc.BLOCK_WORDS))
    found = dc.search(index, p, size=size, near=near, **more)
    got = {}
    for r in found.collect():
        hit = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        old = got.get((r["id"], r["phrase"]), (set(), 0))
        got[r["id"], r["phrase"]] = (old[0] | hit, old[1] + r["n_near"])
    expected = brute(docs, items, size, max(near, size - 1))
    assert got == expected
    by_doc = {r["id"]: r for r in dc.contamination(index, found).collect()}
    assert len(by_doc) == len(docs)
    for i, (_, t) in enumerate(docs):
        mine = {k: v for (d, k), v in expected.items() if d == i}
        exact = sorted(k for k, v in mine.items() if v[0])
        assert by_doc[i]["n_words"] == len(words(t)) and by_doc[i]["phrases"] == exact
        assert by_doc[i]["n_hit"] == len(set().union(*(v[0] for v in mine.values()))) if mine else by_doc[i]["n_hit"] == 0
        assert (by_doc[i]["n_phrases"], by_doc[i]["n_near"]) == (len(exact), len(mine))


def test_against_loops(spark):
    rnd = random.Random(3)
    make = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    few, many = ["A", "b", "é1", "c-d"], [f"w{k}" for k in range(40)]
    docs = [(0, make(rnd.randint(0, 80), rnd.choice((few, many)))) for _ in range(40)]
    items = [(f"i{k}", make(rnd.randint(1, 9), few if k % 2 else many)) for k in range(12)]
    items += [("planted", " ".join(words(docs[3][1])[2:14])), ("copy", items[0][1]), ("i1", items[3][1])]
    docs += [(0, make(30, many).upper() + ". " + items[12][1] + "\n" + items[12][1]), (0, docs[3][1])]
    check(spark, docs, items, 4, 6)
    check(spark, docs, items, 4, 1, block_words=50, pass_words=20)      # distance less than a window: exact matches count all the same


def test_odd_rows(spark):
    long = "start " + "x y z " * 40_000 + "the end of it"
    docs = spark.createDataFrame([(1, None), (None, "the end of it"), (3, ""), (3, "!?"), (4, long), (4, long)], "doc_id long, text string") \
        .withColumns({"block": F.lit("clash"), "terms": F.lit(1)})
    items = spark.createDataFrame([(None, "END of IT"), (7, None), (8, ""), (9, "y z x y"), (9, "y z x y"), (10, "never seen")], "item_id long, text string")
    index = dc.build_index(docs, block_words=1000)
    rows = sorted(((r["id"] is None, r["id"] or 0, r["n_words"], r["n_hit"], r["phrases"], r["n_phrases"])
                   for r in dc.contamination(index, dc.search(index, items, size=4)).collect()), key=str)
    assert rows == sorted([(False, 1, 0, 0, [], 0), (True, 0, 4, 3, [], 1), (False, 3, 0, 0, [], 0), (False, 3, 0, 0, [], 0),
                           (False, 4, 120_005, 120_001, ["9"], 2), (False, 4, 120_005, 120_001, ["9"], 2)], key=str)
    empty = dc.build_index(docs.limit(0))
    assert dc.contamination(empty, dc.search(empty, items)).count() == 0
    assert dc.search(index, items.limit(0)).count() == 0
    assert {r["n_hit"] for r in dc.contamination(index, dc.search(index, items.limit(0))).collect()} == {0}
