"""Collocations against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyglass.llm import collocations as co


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            held = any(100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in candidates.items() if len(h) > len(g))
            if not held:
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_against_counting(spark):
    rnd = random.Random(2)
    vocabulary = ["a", "B", "éa", "É", "of", "x-y", "\x00z", "%", "wörd" * 40, "of"]
    marks = [" ", " ", " ", " ", "  ", "\t", " \t ", ", ", "\n", ".", "!\x0b", "\r", " ", ";;"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice(marks) for _ in range(n))
    docs = [(text(rnd.randint(0, 60)), rnd.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    docs += [("one two three four five six. seven two three four", "en")] * 7 + [(None, "en"), ("", None), ("only", "xx"), (" \t\n.", "xx")]
    rows = spark.createDataFrame(docs, "text string, lang string").withColumns({"phrase": F.lit("clash"), "n": F.lit(0)}).repartition(3)
    expected = brute(docs, 5, 12)
    assert len({r[0] for r in expected}) > 3
    assert got(co.mine(rows, least=5, top=12)) == expected
    # Hardly any pair is ruled out: the same counts from whole edges.
    assert got(co.mine(rows, least=5, top=12, table_bits=64)) == expected


def test_paths(spark):
    line, ring = "the quick brown fox jumps over the lazy dog", "x y z x y z x y z"
    rows = spark.createDataFrame([(line, "en")] * 6 + [(ring, "de")] * 6 + [("big red house here", "en")] * 6 + [("w1 w2 w3 left end", "fr"), ("w1 w2 w3 right end", "fr")] * 6,
                                 "text string, lang string")
    edges = spark.createDataFrame([("en", p) for p in ("the quick brown fox", "quick brown fox jumps", "brown fox jumps over", "big red house here")]
                                  + [("de", p) for p in ("x y z x", "y z x y", "z x y z")], "lang string, phrase string")
    assert {(r["phrase"], r["path"]) for r in co.unary_paths(edges).collect()} == {
        ("the quick brown fox", "the quick brown fox jumps over"), ("quick brown fox jumps", "the quick brown fox jumps over"),
        ("brown fox jumps over", "the quick brown fox jumps over"), ("big red house here", "big red house here"),
        ("x y z x", "x y z x y z"), ("y z x y", "x y z x y z"), ("z x y z", "x y z x y z")}
    found = {(r["lang"], r["phrase"]): r["path"] for r in co.mine(rows, least=5).collect()}
    assert found["en", "over the lazy dog"] == line and found["fr", "w1 w2 w3"] == "w1 w2 w3 right end"


def test_odd_rows(spark):
    long = "ab cd " * 200_000
    rows = spark.createDataFrame([(long, "en"), (long, "en"), (None, None)], "text string, lang string")
    # 2 texts of 400,000 words; the pair of each four words is as frequent as the words, but for the ends.
    found = {r["phrase"]: r for r in co.mine(rows, least=2).collect()}
    assert found["ab cd ab cd"]["a"] == 2 * 199_999 and found["ab cd ab cd"]["n"] == 800_000
    assert co.mine(rows.limit(0)).count() == 0
