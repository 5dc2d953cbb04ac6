"""The training-data operators against plain loops on small tables, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm import bpe, fingerprint, ftrl, line_dedup, minhash, packing, quality_classifier, quality_rules
from tallyglass.llm import shingles, token_counts, toxicity, warc
from tallyglass.llm.linking import components, link_buckets

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega stone river cloud forest window table".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(n))


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, repeated, long and tied rows, and columns with clashing names."""
    long = "tok" * 3000
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (None, "y z", "zz", "b", 3),
            (5, long, "de", None, 9000), (6, "line one here\nline one here\n\nother", "en", "a", 30), (7, "\n\n", "fr", "b", 2)]
    return frame(spark, rows).withColumns({"id": F.lit("clash"), "qr_text": F.lit(7), "score": F.lit("s"), "bucket": F.lit(None).cast("string")}).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_rules_counts(spark, odd):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab cd\n e#f $ gh".split(" ")) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for r in quality_rules.judge(rows).collect():
        t = r["text"] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
        assert (r["qr_n_words"], r["qr_word_chars"], r["qr_n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["qr_n_dup_lines"], r["qr_n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["qr_base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["qr_base_failed"] and r["qr_kept"])
    kept = quality_rules.judge(odd)
    assert kept.count() == odd.count() and {"id", "qr_text", "score"} <= set(kept.columns)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_js_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), q).alias("d")).first()["d"]
    assert got == pytest.approx(((kl(p) + kl(q)) / 2) ** 0.5)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_exact(spark, odd, name):
    path = bpe.token_path(name)
    t = Tokenizer.from_file(path)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["it's", "'ve", " ", "  ", "\n", "Été", "123", "!?", "漢字", "J̌", "İ", "\x85", "<|endoftext|>", "²a"])
                     for _ in range(rnd.randint(0, 30))) for _ in range(80)]
    rows = frame(spark, [(i, x, None, None, None) for i, x in enumerate(texts)]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    made = bpe.encode(rows, "text", path, ["doc_id", "text"]).collect()
    assert len(made) == rows.count()
    c = bpe.codec(path)
    for r in made:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert c.decode(bytes(r["ids"])) == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), "text", path, ["doc_id"]).count() == 0


def test_tree_concatenation(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 5)
    rnd = random.Random(3)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        c, t = bpe.Codec(bpe.token_path(name)), Tokenizer.from_file(bpe.token_path(name))
        for _ in range(60):
            text = "".join(rnd.choice(["a", "b", "the", "ing", "é", "tion", "!", "0", "漢", " ", "aaaa", "<|endoftext|>"]) for _ in range(rnd.randint(1, 80)))
            runs = {}
            for run, leaf, part, ends in c.leaves(text):
                runs.setdefault(run, []).append((c.encode_leaf(part, leaf, ends), ends))
            whole = b""
            for run in sorted(runs):
                level = runs[run]
                while len(level) > 1:
                    level = [(c.join(level[i][0], level[i + 1][0], level[i + 1][1]), level[i + 1][1]) if i + 1 < len(level) else level[i]
                             for i in range(0, len(level), 2)]
                whole += level[0][0]
            assert whole == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_long_runs_through_spark(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice(["ab", "the", "ing", "q", "é"]) for _ in range(9000)) + " tail " + "z" * 5000
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = bpe.token_path(name)
        got = bpe.encode(frame(spark, [(1, text, None, None, None), (1, text, None, None, None)]), "text", path, ["doc_id"]).collect()
        want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert [bytes(r["ids"]) for r in got] == [want, want]


def test_token_histogram(spark, odd):
    lens = [0, 3, 3, 7, 2000, 1023, 1024, 1024, 5000]
    h = token_counts.histogram(spark.createDataFrame([(n,) for n in lens], "n_tokens long"))
    for r in h.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lens.count(n), sum(x >= n for x in lens), sum(x for x in lens if x >= n))
        assert r["tokens_if_truncated"] == sum(min(x, n) for x in lens) and r["tokens_lost"] == sum(lens) - sum(min(x, n) for x in lens)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lens) / len(lens))
    for r in token_counts.totals_at(h, [1, 500, 9999]).collect():
        assert (r["docs_over"], r["tokens_if_truncated"]) == (sum(x > r["context"] for x in lens), sum(min(x, r["context"]) for x in lens))
    assert token_counts.quantiles(h, [0.5, 1.0]) == {0.5: sorted(lens)[4], 1.0: 5000}
    assert token_counts.lengths(odd, bpe.token_path("byte_bpe_50k.json")).count() == odd.count()
    assert token_counts.histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_fingerprints_and_edits(spark):
    rnd = random.Random(5)
    texts = {i * 3: "\n".join(sentence(rnd, 6) + ". " + sentence(rnd, 4) + "." for _ in range(rnd.randint(0, 12))) for i in range(40)}
    texts[1], texts[4] = texts[9], "é" * 7
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(spark, [(i, t, None, None, None) for i, t in texts.items()])).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_next"] <= 1
        assert got[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert got[1]["fingerprint"] == got[9]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))
    rich = [r for r in got.values() if len(texts[r["doc_id"]]) > 400]
    assert np.mean([r["near_edited"] for r in rich]) > np.mean([r["near_next"] for r in rich]) + 0.2


def test_fingerprints_are_homomorphic(spark):
    a, b = "one two.\nthree four. five", "six\nseven eight"
    rows = spark.createDataFrame([(1, a), (2, b), (3, b + "\n" + a), (4, "three four. five\none two."), (5, None), (6, "")], "doc_id long, text string")
    v = {r["doc_id"]: r["lanes"] for r in fingerprint.fingerprints(rows, ["doc_id"]).collect()}
    both = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>").select(
        fingerprint.combine(F.col("a"), F.col("b")).alias("s"), fingerprint.combine(F.col("c"), F.col("b"), True).alias("d")).first()
    assert both["s"] == v[3] and both["d"] == v[1] == v[4] and v[5] == v[6] == [0] * len(v[5])


def test_fingerprint_edges(spark, odd):
    assert fingerprint.compare_with_next(odd).count() == odd.count()
    assert fingerprint.compare_with_next(odd.limit(0)).count() == 0
    alone = fingerprint.compare_with_next(frame(spark, [(4, "abcd", None, None, None)])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def check_packing(docs, pieces, length, ids_of):
    windows, seen = {}, Counter()
    for p in pieces:
        ids = ids_of[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].astype("<u4").tobytes())
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["doc_id"]))
        seen[p["doc_id"]] += p["length"]
    assert seen == Counter({i: len(ids_of[i]) * n for i, n in Counter(docs).items()})
    assert sorted(windows) == list(range(len(windows)))
    for k, w in windows.items():
        at = 0
        for offset, size, _ in sorted(w):
            assert offset == at
            at += size
        assert at == length or k == len(windows) - 1
    return windows


def test_packing_keeps_the_mixture(spark):
    rnd, t = random.Random(6), Tokenizer.from_file(bpe.token_path("byte_bpe_50k.json"))
    rows = [(i, sentence(rnd, rnd.randint(0, 60)) if i % 9 else None, None, rnd.choice(["a", "a", "a", "b", None]), 0) for i in range(200)]
    ids = {r[0]: np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows}
    made = packing.pack(frame(spark, rows).repartition(5), bpe.token_path("byte_bpe_50k.json"), length=256, quantum=32).collect()
    windows = check_packing([r[0] for r in rows], made, 256, ids)
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for i, x in ids.items():
        total[source[i]] += len(x)
    served, all_tokens = Counter(), sum(total.values())
    for k in range(len(windows) - 1):
        for _, size, i in windows[k]:
            served[source[i]] += size
        for s in total:
            assert abs(served[s] - total[s] / all_tokens * 256 * (k + 1)) <= 2 * 32


def test_packing_edges(spark, odd):
    path = bpe.token_path("byte_bpe_50k.json")
    made = packing.pack(odd, path)
    assert made.agg(F.countDistinct("sequence_id")).first()[0] == made.agg(F.max("sequence_id")).first()[0] + 1
    assert made.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(odd.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, path, quantum=5000)


def test_packing_targets(spark):
    s = packing.Schedule([1280, 1280], [3.0, 1.0], 128)
    places = sorted((p, q) for q in (0, 1) for p in s.places(np.full(10, q), np.arange(10)).tolist())
    assert [p for p, _ in places] == [128 * i for i in range(20)]
    assert [q for _, q in places[:8]].count(0) == 6 and {q for _, q in places[-5:]} == {1}


def test_targets_hold_with_many_sources(spark):
    rnd = random.Random(19)
    rows = [(i, "x y", None, f"small{i}", 0) for i in range(1100)]
    rows += [(2000 + i, sentence(rnd, 60), None, "ab"[i % 2], 0) for i in range(60)]
    made = packing.pack(frame(spark, rows).repartition(3), bpe.token_path("byte_bpe_50k.json"), length=256, quantum=32,
                        targets={"a": 3000.0, "b": 1000.0, "small0": 1.0}).collect()
    source = {r[0]: r[3] for r in rows}
    served = Counter()
    for r in made:
        if r["sequence_id"] < 8:
            served[source[r["doc_id"]]] += r["length"]
    total = 8 * 256
    assert sum(served.values()) == total and {r["doc_id"] for r in made} == set(source)
    # A queue of a small share may wait for its first packet, so only the named ones are compared.
    assert served["b"] and abs(served["a"] - 3 * served["b"]) <= 4 * 32


def test_components(spark):
    rnd = random.Random(7)
    links = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_no_link_between_groups_is_lost(spark):
    # In one bucket, numbers are linked when they differ by one: only neighbours, never the leader.
    ids = list(range(0, 40)) + list(range(60, 75))
    members = spark.createDataFrame([(1, i) for i in ids] + [(2, 39), (2, 60)], "bucket long, id long")
    _, groups = link_buckets(members, lambda pairs: pairs.where("b - a = 1"))
    assert {r["id"]: r["root"] for r in groups.collect()} == {i: 0 if i < 40 else 60 for i in ids}


def test_an_id_is_first_compared_with_one_leader(spark):
    """Sixty copies in five buckets of different leaders: a pair for each copy, not for each copy and bucket."""
    members = spark.createDataFrame([(k, i) for k in range(5) for i in range(k, 60)], "bucket long, id long")
    seen = []

    def verify(pairs):
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs

    _, groups = link_buckets(members, verify)
    assert {r["id"]: r["root"] for r in groups.collect()} == dict.fromkeys(range(60), 0)
    assert len(seen) == 59


def brute_weighted(texts, idf):
    out = {}
    for i, t in texts.items():
        _, h, tf = shingles.text_shingles([t], 5)
        out[i] = (h, tf * idf[(h % np.uint64(minhash.DF_BINS)).astype(np.int64)])
    return out


def test_minhash_finds_near_copies(spark):
    rnd = random.Random(8)
    texts = {}
    for g in range(30):
        base = sentence(rnd, rnd.randint(12, 300)).split()
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(0, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = "changed" + str(rnd.randint(0, 99))
            texts[len(texts)] = " ".join(copy)
    rows = frame(spark, [(i, t, None, None, None) for i, t in texts.items()])
    counts, n = minhash.document_frequencies(rows.select("text"))
    vectors = brute_weighted(texts, minhash.idf_table(counts, n))
    assert counts.sum() == sum(len(v[0]) for v in vectors.values())
    group = {i: i for i in texts}
    for a in texts:
        for b in range(a):
            if minhash.weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    got = {r["doc_id"]: r for r in minhash.classes(rows).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == group
    assert minhash.keep_one(rows).count() == len(set(group.values())) == sum(r["kept"] for r in got.values())


def test_near_copies_do_not_depend_on_the_size_of_their_group(spark):
    """Edited copies of plain similarity 0.82 to 0.95: two rows in all, and a group of a third of all rows."""
    rnd = random.Random(18)
    base = sentence(rnd, 204).split()

    def copies(n):
        out = []
        for i in range(n):
            w = list(base)
            for k in rnd.sample(range(5, 200, 10), 1):      # five shingles lost, five made
                w[k] = f"edit{i}"
            out.append(" ".join(w))
        return out

    two = base[:]
    for k in (50, 100, 150):
        two[k] = "other" + str(k)
    a, b = (shingles.text_shingles([" ".join(x)])[1:] for x in (base, two))
    assert 0.82 < minhash.plain_jaccard(a, b) < 0.9
    assert len({r["class_id"] for r in minhash.classes(frame(spark, [(i, " ".join(x), None, None, None) for i, x in enumerate((base, two))]), plain=0.8).collect()}) == 1
    near = copies(30)
    rows = [(i, t, None, None, None) for i, t in enumerate(near + [sentence(rnd, 120) for _ in range(60)])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(frame(spark, rows), plain=0.8).collect()}
    assert {got[i] for i in range(30)} == {0} and len(set(got.values())) == 61


def test_consistent_sampling_estimates_similarity():
    rnd = np.random.default_rng(9)
    h = shingles.mix(np.arange(4000, dtype=np.uint64))
    wa, wb = rnd.uniform(0.5, 3, 4000), rnd.uniform(0.5, 3, 4000)
    zero = np.zeros(4000, np.int64)
    same = np.mean([(minhash.signatures(zero, shingles.mix(h + np.uint64(s)), wa, 1) == minhash.signatures(zero, shingles.mix(h + np.uint64(s)), wb, 1)).mean()
                    for s in range(40)])
    assert same == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_minhash_edges(spark, odd):
    got = minhash.classes(odd).collect()
    assert len(got) == odd.count() and len({r["class_id"] for r in got if r["doc_id"] in (1, 2)}) == 1
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert minhash.classes(odd.limit(0)).count() == 0 and minhash.keep_one(odd.limit(0)).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines(spark):
    rnd = random.Random(10)
    base = [sentence(rnd, 40) for _ in range(12)]
    docs = {}
    for i in range(30):
        lines = []
        for x in rnd.sample(base, 3):
            w = x.split()
            if rnd.random() < 0.5:
                w[rnd.randrange(40)] = "new" + str(rnd.randint(0, 9))
            lines.append(" ".join(w).capitalize() + rnd.choice(["", ".", " !"]))
        docs[i] = "\n".join(lines + ["", "***"])
    rows = frame(spark, [(i, t, None, None, None) for i, t in docs.items()])
    lines = line_dedup.lines_of(rows, "doc_id", "text")
    hashes = {r["id"]: r["payload"] for r in line_dedup.simhashes(lines).collect()}
    text = {r["line_id"]: r["line"] for r in lines.collect()}
    group = {i: i for i in text}
    for a in text:
        for b in text:
            longer = max(len(text[a]), len(text[b]))
            if a < b and bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= line_dedup.MAX_BITS and edit(text[a], text[b]) <= int(longer * 0.1 + 1e-9):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert len(set(group.values())) < len(group)
    ids = {v: k for k, v in text.items()}
    seen, want = set(), {}
    for i in sorted(docs):
        kept = []
        for x in docs[i].split("\n"):
            norm = re.sub(r"[^\w]+", " ", x.lower()).strip()
            g = group[ids[norm]] if norm else None
            if g is None or g not in seen:
                kept.append(x)
                seen.add(g)
        want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(rows).collect()} == want


@pytest.mark.parametrize("n", [5, 10, 20, 50])
def test_fuzzy_lines_are_found_by_edit_similarity_alone(spark, n):
    """Pairs of lines with nothing but their edit similarity in common; most were no candidates with 3 bits of a SimHash."""
    rnd = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(60):
        x = " ".join(word() for _ in range(n))
        y = list(x)
        for at in rnd.sample([k for k, c in enumerate(x) if c != " "], 1 if i % 2 else max(1, len(x) // 20)):
            y[at] = rnd.choice(letters.replace(x[at], ""))
        if edit(x, "".join(y)) <= len(x) * 0.1 + 1e-9:
            rows += [(2 * i, x, None, None, None), (2 * i + 1, "".join(y), None, None, None)]
    got = {r["doc_id"]: r["ld_dropped"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert sum(got[k] for k in got if k % 2 == 0) == 0
    assert sum(got[k] for k in got if k % 2) >= 0.95 * len(rows) / 2


def test_a_line_of_gigabytes_in_all_occurrences(spark):
    """Over 2^31 letters of one word in all: sums over the occurrences overflowed."""
    line = F.repeat(F.lit("ab"), 500_000)
    lines = spark.range(2_200, numPartitions=4).select(line.alias("line"), F.lit(7).cast("long").alias("line_id"))
    once = line_dedup.simhashes(lines.limit(1)).collect()
    assert line_dedup.simhashes(lines).collect() == once and len(once) == 1


def test_fuzzy_line_edges(spark, odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "ld_lines", "ld_dropped"] and got.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by_id[6] == "line one here\n\nother" and by_id[2] is None and by_id[1] == "" and by_id[7] == "\n\n"
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_quality_classifier_learns(spark, odd):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        text = ". ".join(sentence(rnd, 8) for _ in range(4)) if good else " | ".join(sentence(rnd, 2).upper() for _ in range(16))
        rows.append((i, text, None, None, 0))
        labels.append((i, good, 0))
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, marked).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([r["predicted"] == i % 2 for i, r in got.items() if r["held_out"]]) > 0.95
    none = quality_classifier.classify(odd, marked.where("false")).collect()
    assert len(none) == odd.count() and {r["score"] for r in none} == {0.5}
    assert quality_classifier.classify(odd.limit(0), marked).count() == 0


def test_ftrl_matches_a_plain_loop():
    rnd = np.random.default_rng(12)
    rows = [(np.array([*rnd.choice(6, 3, replace=False), 6]), rnd.normal(size=4), float(rnd.integers(2)), 1.0) for _ in range(50)]
    z, n = np.zeros(7), np.zeros(7)
    weight = lambda i: 0.0 if abs(z[i]) <= (0.02 if i < 6 else 0) else -(z[i] - np.sign(z[i]) * (0.02 if i < 6 else 0)) / ((1 + n[i] ** 0.5) / 0.3 + 0.001)
    for at, x, y, _ in rows:
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-np.dot(w, x)))
        for i, v, wi in zip(at, x, w):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * wi
            n[i] += g * g
    assert ftrl.ftrl(rows, 6, 1) == pytest.approx([weight(i) for i in range(7)])


def test_label_model_finds_the_classes():
    rnd = np.random.default_rng(13)
    y = rnd.random(20000) < 0.1
    accuracy = [(0.02, 0.7), (0.05, 0.8), (0.01, 0.6), (0.1, 0.9), (0.03, 0.5)]
    v = np.stack([np.where(y, rnd.random(20000) < b, rnd.random(20000) < a) for a, b in accuracy], 1)
    v = np.column_stack((v, np.where(rnd.random(20000) < 0.95, v[:, 0], ~v[:, 0])))     # a voter that copies the first
    patterns = Counter((v << np.arange(6)).sum(1).tolist())
    start = np.array([[0.1] * 6, [0.6] * 6])
    posterior, pairs = toxicity.label_model(patterns, start, 0.2, 6)
    assert (0, 5) in pairs
    p = posterior[(v << np.arange(6)).sum(1)]
    assert np.mean((p > 0.5) == y) > 0.97 and p.mean() == pytest.approx(0.1, abs=0.03)


def test_toxicity_learns(spark, odd):
    rnd = random.Random(14)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = sentence(rnd, 40).split()
        for _ in range(3 * bad):
            w[rnd.randrange(40)] = rnd.choice(["scumbag", "rotten", "filthy" + rnd.choice("abcdef")])
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, int(bad)))
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, marked).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    kept = toxicity.without_toxic(odd, marked)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.classify(odd.limit(0), marked).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ('<html lang="EN"><head><title>A &amp; <b>B</b></title><style>p{}</style></head><body><!-- x --><script>"</p>"</script>'
            '<p>One&nbsp;&#233;&#x41;&copy;</p>two<br>three <a href="/x">l</a>&unknown; &#99999999;</body></html>')
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", "<p>open")], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    rows = {(r["page_id"], r["record_type"]): r for r in made.collect()}
    assert len(rows) == 6
    text, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert text["block"] == "A & B\nOne éA©\ntwo\nthree l&unknown; &#99999999;"
    assert "title: A & B\r\nlanguage: en\r\noutlinks: 1\r\nhttp-HTTP/1.1 200 OK\r\nhttp-Content-Type: text/html; charset=utf-8\r\n" in meta["block"]
    assert meta["refers_to"] == text["refers_to"] and meta["record_id"] != text["record_id"]
    assert text["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    assert rows[2, "conversion"]["block"] == "" and rows[3, "conversion"]["block"] == "open"
    warc.write_warc(made, str(tmp_path / "warc"))
    back = {(r["record_id"]): r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    for r in rows.values():
        assert all(back[r["record_id"]][c] == r[c] for c in ("record_type", "refers_to", "target_uri", "block_digest", "block", "content_length"))
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_few_window_keys_and_bounds_of_the_edit_distance(spark):
    """Each long line had 20 band keys of samples that unlike lines share; a moved line keeps its windows."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdeghinorst") for _ in range(rnd.randint(2, 8)))
    x = " ".join(word() for _ in range(60))
    pairs = spark.createDataFrame([(x, "new " + x), (x, " ".join(word() for _ in range(60))), (x, x[:150] + x[160:])], "a string, b string")
    keys = [line_dedup.window_keys(F.col(c)) for c in "ab"]
    got = pairs.select(F.size(keys[0]).alias("n"), F.size(F.array_intersect(*keys)).alias("both"),
                       line_dedup.edit_similar(F.col("a"), F.col("b"), 0.9).alias("near")).collect()
    assert all(0 < r["n"] <= line_dedup.KEPT for r in got)
    assert got[0]["both"] and not got[1]["both"] and got[2]["both"]
    assert [r["near"] for r in got] == [True, False, True]


def test_a_passage_in_unlike_lines_makes_no_candidates(spark, monkeypatch):
    """Lines that share a passage in other places, or of other lengths, met in its buckets until all pairs were verified."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdeghinorst") for _ in range(rnd.randint(2, 8)))
    words = lambda n: [word() for _ in range(n)]
    passage, base = words(12), words(60)
    unlike = [" ".join(words(12 * k) + passage + words(60 - 12 * k)) for k in (0, 2, 4)] + [" ".join(passage + words(n)) for n in (20, 120, 300)]
    near = [" ".join(base), " ".join(base[:30] + ["new"] + base[30:]), " ".join(base[2:])]
    met = []
    monkeypatch.setattr(line_dedup, "link_buckets", lambda members, *_: met.append({r["id"] for r in members.collect()}) or (None, None))
    for lines in (unlike, near):
        rows = frame(spark, [(i, x, None, None, None) for i, x in enumerate(lines)])
        line_dedup.line_groups(line_dedup.lines_of(rows, "doc_id", "text"))
    assert not met[0] and len(met[1]) == 3


def test_bounds_of_the_edit_distance(spark):
    rnd = random.Random(15)
    pairs = []
    for i in range(120):
        x = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(7, 60)))
        y = list(x)
        for _ in range(rnd.randint(0, len(x) // 7)):
            at = rnd.randrange(len(y))
            y[at] = rnd.choice(("", "a", " ", y[at] + "b", y[at] + " c"))
        pairs.append((x, " ".join("".join(y).split())))
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select(
        F.levenshtein(a, b).alias("d"), F.greatest(F.length(a), F.length(b)).alias("n"), line_dedup.edit_similar(a, b, 0.9).alias("near"),
        line_dedup._pair(a, b, 0.9, line_dedup._walked).alias("most"), line_dedup._pair(a, b, 0.9, line_dedup._lost).alias("least")).collect()
    allowed = [int(r["n"] * 0.1 + 1e-9) for r in got]
    assert all(r["near"] == (r["d"] <= k) for r, k in zip(got, allowed)) and len({r["near"] for r in got}) == 2
    assert all(r["most"] >= min(r["d"], k + 1) and (r["d"] > k or r["least"] <= r["d"]) for r, k in zip(got, allowed))
