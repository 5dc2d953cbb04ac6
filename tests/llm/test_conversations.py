"""Conversation repair against a plain search over all edit strings, and a plain dynamic programme for longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyglass.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?")


def fault_of(rows, i):
    role, text = rows[i][1:]
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else ""


def brute(rows, most=None):
    """(cost, audit, repaired messages) by trying every string of edits with up to `most` inserts at each place."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    gap = [list(x) for n in range((most or 2) + 1) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        extra = 3 if fault == "truncated" else 0
        options = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            options += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        choices += [[("I" * len(g), 3 * len(g), [(r, "") for r in g]) for g in gap], options]
    choices.append([("I" * len(g), 3 * len(g), [(r, "") for r in g]) for g in gap])
    for pick in itertools.product(*choices):
        out = [m for _, _, x in pick if x for m in (x if isinstance(x, list) else [x])]
        if GOAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            found = (sum(c for _, c, _ in pick), "".join(a for a, _, _ in pick), out)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def expected(rows):
    faults = [fault_of(rows, i) for i in range(len(rows))]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = brute(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit), out


def some_rows(rnd, n):
    return [(rnd.choice([None, 1, 2, 3, 5, 9]), rnd.choice(["user", "assistant", "system", "tool", ""]),
             rnd.choice(["Hi.", "Yes!", "cut", " \n", "", "So?  ", "x. "])) for _ in range(n)]


def in_order(rows):
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))


@pytest.mark.parametrize("segment", [64, 2])
def test_against_all_edit_strings(spark, monkeypatch, segment):
    rnd = random.Random(segment)
    conversations = {k: in_order(some_rows(rnd, rnd.randint(1, 3))) for k in range(40)}
    conversations[None] = [(None, "user", "Hi."), (4, "assistant", "Hi.")]
    rows = [(k, *r) for k, v in conversations.items() for r in v]
    rnd.shuffle(rows)
    # Cut in the driver too: one segment and several give the same.
    for v in conversations.values():
        listed = [(t, r[:1], {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[fault_of(v, i)]) for i, (t, r, _) in enumerate(v)]
        parts = [cv.Segment(listed[i:i + segment]) for i in range(0, len(listed), segment)]
        whole = parts[0]
        for p in parts[1:]:
            whole += p
        assert whole.summary() == cv.Segment(listed).summary()
    found, fixed = cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r["conv"]: tuple(r)[1:] for r in found.collect()}
    texts = {}
    for r in sorted(fixed.collect(), key=lambda r: r["place"]):
        texts.setdefault(r["conv"], []).append((r["role"], r["text"]))
    assert len(got) == len(conversations)
    for k, v in conversations.items():
        summary, out = expected(v)
        assert got[k] == summary, v
        assert texts.get(k, []) == out


def test_long_conversations_are_cut_without_a_difference(spark):
    """Equal to a plain left-to-right programme over (state) with whole audits."""
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "user", "assistant", "system"]), rnd.choice(["a.", "b.", f"t{t}.", f"t{t}", " "])) for t in range(700)]
    seen, best = set(), {0: (0, "")}

    def insert(best):
        for _ in range(3):
            for s in list(best):
                for x in "ua":
                    if (s, x) in cv.STEP:
                        new = best[s][0] + 3, best[s][1] + "I"
                        to = cv.STEP[s, x]
                        best[to] = min(best.get(to, new), new)
        return best

    for _, t, role, text in in_order_turns(rows):
        best, after = insert(best), {}
        fault = "b" if not text.strip() else "d" if (role, text) in seen else "t" if text[-1] != "." else ""
        seen.add((role, text))
        for s, (c, a) in best.items():
            new = [(s, c + 4, "D")]
            if fault not in ("b", "d"):
                e = 3 if fault == "t" else 0
                new += [(cv.STEP[s, x], c + e + w, k) for x, w, k in ((role[0], 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (s, x) in cv.STEP]
            for to, cost, k in new:
                after[to] = min(after.get(to, (cost, a + k)), (cost, a + k))
        best = after
    best = insert(best)
    found, fixed = cv.repair(spark.createDataFrame(rows, SCHEMA))
    row = found.collect()
    assert len(row) == 1 and (row[0]["cost"], row[0]["audit"]) == min(best[s] for s in (0, 3))
    roles = "".join(r["role"][0] for r in sorted(fixed.collect(), key=lambda r: r["place"]))
    assert GOAL.fullmatch(roles)


def in_order_turns(rows):
    return sorted(rows, key=lambda r: r[1])


def test_damage_and_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, t, rnd.choice(["user", "assistant", None]), rnd.choice(["One. Two!", "Three?", None])) for k in (*range(60), None) for t in (0, 1, 2, None)][:-1]
    rows += [(1000 + k, 0, "user", "x.") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    left = {}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        rule = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        left.setdefault(conv, [])
        if rule:
            r = (turn, "user" if rule == 4 else name(role), {1: "", 2: re.sub("[.!?]", "", name(text))}.get(rule, name(text)))
            left[conv] += [r, r] if rule == 3 else [r]
    got = {r["conv_id"]: r for r in cv.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and any(not v for v in left.values())
    for k, v in left.items():
        if not v:
            assert tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        elif len(v) < 4:
            summary, out = expected(in_order(v))
            assert tuple(got[k])[1:-1] == summary
            assert got[k]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_empty(spark):
    found, fixed = cv.repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and fixed.count() == 0
