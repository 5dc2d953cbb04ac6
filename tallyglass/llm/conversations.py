"""Conversation structure repair as a lightest derivation over edits, by Knuth's agenda.

A conversation is repaired when its roles read (system? (user assistant)+)? by their initials. The
edits of its rows are letters: K keeps a row, R gives it the role user or assistant, D deletes it,
I inserts an empty message. An item says that the rows from i to the end of a segment lead from one
state of that pattern to another; a deduction puts one more edit in front. The agenda pops items in the
order of their cost, then of the rows they cover, then of their audit (the edits' letters), and an item
that is popped is final: every deduction raises the cost or the rows covered. Two edit strings of
equal cost over the same rows are never a prefix of one another (what is longer has further inserts,
which cost), so the least audit of a whole is made of least audits of its parts.

So long conversations are cut: rows are dealt by range of (conversation, turn), every `SEGMENT` rows
become one row of items from each state to each state, and these are joined in pairs by the binary
deduction p to q, q to r gives p to r. No task holds more of a conversation than a segment and the
audits, which are part of the result. Repeated messages are found by a grouping before. Repairing
texts streams a conversation's rows through a task in their order, as one hash over them must.

Edge cases: a null role or text counts as one space, a null conversation id is a conversation of its own.
Null turns come first; rows of equal turn come by role, then by the digest of role and text, so repeated
rows stand next to each other and are duplicates but for the first. Roles with other initials
than s, u or a, and empty ones, have to be changed or deleted. A conversation without rows costs nothing. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States of the pattern: nothing yet, after system, after user, after assistant.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INTO = {q: [(p, x) for (p, x), to in STEP.items() if to == q] for q in range(4)}
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
BLANK, DUPLICATE, CUT = 1, 2, 3
_TEXT = r"[^\x20\x09-\x0D]"


def derive(rows: list[tuple[str, int]], end: int) -> dict[int, tuple[int, str]]:
    """Cost and audit of the lightest way from each state through rows (initial, fault) to the state `end`."""
    agenda, final = [(0, 0, "", end)], {}
    while agenda:
        cost, covered, audit, state = heapq.heappop(agenda)
        if (covered, state) in final:
            continue
        final[covered, state] = cost, audit
        new = [(cost + INSERT, covered, "I" + audit, p) for p, x in INTO[state] if x != "s"]
        if covered < len(rows):
            initial, fault = rows[-1 - covered]
            new.append((cost + DELETE, covered + 1, "D" + audit, state))
            if fault not in (BLANK, DUPLICATE):
                cost += TRUNCATED if fault == CUT else 0
                for p, x in INTO[state]:
                    if x == initial:
                        new.append((cost + KEEP, covered + 1, "K" + audit, p))
                    if x != "s":
                        new.append((cost + REROLE, covered + 1, "R" + audit, p))
        for item in new:
            if (item[1], item[3]) not in final:
                heapq.heappush(agenda, item)
    return {state: best for (covered, state), best in final.items() if covered == len(rows)}


def spans_of(rows: list[tuple[str, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    return {(p, q): best for q in range(4) for p, best in derive(rows, q).items()}


def join_spans(left: dict, right: dict) -> dict:
    out = {}
    for (p, q), (c, a) in left.items():
        for (q2, r), (d, b) in right.items():
            if q == q2 and ((p, r) not in out or (c + d, a + b) < out[p, r]):
                out[p, r] = c + d, a + b
    return out


class Segment:
    """Some consecutive rows of a conversation: their items, and counts that add up."""

    def __init__(self, rows: list[tuple[object, str, int]]):
        initials, faults = [r[1] for r in rows], [r[2] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        self.faults = [faults.count(k) for k in (BLANK, DUPLICATE, CUT)]
        self.illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
        self.first, self.last = initials[0], initials[-1]
        self.low, self.high = (turns[0], turns[-1]) if turns else (None, None)
        self.turns = len(set(turns))
        self.spans = spans_of([r[1:] for r in rows])

    def __add__(self, other: Segment) -> Segment:
        out = object.__new__(Segment)
        out.faults = [a + b for a, b in zip(self.faults, other.faults)]
        out.illegal = self.illegal + other.illegal + (self.last + other.first not in LEGAL)
        out.first, out.last = self.first, other.last
        out.low = other.low if self.low is None else self.low
        out.high = self.high if other.high is None else other.high
        out.turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        out.spans = join_spans(self.spans, other.spans)
        return out

    def packed(self) -> dict:
        return {**{k: v for k, v in vars(self).items() if k != "spans"},
                "spans": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.spans.items()]}

    @staticmethod
    def unpacked(row: dict) -> Segment:
        out = object.__new__(Segment)
        vars(out).update({**row, "spans": {(s["p"], s["q"]): (s["cost"], s["audit"]) for s in row["spans"]}})
        return out

    def summary(self) -> dict:
        cost, audit = min(self.spans[0, q] for q in ACCEPTED if (0, q) in self.spans)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(("blank", "duplicate", "truncated"), self.faults)) | {
            "gaps": gaps, "illegal": self.illegal, "cost": cost, "audit": audit}


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text with nulls as one space, and the digest that orders rows of one turn."""
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                      F.coalesce(text, F.lit(" ")).alias("text"))
    return out.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


ORDER = ("turn", "role", "digest")       # nulls first, Spark's default


def _faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, initial, fault of every message, without its text."""
    text = F.col("text")
    narrow = rows.select("conv", *ORDER, F.substring("role", 1, 1).alias("initial"), F.when(~text.rlike(_TEXT), BLANK).when(
        ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0).alias("fault"))
    narrow = materialise(narrow)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = narrow.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last") \
        .select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    later = narrow.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when((F.col("fault") != BLANK) & F.coalesce(F.col("first") < place, F.lit(False)), DUPLICATE).otherwise(F.col("fault"))
    return later.select("conv", *ORDER, "initial", fault.alias("fault"))


def _segments(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, number, conv, rows, before = TaskContext.get().partitionId(), 0, None, [], None
    out = []

    def close():
        nonlocal number, rows
        if rows:
            out.append({"conv": conv, "part": part, "number": number, "segment": Segment(rows).packed()})
            number, rows = number + 1, []

    for batch in batches:
        for c, turn, role, digest, initial, fault in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv or len(rows) == SEGMENT:
                close()
            # Copies of a row stand next to each other; those of other turns are marked already.
            fault = DUPLICATE if fault != BLANK and (c, turn, digest) == before else fault
            conv, before = c, (c, turn, digest)
            rows.append((turn, initial, fault))
        yield pa.RecordBatch.from_pylist(out, shape)
        out.clear()
    close()
    yield pa.RecordBatch.from_pylist(out, shape)


def _summaries(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments are joined as the digits of a binary counter carry, so that each letter is copied a logarithmic number of times."""
    conv, begun, counter, out = None, False, [], []

    def close():
        if counter:
            whole = counter[-1][1]
            for _, left in reversed(counter[:-1]):
                whole = left + whole
            out.append({"conv": conv, **whole.summary()})
            counter.clear()

    for batch in batches:
        for c, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not begun or c != conv:
                close()
            conv, begun = c, True
            counter.append((1, Segment.unpacked(segment)))
            while len(counter) > 1 and counter[-2][0] == counter[-1][0]:
                (n, left), (_, right) = counter[-2:]
                counter[-2:] = [(2 * n, left + right)]
        yield pa.RecordBatch.from_pylist(out, shape)
        out.clear()
    close()
    yield pa.RecordBatch.from_pylist(out, shape)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def diagnose(rows: DataFrame) -> DataFrame:
    """For every conversation of `messages`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind, turn = dict(rows.dtypes)["conv"], dict(rows.dtypes)["turn"]
    segment = (f"struct<faults: array<long>, illegal: long, first: string, last: string, low: {turn}, high: {turn}, turns: long, "
               "spans: array<struct<p: int, q: int, cost: long, audit: string>>>")
    cut, whole = _arrow(f"conv {kind}, part int, number long, segment {segment}"), _arrow(f"conv {kind}, {SUMMARY}")
    dealt = materialise(_faults(rows)).repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    pieces = dealt.select("conv", *ORDER, "initial", "fault").mapInArrow(
        lambda it: _segments(it, cut), f"conv {kind}, part int, number long, segment {segment}")
    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return ordered.select("conv", "segment").mapInArrow(lambda it: _summaries(it, whole), f"conv {kind}, {SUMMARY}")


def _with_audits(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Messages in order, each conversation's diagnosis before its first one."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    heads = diagnoses.select("conv", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("turn", "role", "text", "digest")],
                             F.struct(*names).alias("summary"))
    both = rows.select("conv", "turn", "role", "text", "digest", F.lit(None).cast(heads.schema["summary"].dataType).alias("summary")).unionByName(heads)
    head = F.col("summary").isNull()
    return both.repartition("conv").sortWithinPartitions("conv", head, *ORDER).select("conv", "turn", "role", "text", "summary")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, diagnosis or None, turn, role, text, edit): a conversation's diagnosis, then its repaired messages.

    Deleted messages are left out; None, None, ... ends a batch.
    """
    conv, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while audit[at:at + 1] == "I":
            x = "a" if state == 2 else "u"
            yield conv, None, None, ROLE[x], "", "I"
            at, state = at + 1, STEP[state, x]

    for batch in batches:
        for c, turn, role, text, summary in zip(*(x.to_pylist() for x in batch.columns)):
            if summary is not None:
                yield from inserted()
                conv, audit, at, state = c, summary["audit"], 0, 0
                yield conv, summary, None, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                x = role[:1] if edit == "K" else "a" if state == 2 else "u"
                state = STEP[state, x]
                yield conv, None, turn, role if edit == "K" else ROLE[x], text, edit
        yield None, None, None, None, None, None
    yield from inserted()


def repaired(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The repaired messages: conv, place (from 0), turn (null for inserted ones), role, text, edit."""
    kinds = dict(rows.dtypes)
    ddl = f"conv {kinds['conv']}, place long, turn {kinds['turn']}, role string, text string, edit string"
    shape = _arrow(ddl)

    def written(batches):
        out, place = [], 0
        for conv, summary, turn, role, text, edit in _edited(batches):
            if summary is not None:
                place = 0
            elif edit is None:
                yield pa.RecordBatch.from_pylist(out, shape)
                out.clear()
            else:
                out.append(dict(zip(shape.names, (conv, place, turn, role, text, edit))))
                place += 1
        yield pa.RecordBatch.from_pylist(out, shape)

    return _with_audits(rows, diagnoses).mapInArrow(written, ddl)


def digests(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The diagnoses with repaired_sha256, over the repaired messages as lines of role:text."""
    ddl = f"conv {dict(rows.dtypes)['conv']}, {SUMMARY}, repaired_sha256 string"
    shape = _arrow(ddl)

    def hashed(batches):
        out, open_one, sha, lines = [], None, None, 0

        def close():
            if open_one is not None:
                out.append({**open_one, "repaired_sha256": sha.hexdigest()})

        for conv, summary, _, role, text, edit in _edited(batches):
            if summary is not None:
                close()
                open_one, sha, lines = {"conv": conv, **summary}, hashlib.sha256(), 0
            elif edit is None:
                yield pa.RecordBatch.from_pylist(out, shape)
                out.clear()
            else:
                sha.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                lines += 1
        close()
        yield pa.RecordBatch.from_pylist(out, shape)

    return _with_audits(rows, diagnoses).mapInArrow(hashed, ddl)


def repair(rows: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(diagnoses, repaired messages) of the conversations in `rows`; `names` are those of its columns."""
    rows = messages(rows, **names)
    diagnoses = materialise(diagnose(rows))
    return diagnoses, repaired(rows, diagnoses)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults of the stated rule: some dropped, emptied, cut, repeated or of another role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), rule.alias("rule")).where("rule <> 0")
    changed = F.when(F.col("rule") == 1, F.lit("")).when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.select("conv_id", "turn", F.when(F.col("rule") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                         F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = messages(damaged(original))
    found = materialise(diagnose(rows))
    # A conversation of which no row is left has an empty audit.
    all_of = original.select(F.col("conv_id").alias("conv")).distinct().withColumns(
        {n: F.lit(0 if t == "long" else "").cast(t) for n, t in (f.split() for f in SUMMARY.split(", "))})
    whole = found.unionByName(all_of.join(found.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c")), "left_anti"))
    return digests(rows, whole).select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
