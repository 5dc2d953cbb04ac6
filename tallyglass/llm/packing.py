"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

Every source is a queue of its documents' tokens, cut into packets of `QUANTUM` tokens. Packets are
served in the order of (p + 1/2) / share, the order in which a round-robin with deficits serves them
when it gives every queue its share of each window and carries over what a queue got too little or
too much: no queue is ever more than about a packet from its target, in any window, and a
queue that runs dry leaves its share to the others. Since that order is a formula, a packet's place
follows from the queues' sizes alone: the place among all packets is the sum, over the queues, of
the packets that come earlier. So the deficits are carried across windows and partitions without any
sequential pass; tasks only need the tokens that precede their rows in each queue.

The default shares are those of the corpus, with which all queues last to the end; explicit shares
hold until a queue is empty. Windows are full but for the last one. Documents are cut where packets
or windows end; a document's pieces that stand next to each other in one window are one piece.

Of more than `MAX_QUEUES` sources those with a target keep queues of their own; the others share `MAX_QUEUES`
queues by hash, so that the table of queues, which all tasks get, is bounded, and a shared queue has
the sum of its sources' shares. Every document is packed in any case.

Edge cases: null text counts as empty and is one separator token. A null source is a queue of its
own. Repeated rows are packed as often as they stand there. Tokenised texts with equal sources follow
each other as they are read. An empty table gives no pieces.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.bpe import encode_once, token_path
from tallyglass.plans.registry import query, table
from tallyglass.session import checkpoint_dir, materialise

LENGTH = 1024
QUANTUM = 128
MAX_QUEUES = 1024
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _numbered(batches: Iterator[pa.RecordBatch], separator: int) -> Iterator[pa.RecordBatch]:
    """(ids, queue, id) to (id, queue, part, first token in this task's share of the queue, tokens, ids).

    A document's ids are kept in 16 bits where they fit, which its number of bytes a token tells.
    """
    part, served = TaskContext.get().partitionId(), {}
    end = np.array([separator], "<u4").tobytes()
    for batch in batches:
        whole = [np.frombuffer((x or b"") + end, "<u4") for x in batch.column(0).to_pylist()]
        ids = [(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in whole]
        queues, first = batch.column(1).to_pylist(), []
        for q, x in zip(queues, whole):
            first.append(served.get(q, 0))
            served[q] = first[-1] + len(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(first, pa.int64()),
             pa.array([len(x) for x in whole], pa.int64()), pa.array(ids, pa.binary())],
            names=["id", "queue", "part", "first", "n", "ids"])


class Schedule:
    """Places of packets, from the tokens of each queue and its share."""

    def __init__(self, tokens: list[int], shares: list[float] | None, quantum: int = QUANTUM):
        self.tokens, self.quantum = np.array(tokens, np.int64), quantum
        self.packets = -(-self.tokens // quantum)
        self.shares = np.array(shares if shares else self.packets, np.float64)
        self.short = self.packets * quantum - self.tokens       # what the last packet lacks

    def _time(self, p: np.ndarray, q) -> np.ndarray:
        return (p + 0.5) / self.shares[q]

    def places(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """First token's place in the packed stream, for packets p of queues q."""
        time = self._time(p, q)
        place = np.zeros(len(p), np.int64)
        for other in range(len(self.tokens)):
            def earlier(k, other=other):
                t = self._time(k, other)
                return (t < time) | ((t == time) & (other < q))
            before = np.clip(np.floor(time * self.shares[other] - 0.5).astype(np.int64) + 1, 0, self.packets[other])
            for _ in range(2):   # rounding is set right by the comparison that defines the order
                before -= ((before > 0) & ~earlier(before - 1)).astype(np.int64)
            for _ in range(2):
                before += ((before < self.packets[other]) & earlier(before)).astype(np.int64)
            before = np.where(q == other, p, before)
            place += before * self.quantum - np.where(before == self.packets[other], self.short[other], 0)
        return place


def pieces_of(schedule: Schedule, q: np.ndarray, first: np.ndarray, n: np.ndarray,
              length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces (document number, start, size, place) of documents [first, first + n) of their queues."""
    u = schedule.quantum
    low, high = first // u, (first + n - 1) // u
    count = high - low + 1
    doc = np.repeat(np.arange(len(n)), count)
    packet = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    begin = np.maximum(packet * u, first[doc])
    end = np.minimum((packet + 1) * u, (first + n)[doc])
    place = schedule.places(q[doc], packet) + begin - packet * u
    cut = np.minimum(end - begin, length - place % length)       # a packet is no longer than a window: one cut at most
    rest = end - begin - cut
    more = np.flatnonzero(rest)
    doc = np.concatenate((doc, doc[more]))
    begin, size, place = (np.concatenate(x) for x in ((begin, (begin + cut)[more]), (cut, rest[more]), (place, (place + cut)[more])))
    order = np.lexsort((begin, doc))
    doc, begin, size, place = doc[order], begin[order], size[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != (place + size)[:-1]) | (place[1:] % length == 0)
    at = np.flatnonzero(new)
    return doc[at], (begin - first[doc])[at], np.add.reduceat(size, at) if len(at) else size, place[at]


def _placed(batches: Iterator[pa.RecordBatch], names: dict[str, int], schedule: Schedule, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            queue, first, n, ids = (part.column(k) for k in (1, 2, 3, 4))
            q = np.array([names[x] for x in queue.to_pylist()], np.int64)
            n = n.to_numpy(zero_copy_only=False)
            raw = [np.frombuffer(x, "<u2").astype("<u4").tobytes() if len(x) == 2 * k else x for x, k in zip(ids.to_pylist(), n.tolist())]
            doc, start, size, place = pieces_of(schedule, q, first.to_numpy(zero_copy_only=False), n, length)
            crc = [zlib.crc32(memoryview(raw[d])[4 * a:4 * (a + k)]) for d, a, k in zip(doc.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[doc], place // length, place % length))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH,
         quantum: int = QUANTUM, separator: int = 0, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `targets` are shares by source; sources without one get the least of them. Tokens are written once
    to the shared folder, since the queues' sizes have to be known before any is placed.
    """
    if not 0 < quantum <= length:
        raise ValueError("a quantum is at least one token and at most a window")
    spark = docs.sparkSession
    named = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    few = docs.select(named.alias("q")).distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES
    wanted = {f"s{k}": v for k, v in (targets or {}).items()}
    hashed = F.concat(F.lit("h"), F.pmod(F.xxhash64(named), F.lit(MAX_QUEUES)).cast("string"))
    queue = named if few else F.when(named.isin(list(wanted)), named).otherwise(hashed) if wanted else hashed
    rows = docs.select(F.col(text).alias("pk_text"), queue.alias("pk_queue"), F.col(id_col).alias("pk_id"))
    kind = dict(rows.dtypes)["pk_id"]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    short, seen, long = encode_once(rows, "pk_text", path, ["pk_queue", "pk_id"], lambda it: _numbered(it, separator),
                                    f"id {kind}, queue string, part int, first long, n long, ids binary")
    short.write.option("compression", "snappy").parquet(folder)
    if seen.get["long"]:    # parts of their own
        long().withColumn("part", F.col("part") + (1 << 30)).write.mode("append").option("compression", "snappy").parquet(folder)
    tokens = spark.read.parquet(folder)
    shares = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))     # a row for each task and queue
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = materialise(shares.select("queue", "part", "n", before.alias("base")))
    queues = base.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()   # MAX_QUEUES rows and one for each target at most
    names = {r["queue"]: i for i, r in enumerate(queues)}
    weights = None
    if targets:
        least = min(targets.values())
        if few:
            weights = [targets.get(r["queue"][1:], least) for r in queues]
        else:
            sources = docs.select(named.alias("q"), queue.alias("queue")).distinct().groupBy("queue").count()
            n_sources = {r["queue"]: r["count"] for r in sources.collect()}     # a row for each queue
            weights = [wanted.get(r["queue"], least * n_sources[r["queue"]]) for r in queues]
    schedule = Schedule([r["n"] for r in queues], weights, quantum)
    located = tokens.join(base.select("queue", "part", "base"), ["queue", "part"]).select(
        "id", "queue", (F.col("first") + F.col("base")).alias("first"), "n", "ids")
    out = located.mapInArrow(lambda it: _placed(it, names, schedule, length), f"id {kind}, {PIECES}")
    return out.withColumnRenamed("id", id_col)


@query("op8_mixture_packing")
def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return pack(docs, token_path("byte_bpe_50k.json"))
