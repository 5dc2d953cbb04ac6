"""Homomorphic document fingerprints, in DataFrame functions only.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two. So the order of paragraphs does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector (`combine`).

The vector has `EQUAL` lanes modulo 2^32 from the paragraph's SHA-256, which tell multisets of
paragraphs apart, and `SIGNS` lanes modulo 2^16 that add +1 or -1 for each of the paragraph's
sentences, by the bits of its MD5. The latter are also a sketch: products of two documents' lanes
estimate how many sentences they share, `likeness` = 2 <a, b> / (<a, a> + <b, b>), from 0 to 1, with
an error of about 1 / sqrt(SIGNS / 2); equal fingerprints give 1.

Edge cases: null text counts as empty: no paragraph, all lanes 0. An empty line is a paragraph
too. Rows of equal id are ordered by the hash of their text; null ids come last. Repeated rows each get
a result. A single document is its own next. An empty table gives an empty result. A text of more
than 2^31 sentences is more than the counters hold.
"""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.plans.registry import query, table

EQUAL = 8
SIGNS = 128
BUCKET_CHARS = 4_000_000
MIN_BUCKETS, MAX_BUCKETS = 64, 4096
LAST = (1 << 63) - 1


def _number(hex_: Column, at: int, digits: int = 8) -> Column:
    return F.conv(F.substring(hex_, at + 1, digits), 16, 10).cast("long")


def sums(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lane sums of rows(keys, text) by key: e0..e7, and two signed lanes in each of v0..v63, n sentences."""
    paragraphs = F.when(F.col(text) != "", F.split(text, "\n"))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.transform(
        F.split(p, r"(?<=[.!?]) +"), lambda s, i: F.struct(F.when(i == 0, p).alias("p"), s.alias("s")))))
    units = rows.select(*keys, F.explode_outer(sentences).alias("u")).select(
        *keys, F.sha2(F.col("u.p"), 256).alias("p"), F.md5(F.col("u.s")).alias("s"))
    half = lambda k: F.shiftleft(_number(F.col("s"), 16 * k), 32).bitwiseOR(_number(F.col("s"), 16 * k + 8))
    units = units.select(*keys, "p", F.col("s").isNotNull().cast("long").alias("one"), half(0).alias("h0"), half(1).alias("h1"))
    lanes = [F.sum(_number(F.col("p"), 8 * i)).alias(f"e{i}") for i in range(EQUAL)]
    ones = F.lit((1 << 32) + 1)
    lanes += [F.sum(F.shiftright(f"h{k}", j).bitwiseAND(ones)).alias(f"v{32 * k + j}") for k in (0, 1) for j in range(32)]
    return units.groupBy(*keys).agg(F.sum("one").alias("n"), *lanes)


def vector(n: Column) -> Column:
    """The fingerprint as an array of lanes, each within its modulus."""
    equal = [F.coalesce(F.col(f"e{i}"), F.lit(0)) % (1 << 32) for i in range(EQUAL)]
    low = [F.pmod(2 * F.coalesce(F.col(f"v{i}"), F.lit(0)).bitwiseAND(F.lit((1 << 32) - 1)) - n, F.lit(1 << 16)) for i in range(SIGNS // 2)]
    high = [F.pmod(2 * F.shiftright(F.coalesce(F.col(f"v{i}"), F.lit(0)), 32) - n, F.lit(1 << 16)) for i in range(SIGNS // 2)]
    return F.array(*equal, *low, *high)


def as_text(lanes: Column) -> Column:
    """Hex: 8 digits for a lane of the first kind, 4 for one of the second."""
    return F.lower(F.array_join(F.transform(lanes, lambda x, i: F.when(i < EQUAL, F.lpad(F.hex(x), 8, "0"))
                                            .otherwise(F.lpad(F.hex(x), 4, "0"))), ""))


def combine(a: Column, b: Column, subtract: bool = False) -> Column:
    """The fingerprint array of both documents' paragraphs, or of a without those of b."""
    changed = F.zip_with(a, b, lambda x, y: x - y if subtract else x + y)
    return F.transform(changed, lambda x, i: F.pmod(x, F.when(i < EQUAL, F.lit(1 << 32)).otherwise(F.lit(1 << 16))))


def likeness(a: Column, b: Column) -> Column:
    """Share of common sentences, estimated from two fingerprint arrays."""
    signed = lambda v: F.transform(F.slice(v, EQUAL + 1, SIGNS), lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x).cast("double"))
    parts = F.zip_with(signed(a), signed(b), lambda x, y: F.struct((2 * x * y).alias("p"), (x * x + y * y).alias("q")))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    ratio = F.aggregate(parts, zero, lambda s, x: F.struct((s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")),
                        lambda s: F.when(s["q"] > 0, s["p"] / s["q"]).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys, lanes` for each distinct key (which should tell rows apart)."""
    clean = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("fp_text"))
    return sums(clean, "fp_text", keys).select(*keys, vector(F.coalesce(F.col("n"), F.lit(0))).alias("lanes"))


def _in_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """bucket, place, id, t, next_text: rows dealt into ranges of the id, each with the text that follows.

    The first row of a range is also sent to the range before it (the first of all to the last), so that
    every range finds its followers itself and the texts are shuffled once. Ranges hold about
    `BUCKET_CHARS` characters each; the driver gets one id for each of at most `MAX_BUCKETS` of them.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.length("t")).alias("chars")).first()["chars"] or 0
    n = min(MAX_BUCKETS, max(MIN_BUCKETS, size // BUCKET_CHARS))
    cuts = rows.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # Two levels of cuts, so that a row is compared with about 2 sqrt(n) of them.
    step = max(1, int(len(cuts) ** 0.5))
    heads = [cuts[i] for i in range(step - 1, len(cuts), step)]
    groups = [cuts[i:i + step] for i in range(0, max(len(cuts), 1), step)]
    groups += [[]] * (len(heads) + 1 - len(groups))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("o")))
    rows = rows.withColumn("g", below(array(heads)))
    rows = rows.withColumn("bucket", F.col("g") * (step + 1) + below(F.get(F.array(*[array(g) for g in groups]), F.col("g"))))
    firsts = [(r["bucket"], r["o"]) for r in rows.groupBy("bucket").agg(F.min("o").alias("o")).orderBy("bucket").collect()]
    to = [(o, firsts[i - 1][0], int(i == 0)) for i, (_, o) in enumerate(firsts)]
    ghosts = docs.sparkSession.createDataFrame(to, "o long, to int, wrap int")
    rows = rows.join(F.broadcast(ghosts), "o", "left")       # MAX_BUCKETS rows at most
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    sent = F.struct(F.col("to").alias("b"), F.col("wrap"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("x", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, sent))))
    order = Window.partitionBy("bucket").orderBy("wrap", "o", F.xxhash64("t"), "ghost")
    rows = rows.select(F.col("x.b").alias("bucket"), F.col("x.wrap").alias("wrap"), F.col("x.ghost").alias("ghost"), "o", "id", "t")
    return rows.withColumns({"next_text": F.lead("t").over(order), "place": F.row_number().over(order)})


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its fingerprint, its edited text's, and how alike they and the next document's are."""
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = _in_order(docs, id_col, text).withColumn("edited", F.when(~F.col("ghost"), edited))
    keys = ["bucket", "place", "ghost", "id", "n_chars", "edited_sha256", "tag"]
    both = rows.select("bucket", "place", "ghost", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("t").alias("t")),
                                         F.struct(F.lit(1).alias("tag"), F.col("edited").alias("t")))).alias("x")) \
        .select("bucket", "place", "ghost", "id", "n_chars", "edited_sha256", "x.tag", "x.t")
    # Grouped by the range first: the rows of a range are in one task already, so nothing is shuffled again.
    lanes = sums(both, "t", keys).select(*keys, vector(F.coalesce(F.col("n"), F.lit(0))).alias("lanes"))
    order = Window.partitionBy("bucket").orderBy("place", "tag")
    lanes = lanes.withColumns({"edited": F.lead("lanes", 1).over(order), "next": F.lead("lanes", 2).over(order)})
    return lanes.where("tag = 0 AND NOT ghost").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next")).alias("near_next"))


@query("op7_multiset_fingerprint")
def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
