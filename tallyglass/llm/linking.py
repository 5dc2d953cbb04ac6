"""Groups of similar rows from shared buckets, without all pairs of a bucket.

`link_buckets` gets rows of (bucket, id) and a check of candidate pairs. The leader of a bucket is its least id.
An id is first compared with one leader only, the least of all its buckets: one pair for each id, however
large and many its buckets, and in a group of true copies that joins them all. Then it meets those of its other
leaders that are in another group. Only buckets whose members are then still in more than one group are looked
at again, with 8, 64, 512, ... leaders, each compared with the members of other groups, until every bucket is in
one group or all its pairs across groups have been checked. A pair with several buckets in common is listed in
the least of them. So no link between two groups is lost, and pairs inside a group are never listed.

Tables between rounds are written to the shared folder, so that lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.session import materialise


SMALL = 100_000   # rows of three longs at most that one task takes without a shuffle


def _compact(df: DataFrame) -> DataFrame:
    """Written to the shared folder; a small table becomes one partition, which needs no shuffles to be grouped or joined."""
    df = materialise(df)
    return df.coalesce(1) if df.count() <= SMALL else df


def components(links: DataFrame) -> DataFrame:
    """`id, root` for every id in links(a, b): the root is the least id that it is connected to.

    Each round sends every node to its least neighbour and contracts the links; a group of one
    centre needs one round, a chain of n nodes about log n. Ids are longs without nulls.
    """
    spark = links.sparkSession
    links = _compact(links.select("a", "b").where("a <> b"))
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _compact(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        at = lambda name: step.select(F.col("id").alias(name), F.col("root").alias(f"r_{name}"))  # noqa: E731, B023
        links = _compact(links.join(at("a"), "a").join(at("b"), "b")
                            .select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b"))
                            .where("a <> b").distinct())
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
            labels = _compact(labels.join(onward, "root", "left").select(
                "id", F.coalesce("next", "root").alias("root")))
    return labels if labels is not None else spark.createDataFrame([], "id long, root long")


def _families(star: DataFrame) -> DataFrame:
    """`id, family`: what is connected by shared buckets, so that all candidate pairs lie inside a family."""
    return components(star).select("id", F.col("root").alias("family"))


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], pairs_where=None,
                 payloads: DataFrame | None = None, prepare: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links(a, b), components(id, root)) of members(bucket, id).

    `verify` takes pairs(a, b) and returns the links among them; `pairs_where(pa, pb)` is a cheap condition on the
    payloads of a pair, tested before; `payloads` has one row of (id, payload) for each id. `prepare` gets the ids that
    share a bucket, once and before any pair; with it the pairs have a third column, `family`: the connected part of the
    candidates that they lie in. Equal rows count once.
    """
    ok = pairs_where or (lambda a, b: F.lit(True))
    leaders = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last")
    members = _compact(members.join(leaders.select("bucket", "leader"), "bucket").distinct())
    star = _compact(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    ids = members.select("id").distinct()
    if payloads is not None:
        payloads = _compact(payloads.join(ids, "id", "left_semi"))
    family = None
    if prepare:
        prepare(ids)
        family = _families(star)

    def checked(pairs: DataFrame, tested: bool = False) -> DataFrame:
        if payloads is not None and not tested:
            side = lambda n: payloads.select(F.col("id").alias(n), F.col("payload").alias(f"p{n}"))
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(ok(F.col("pa"), F.col("pb"))).select("a", "b")
        if family is not None:
            pairs = pairs.join(family.withColumnRenamed("id", "a"), "a").select("a", "b", "family")
        return _compact(verify(pairs).select("a", "b"))

    def rooted(pairs: DataFrame) -> DataFrame:
        """Pairs of different groups."""
        root = lambda n: groups.select(F.col("id").alias(n), F.col("root").alias(f"r{n}"))
        return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns(
            {"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")

    def merged(found: DataFrame) -> DataFrame:
        """The groups with what the links `found` join; only roots take part, which are few."""
        joined = components(rooted(found).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        moved = groups.join(joined.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left") \
            .select("id", F.coalesce("to", "root").alias("root"))
        return _compact(moved.union(joined.join(groups.select("id"), "id", "left_anti").select("id", "root")))

    first = star.groupBy("b").agg(F.min("a").alias("first"))
    links = checked(first.select(F.col("first").alias("a"), "b"))
    groups = components(links)
    found = checked(rooted(star.join(first, "b").where("a <> first")).select("a", "b"))
    if not found.isEmpty():
        links, groups = links.union(found), merged(found)
    members, width, done = members.select("bucket", "id"), 8, 1
    while True:
        named = members.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        members = _compact(named.join(mixed.select("bucket"), "bucket", "left_semi"))
        if members.isEmpty():
            return links, groups
        if done == 1:   # buckets that drop out later are in one group, so the least common one still counts
            members = members.join(members.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("own")), "id")
            members = _compact(members if payloads is None else members.join(payloads, "id"))
        # A limit by rank is applied before the shuffle too, so a large bucket is not sorted in one task.
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        # Those of earlier rounds have met every member already.
        heads = members.withColumn("rank", rank).where(F.col("rank") <= width).where(F.col("rank") > done).select("bucket", F.struct(
            *[c for c in members.columns if c != "bucket"]).alias("h"))
        pairs = members.join(heads, "bucket").where("id > h.id AND root <> h.root")
        if payloads is not None:
            pairs = pairs.where(ok(F.col("h.payload"), F.col("payload")))
        pairs = pairs.where(F.array_min(F.array_intersect("own", "h.own")) == F.col("bucket"))
        found = checked(pairs.select(F.col("h.id").alias("a"), F.col("id").alias("b")), tested=True)
        if not found.isEmpty():
            links, groups = links.union(found), merged(found)
        largest = members.groupBy("bucket").count().agg(F.max("count")).first()[0]
        if width >= largest:
            return links, groups
        members, done, width = members.drop("root"), width, width * 8
