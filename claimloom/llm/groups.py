"""Consolidating pairwise matches into groups: hash-to-min connected components.

The cluster of a vertex is held as rows ``(v, u)``, one per member, so that the
cluster of a giant group is spread over as many rows as it has members and never
gathered in one task.  One round:

* every vertex finds the minimum of its cluster (a hash aggregation, combined on
  the map side, so a hot vertex costs one row per task);
* it sends its cluster to the minimum and the minimum to all members, which in
  rows is ``(m, u)`` and ``(u, m)`` for every ``(v, u)``;
* the rows are made distinct.

Rounds end when the clusters stay as they are, after O(log n) rounds.  Each round
is written to the shared folder, so a lost executor costs one task, not the run.

Vertices are 64-bit hashes while iterating.  The hashes are checked against the
ids; if two ids ever share a hash, the next seed is tried, and after
``MAX_SEEDS`` of them ids are numbered instead, so groups never mix.  The group's
name is its smallest id by code point, found by an aggregation at the end.

Defined results: rows with a null id are no pairs; a pair of an id with itself is
a group of one; repeated and reversed pairs count once; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import Staged

MAX_SEEDS = 4


def _hash_to_min(edges: DataFrame) -> Staged:
    """(v, m): the least vertex of the component of every vertex.  edges: long columns a, b."""
    # every vertex belongs to its own cluster
    clusters = Staged(
        edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("r"))
        .select("r.*")
        .distinct(),
        "clusters",
    )
    before = None
    while True:
        c = clusters.df
        least = c.groupBy("v").agg(F.min("u").alias("m"))
        sent = c.join(least, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("r")
        )
        after = Staged(sent.select("r.*").distinct(), "clusters")
        # clusters only move towards their minimum; they are stable once the rows are the same set
        size = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        clusters.drop()
        clusters = after
        if size == before:
            break
        before = size
    labels = Staged(clusters.df.groupBy("v").agg(F.min("u").alias("m")), "labels")
    clusters.drop()
    return labels


def _vertices(pairs: DataFrame, seed: int) -> Staged:
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    if seed < MAX_SEEDS:
        return Staged(ids.select("id", F.xxhash64(F.lit(seed), "id").alias("v")), "vertices")
    return Staged(ids.select("id", F.monotonically_increasing_id().alias("v")), "vertices")


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group_id) of every id that occurs in a pair with both ids."""
    pairs = (
        pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
        .distinct()
    )
    for seed in range(MAX_SEEDS + 1):
        vertices = _vertices(pairs, seed)
        if seed == MAX_SEEDS:
            ends = vertices.df
            edges = pairs.join(ends.toDF("id_a", "a"), "id_a").join(ends.toDF("id_b", "b"), "id_b").select("a", "b")
            break
        counts = vertices.df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
        if (counts[0] or 0) <= 1:
            edges = pairs.select(F.xxhash64(F.lit(seed), "id_a").alias("a"), F.xxhash64(F.lit(seed), "id_b").alias("b"))
            break
        vertices.drop()
    labels = _hash_to_min(edges)
    named = vertices.df.join(labels.df, "v").select("id", "m")
    # the name of a group is a property of one row per group, so the join back has one skewed side only
    names = named.groupBy("m").agg(F.min("id").alias("group_id"))
    return named.join(names, "m").select("id", "group_id")


def label_of(c: Column) -> Column:
    """A classification however spelled: upper case, words joined by one underscore, without the enum's name."""
    word = F.regexp_replace(F.upper(F.btrim(c, F.lit(" \t\n\r "))), r"^.*\.", "")
    return F.regexp_replace(word, r"[\s_-]+", "_")


def same_claim_groups(matches: DataFrame) -> DataFrame:
    """(fact_id, group_id) over rows classified SAME_CLAIM."""
    rows = matches.where(label_of(F.col("classification")) == "SAME_CLAIM").select("fact_a_id", "fact_b_id")
    return connected_groups(rows, "fact_a_id", "fact_b_id").select(F.col("id").alias("fact_id"), "group_id")
