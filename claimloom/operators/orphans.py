"""References to records that do not exist: a keyed pending-orphan state.

``OrphanStore`` holds keyed tables on disk, as logs by batch.

* ``index``: per parent key the arrival of its first live row, its latest event
  and whether that event was a deletion; rows of one key merge by an aggregation,
  so a batch only adds its own;
* ``refs``, settled: references met in time.  An earlier arrival cannot be undone,
  so no later batch reads them again; whether their parent is deleted now is a
  property of its key and comes from the index;
* ``refs``, waiting: references without a live parent by their time, with the
  arrival known so far.  A later arrival adds a row; the least arrival counts.

``advance`` folds a batch of new references and new parent events into the
state: new references probe the index, arriving parents resolve waiting
orphans, deletions reopen references by their key and late parent rows with an
early arrival time heal them.  Of the references of earlier batches only the
waiting ones are read, of the index only the keys asked for are kept before
anything is shuffled.  Every so many batches the index and the waiting
references are merged into one base, so that a read never meets more.
Feeding events in any number of batches gives the same state as feeding them at
once (``first_state``).

A batch is written under its number and reads only lower numbers, so a batch that
is run again replaces itself, and a new process goes on from what lies on disk.

Statuses
    ``linked``    a live parent had arrived by the time of the reference
    ``orphan``    no live parent has arrived at all
    ``resolved``  a live parent arrived, but only after the reference
    ``reopened``  as linked or resolved, but the parent's latest row is a deletion

Defined results: null keys and null elements of arrays are no references; keys
are compared trimmed and lower-cased; a reference with a null time can have no
parent by its time and is an orphan in a null month; parent rows with a null
arrival never count as arrived; a null deletion mark counts as live; repeated
rows are one reference, counted as often as they occur in ``snapshot``; empty
inputs give empty outputs; other columns are ignored.

Scale: the index is pre-aggregated on the map side to one row per key before it
is joined, so the only skewed side is the reference side, which the adaptive
skew join may split at will.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import Staged

_BLANKS = " \t\n\r\f\u000b\u00a0\u2009\u202f\ufeff"

REF_SCHEMA = "ref_table string, ref_column string, row_id string, target string, ref_id string, ref_at timestamp_ntz"
EVENT_SCHEMA = "target string, ref_id string, at timestamp_ntz, is_deleted boolean"
INDEX_SCHEMA = "target string, ref_id string, live_at timestamp_ntz, last_at timestamp_ntz, last_deleted boolean"


def clean_key(c: Column) -> Column:
    """A key as it is compared: trimmed and lower-cased."""
    return F.lower(F.btrim(c, F.lit(_BLANKS)))


def references(df: DataFrame, table: str, column: str, target: str, row_id: str, at: str) -> DataFrame:
    """Rows of ``REF_SCHEMA`` out of a scalar or array column of keys."""
    is_array = df.schema[column].dataType.typeName() == "array"
    key = F.explode(F.array_distinct(F.transform(F.col(column), clean_key))) if is_array else clean_key(F.col(column))
    return df.select(
        F.lit(table).alias("ref_table"),
        F.lit(column).alias("ref_column"),
        F.col(row_id).alias("row_id"),
        F.lit(target).alias("target"),
        key.alias("ref_id"),
        F.col(at).cast("timestamp_ntz").alias("ref_at"),
    ).where(F.col("ref_id").isNotNull())


def parent_events(df: DataFrame, target: str, keys: list[str], at: str, deleted: str) -> DataFrame:
    """Rows of ``EVENT_SCHEMA``: every key (scalar or array column) a parent row can be named by."""
    parts = [
        F.transform(F.coalesce(F.col(k), F.array()), clean_key)
        if df.schema[k].dataType.typeName() == "array"
        else F.array(clean_key(F.col(k)))
        for k in keys
    ]
    return df.select(
        F.lit(target).alias("target"),
        F.explode(F.array_distinct(F.concat(*parts))).alias("ref_id"),
        F.col(at).cast("timestamp_ntz").alias("at"),
        F.coalesce(F.col(deleted), F.lit(False)).alias("is_deleted"),
    ).where(F.col("ref_id").isNotNull())


def build_index(events: DataFrame) -> DataFrame:
    """One row per parent key."""
    return events.groupBy("target", "ref_id").agg(
        F.min(F.when(~F.col("is_deleted"), F.col("at"))).alias("live_at"),
        F.max("at").alias("last_at"),
        # at equal times a live row outweighs a deletion
        F.max_by("is_deleted", F.struct("at", ~F.col("is_deleted"))).alias("last_deleted"),
    )


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References with ``in_time`` and ``status`` against an index."""
    return (
        refs.join(index, _KEY, "left")
        .withColumn("in_time", F.coalesce(F.col("live_at") <= F.col("ref_at"), F.lit(False)))
        .withColumn(
            "status",
            F.when(F.col("live_at").isNull(), "orphan")
            .when(F.col("last_deleted"), "reopened")
            .when(F.col("in_time"), "linked")
            .otherwise("resolved"),
        )
        .withColumn("resolved_at", F.when(F.col("in_time"), F.col("ref_at")).otherwise(F.col("live_at")))
        .drop("live_at", "last_at", "last_deleted")
    )


_REF = ["ref_table", "ref_column", "row_id", "target", "ref_id", "ref_at"]
_KEY = ["target", "ref_id"]
_WRITTEN = REF_SCHEMA + ", n long, live_at timestamp_ntz"
#: References of a batch up to which the hashes of their keys are sent to all tasks that read the index; beyond, the index is shuffled.
MAX_ASKED = 1_000_000


@dataclass
class OrphanState:
    """References with their status."""

    refs: DataFrame

    def unmet(self) -> DataFrame:
        """References for which no live parent had arrived by their time."""
        return (
            self.refs.where(~F.col("in_time"))
            .select(
                "ref_table", "ref_column", "row_id", "ref_id", F.date_format("ref_at", "yyyy-MM").alias("ref_month")
            )
            .distinct()
        )

    def snapshot(self) -> DataFrame:
        """Counts per table, column, month and status."""
        return self.refs.groupBy(
            "ref_table", "ref_column", F.date_format("ref_at", "yyyy-MM").alias("ref_month"), "status"
        ).agg(F.sum("n").alias("n_refs"), F.sum(F.when(~F.col("in_time"), F.col("n")).otherwise(0)).alias("n_unmet"))


def first_state(refs: DataFrame, events: DataFrame) -> OrphanState:
    """The state after one batch that holds everything, without a store."""
    return OrphanState(probe(refs, build_index(events)).withColumn("n", F.lit(1)))


class OrphanStore:
    """See the module text."""

    def __init__(self, spark: SparkSession, path: str, files: int = 64, merge_every: int = 16) -> None:
        self.spark, self.path, self.files, self.merge_every = spark, path, files, merge_every
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _kept(self, kind: str) -> list[tuple[int, int, str]]:
        """(number, 1 for a base, name) of what has been written whole, in order."""
        if not self._fs.exists(self._path(kind)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(kind))]
        whole = [x for x in names if self._fs.exists(self._path(kind, x, "_SUCCESS"))]
        return sorted((int(x.split("-")[1]), int(x.startswith("base")), x) for x in whole)

    def last_batch(self) -> int | None:
        """The number of the last batch folded in."""
        return max((number for number, _, _ in self._kept("refs")), default=None)

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _since_base(self, kind: str, before: int) -> list[str]:
        """Paths of the last base and the batches after it, below a number."""
        kept = [x for x in self._kept(kind) if x[0] < before]
        base = max((k for k, x in enumerate(kept) if x[1]), default=0)
        return [f"{self.path}/{kind}/{name}" for _, _, name in kept[base:]]

    def _index(self, before: int) -> DataFrame:
        return self._read(INDEX_SCHEMA + ", h long", self._since_base("index", before))

    def _parts(self, paths: list[str], late: int) -> DataFrame:
        """The waiting (1) or the settled (0) rows of batches of references."""
        paths = [f"{x}/late={late}" for x in paths]
        return self._read(_WRITTEN, [x for x in paths if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x))])

    def _waiting(self, before: int) -> DataFrame:
        return self._parts(self._since_base("refs", before), 1)

    def _write(self, df: DataFrame, kind: str, name: str) -> None:
        out = df.coalesce(self.files).write.mode("overwrite")
        (out.partitionBy("late") if kind == "refs" else out).parquet(f"{self.path}/{kind}/{name}")

    def advance(self, number: int, new_refs: DataFrame, new_events: DataFrame) -> None:
        """Fold one more batch in; numbers ascend.  A batch run again starts from the batches before it."""
        for kind in ("index", "refs"):
            for n, base, name in self._kept(kind):
                if n > number or n == number and base:
                    self._fs.delete(self._path(kind, name), True)
        self._write(build_index(new_events).withColumn("h", F.xxhash64(*_KEY)), "index", f"batch-{number}")
        new_refs = new_refs.select(*_REF, F.xxhash64(*_KEY).alias("h"))
        known = self._index(number + 1).where(F.col("live_at").isNotNull())
        if new_refs.count() <= MAX_ASKED:
            known = known.join(F.broadcast(new_refs.select("h")), "h", "left_semi")
        known = known.groupBy(*_KEY).agg(F.min("live_at").alias("live_at"))
        new = new_refs.join(known, _KEY, "left").select(*_REF, F.lit(1).cast("long").alias("n"), "live_at")
        new = new.withColumn("late", (~F.coalesce(F.col("live_at") <= F.col("ref_at"), F.lit(False))).cast("int"))
        # what waits for parents of this batch; the reference was counted when it came
        came = self._read(INDEX_SCHEMA, [f"{self.path}/index/batch-{number}"]).where(F.col("live_at").isNotNull()).select(*_KEY, F.col("live_at").alias("came"))
        met = self._waiting(number).join(came, _KEY).where(F.col("live_at").isNull() | (F.col("came") < F.col("live_at")))
        met = met.select(*_REF, F.lit(0).cast("long").alias("n"), F.col("came").alias("live_at"), F.lit(1).alias("late")).distinct()
        self._write(new.unionByName(met), "refs", f"batch-{number}")
        if number % self.merge_every == self.merge_every - 1:
            self._merge(number)

    def _merge(self, number: int) -> None:
        """Write the index and what waits after a batch as one base, and drop what no batch after the base before it reads."""
        self._write(_merged(self._index(number + 1)).withColumn("h", F.xxhash64(*_KEY)), "index", f"base-{number}")
        self._write(_counted(self._waiting(number + 1)).withColumn("late", F.lit(1)), "refs", f"base-{number}")
        for kind in ("index", "refs"):
            bases = [n for n, base, _ in self._kept(kind) if base]
            for n, base, name in self._kept(kind):
                if len(bases) > 1 and (n < bases[-2] or n == bases[-2] and not base):
                    # settled references are in no base
                    self._fs.delete(self._path(kind, name, *["late=1"] * (kind == "refs")), True)

    def state(self, up_to: int | None = None) -> OrphanState:
        """All references as they stand after a batch, by default the last."""
        last = self.last_batch() if up_to is None else up_to
        before = 0 if last is None else last + 1
        settled = self._parts([f"{self.path}/refs/{name}" for n, base, name in self._kept("refs") if n < before and not base], 0)
        waiting = _counted(self._waiting(before)).withColumn("in_time", F.coalesce(F.col("live_at") <= F.col("ref_at"), F.lit(False)))
        gone = _merged(self._index(before)).where("last_deleted").select(*_KEY, F.lit(True).alias("gone"))
        rows = settled.withColumn("in_time", F.lit(True)).unionByName(waiting).join(gone, _KEY, "left")
        status = F.when(F.col("live_at").isNull(), "orphan").when(F.col("gone"), "reopened").when(F.col("in_time"), "linked").otherwise("resolved")
        at = F.when(F.col("in_time"), F.col("ref_at")).otherwise(F.col("live_at"))
        # a reference may have come in several batches
        return OrphanState(rows.groupBy(*_REF, "in_time", status.alias("status"), at.alias("resolved_at")).agg(F.sum("n").alias("n")))


def _counted(waiting: DataFrame) -> DataFrame:
    """One row per waiting reference of a log."""
    return waiting.groupBy(*_REF).agg(F.sum("n").alias("n"), F.min("live_at").alias("live_at"))


def _merged(index: DataFrame) -> DataFrame:
    """One row per parent key of a log."""
    return index.groupBy(*_KEY).agg(
        F.min("live_at").alias("live_at"),
        F.max("last_at").alias("last_at"),
        F.max_by("last_deleted", F.struct("last_at", ~F.col("last_deleted"))).alias("last_deleted"),
    )


def fold_by_month(refs: DataFrame, events: DataFrame, path: str, files: int = 16) -> OrphanStore:
    """References and parent events folded month by month; those without a time come with the first."""
    spark = refs.sparkSession
    month = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit(""))
    # few files per month, but not one: a month may be a large part of all
    spread = lambda df: df.repartition("month", F.pmod(F.xxhash64(*_KEY), F.lit(4)))
    by_month = [Staged(spread(df.withColumn("month", month(at))), label, partition="month") for df, at, label in ((refs, "ref_at", "month-refs"), (events, "at", "month-events"))]
    r, e = (x.df for x in by_month)
    store = OrphanStore(spark, path, files)
    months = r.select("month").union(e.select("month")).distinct().orderBy("month").collect()
    for number, (m,) in enumerate(months):
        store.advance(number, r.where(F.col("month").eqNullSafe(m)), e.where(F.col("month").eqNullSafe(m)))
    for x in by_month:
        x.drop()
    return store


def fact_graph_references(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """All references of the fact graph."""
    out = references(facts, "facts", "evidence_ids", "elements", "fact_id", "extracted_at")
    for column in ("fact_a_id", "fact_b_id"):
        out = out.unionByName(
            references(relationships, "relationship_results", column, "facts", "relationship_id", "reasoned_at")
        )
    return out


def fact_graph_parents(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """All parent events of the fact graph."""
    return parent_events(elements, "elements", ["element_id", "evidence_ids"], "ingested_at", "is_deleted").unionByName(
        parent_events(facts, "facts", ["fact_id"], "loaded_at", "is_deleted")
    )
