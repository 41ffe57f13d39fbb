"""Sources and sinks: PDF files, canonical JSON, sessions.

Layout parsing of PDF is external: ``parse_with`` takes a callable per file.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a parser has to return per file, one row per element.
PARSED = "document_id string, page_no int, pos int, element_id string, element_type string, content string, left double, top double, error string"

FACTS = (
    "document_id string, facts array<struct<fact_id:string,fact_type:string,subject:struct<name:string,type:string>,predicate:string,"
    "object:struct<value_type:string,value:string,unit:string,currency:string,scale:string,qualifier:string>,"
    "time:struct<time_type:string,value:string,start_date:string,end_date:string>,scope:string,qualifiers:array<string>,"
    "confidence:double,evidence_ids:array<string>>>, _corrupt_record string"
)
MATCHES = "matches array<struct<match_id:string,fact_a_id:string,fact_b_id:string,classification:string,confidence:double>>, _corrupt_record string"


def document_id(path: Column, sha: Column) -> Column:
    """SRC-3: slug of the file's stem and the start of its hash."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    slug = F.btrim(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(slug, F.lit("-"), F.substring(sha, 1, 6))


def _empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths of files without content, which the binary source leaves out; a listing, no reading."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs, glob = root.getFileSystem(spark._jsc.hadoopConfiguration()), re.compile(fnmatch.translate(pattern))
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and glob.match(f.getPath().getName()):
            found.append(f.getPath().toString())
    return found


def pdf_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-1, SRC-2, SRC-13: files with hash, id and what is wrong with them (null if nothing).

    A file that cannot be used is a row with an error, not a failed job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    empty = spark.createDataFrame([(p, 0, bytearray()) for p in _empty_files(spark, path, pattern)], files.schema)
    files = files.unionByName(empty)
    sha = F.sha2("content", 256)
    error = F.when(F.length("content") == 0, "File is empty").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "File signature is not PDF")
    return files.select("path", F.col("length").alias("file_size_bytes"), sha.alias("sha256"), document_id(F.col("path"), sha).alias("document_id"), error.alias("error"), "content")


def parse_with(files: DataFrame, parse: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """SRC-4, SRC-5: elements of usable files; a parser's exception becomes an error row."""
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for r in batch.itertuples():
                try:
                    rows += [{**dict.fromkeys(columns), **e, "document_id": r.document_id} for e in parse(r.path, r.content)]
                except Exception as e:  # the parser is not ours: whatever it raises is this file's error
                    rows.append({**dict.fromkeys(columns), "document_id": r.document_id, "error": str(e)[:500]})
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("error").isNull()).select("path", "document_id", "content").mapInPandas(run, PARSED)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7, SRC-9: flat facts of a file or folder of fact JSON; unreadable files are skipped, a repeated id keeps its last file's row."""
    files = spark.read.schema(FACTS).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))
    good = files.where(F.col("_corrupt_record").isNull() & F.col("document_id").isNotNull())
    rows = good.select("document_id", "file", F.posexplode("facts").alias("fact_seq", "f")).where(F.col("f.fact_id").isNotNull())
    last = rows.groupBy("f.fact_id").agg(F.max_by(F.struct("document_id", "fact_seq", "f"), F.struct("file", "fact_seq")).alias("r"))
    f = F.col("r.f")
    return last.select(
        "fact_id",
        "r.document_id",
        "r.fact_seq",
        f["fact_type"].alias("fact_type"),
        f["subject"]["name"].alias("subject_name"),
        f["subject"]["type"].alias("subject_type"),
        f["predicate"].alias("predicate"),
        *(f["object"][k].alias(n) for k, n in (("value_type", "value_type"), ("value", "value_raw"), ("unit", "unit"), ("currency", "currency"), ("scale", "scale"), ("qualifier", "value_qualifier"))),
        *(f["time"][k].alias(n) for k, n in (("time_type", "time_type"), ("value", "time_value"), ("start_date", "time_start"), ("end_date", "time_end"))),
        *(f[k].alias(k) for k in ("scope", "qualifiers", "confidence", "evidence_ids")),
    )


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: rows of match sessions."""
    s = spark.read.schema(MATCHES).option("multiLine", "true").json(path)
    return s.where(F.col("_corrupt_record").isNull()).select(F.explode("matches").alias("m")).select("m.*")


def facts_as_json(facts: DataFrame) -> DataFrame:
    """SNK-2: one JSON text per document, as ``read_facts`` reads it back.

    The facts of a document make one JSON file by definition; for documents of
    unbounded size write the flat table instead.
    """
    fact = F.struct(
        "fact_id",
        "fact_type",
        F.struct(F.col("subject_name").alias("name"), F.col("subject_type").alias("type")).alias("subject"),
        "predicate",
        F.struct("value_type", F.col("value_raw").alias("value"), "unit", "currency", "scale", F.col("value_qualifier").alias("qualifier")).alias("object"),
        F.struct("time_type", F.col("time_value").alias("value"), F.col("time_start").alias("start_date"), F.col("time_end").alias("end_date")).alias("time"),
        "scope",
        "qualifiers",
        "confidence",
        "evidence_ids",
    )
    return facts.groupBy("document_id").agg(F.array_sort(F.collect_list(fact)).alias("facts"))


def write_json(df: DataFrame, path: str) -> None:
    """SNK-1..3."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """The same as columnar files, partitioned if asked."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-4: an audit table."""
    df.write.mode("overwrite").option("header", "true").csv(path)
