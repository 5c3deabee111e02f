"""File sources with validated headers, and sinks that swap in whole snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.durable import settled
from quillspark.functions import text


def csv_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header; header names are trimmed, of a byte order mark too, and compared in lower case."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip().lower().replace(" ", "_") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def roster(spark: SparkSession, path: str) -> DataFrame:
    """People of a roster file with their line number, and an ``error`` for rows that must not be imported."""
    return checked_roster(numbered_lines(csv_rows(spark, path, ["orcid", "display_name", "person_kind"])))


def checked_roster(df: DataFrame) -> DataFrame:
    """Rows (orcid, display_name, person_kind) with clean ORCID and kind, and the ``error`` of each."""
    orcid, kind = text.normalize_orcid(F.col("orcid")), F.lower(F.btrim("person_kind"))
    error = F.when(orcid.isNull(), "bad orcid").when(~F.coalesce(text.orcid_checksum_ok(orcid), F.lit(False)), "bad checksum").when(~F.coalesce(kind.isin("internal", "external"), F.lit(False)), "bad kind").when(~text.nonblank(F.col("display_name")), "no name")
    return df.withColumn("error", error).withColumn("orcid", orcid).withColumn("person_kind", kind)


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Works of a bibliography file: doi, title, venue, year and the authors as an array of "Last, First"."""
    df = csv_rows(spark, path, ["doi", "title", "publication_title", "publication_year", "author"])
    names = F.filter(F.transform(F.split("author", ";"), lambda a: F.btrim(a)), lambda a: a != "")
    return df.select(text.normalize_doi(F.col("doi")).alias("doi"), F.btrim("title").alias("title"), F.btrim("publication_title").alias("venue"), F.col("publication_year").try_cast("int").alias("year"), names.alias("authors"))


def merge_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(loser_pub_id, winner_pub_id); a blank or equal pair is an error."""
    df = csv_rows(spark, path, ["loser_pub_id", "winner_pub_id"]).select(F.col("loser_pub_id").try_cast("long").alias("loser"), F.col("winner_pub_id").try_cast("long").alias("winner"))
    if not df.filter("loser is null or winner is null or loser = winner").isEmpty():
        raise ValueError(f"{path} has blank or equal pairs")
    return df


def id_list(argument: str) -> list[int]:
    """Ids of ``1,2,3`` in order of first mention."""
    return list(dict.fromkeys(int(x) for x in argument.replace("\n", ",").split(",") if x.strip() and x.strip() != "pub_id"))


def id_file(spark: SparkSession, path: str) -> DataFrame:
    """(place, pub_id) of a CSV file of ids, with or without a header ``pub_id``; the first mention of an id counts, other texts are an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.btrim(F.split_part("value", F.lit(","), F.lit(1))).alias("x")).filter("x <> '' and lower(x) <> 'pub_id'")
    if not lines.filter("x not rlike '^[0-9]+$'").isEmpty():
        raise ValueError(f"{path} holds something that is no id")
    return lines.groupBy(F.col("x").cast("long").alias("pub_id")).agg(F.min("place").alias("place"))


def refresh_batch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((place, orcid, display_name), (place, pub_id)) of rows (place, pub_id, paper_orcid, display_name_at_pub): each valid ORCID once, in order,
    with the first name that isn't blank; each valid work id of such rows once."""
    clean = rows.select("place", F.btrim("pub_id").try_cast("long").alias("pub_id"), text.normalize_orcid(F.col("paper_orcid")).alias("orcid"), F.when(text.nonblank(F.col("display_name_at_pub")), F.btrim("display_name_at_pub")).alias("name")).filter("orcid is not null")
    people = clean.groupBy("orcid").agg(F.min("place").alias("place"), F.min(F.when(F.col("name").isNotNull(), F.struct("place", "name"))).alias("n"))
    works = clean.filter("pub_id is not null").groupBy("pub_id").agg(F.min("place").alias("place"))
    return people.select("place", "orcid", F.col("n.name").alias("display_name")), works.select("place", "pub_id")


def numbered_lines(df: DataFrame) -> DataFrame:
    """Rows of a file with their line number (2 is the first after the header): partitions are counted, then numbered; nothing is sorted."""
    held = settled(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "lines")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).select("__part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return held.join(F.broadcast(starts), "__part").withColumn("line", (F.col("start") + F.col("__at") - F.col("first") + 2).cast("long")).drop("__part", "__at", "first", "start")


EXPORT = ["pub_id", "doi", "title", "year", "venue", "source_of_truth", "internal_authors"]


def export_order(df: DataFrame) -> DataFrame:
    """The export's columns and order: newest first with unknown years last, then title, then id."""
    return df.select(*EXPORT).orderBy(F.col("year").desc_nulls_last(), F.lower("title").asc_nulls_last(), "pub_id")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder with one file in the given order; see :func:`write_named_csv` for one file of a name."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_named_csv(df: DataFrame, path: str) -> None:
    """One CSV file of the given name: null and empty as nothing, lines end with a newline; the file appears whole or not at all."""
    spark, draft = df.sparkSession, f"{path}.draft-{uuid.uuid4().hex}"
    write_csv(df, draft)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(draft)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)


def hours_since(snapshot: DataFrame, now: Column) -> DataFrame:
    """One row: hours since the newest refreshed_at; 1e9 for an empty snapshot."""
    newest = F.unix_timestamp(F.max("refreshed_at"))
    return snapshot.agg(F.coalesce((F.unix_timestamp(now) - newest) / 3600.0, F.lit(1e9)).alias("hours"))


def has_columns(df: DataFrame, columns: list[str]) -> bool:
    """A readiness probe: the exact columns can be read (no row is)."""
    return df.columns == columns and df.select(*columns).limit(0).count() == 0


def described(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str, bool]]:
    """(table, position, column, type, nullable) of tables."""
    return [(name, k, f.name, f.dataType.simpleString(), f.nullable) for name in sorted(tables) for k, f in enumerate(tables[name].schema.fields, 1)]


class Snapshots:
    """Sets of tables published together: files first, then one manifest that names them all.

    Manifests are numbered and never changed; the highest number counts. A crash at any point leaves the last set that was published.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def publish(self, at: str, **tables: DataFrame) -> str:
        """Write all tables, then rename a finished manifest to the next number. Of two writers at once one fails."""
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{version}/{name}")
        body = json.dumps({"version": version, "refreshed_at": at, "tables": sorted(tables)})
        draft = self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        number = (self._numbers() or [0])[-1] + 1
        target = self._path(f"{self.path}/manifest-{number:020d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError("another writer has published meanwhile")
        return version

    def manifest(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{self._numbers()[-1]:020d}.json").first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest()['version']}/{name}")
