"""Tables of a tree as Parquet folders, artifacts, and the folder that cuts lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.1.0"

#: Columns of every table.
SCHEMAS = {
    "meta": "key string, value string",
    "raw_records": "id long, gedcom_xref string, tag string, level int, value string, parent_id long, line_no long",
    "individuals": "id long, gedcom_xref string, name_given string, name_surname string, name_full string, sex string, is_living int, birth_start string, birth_end string, death_start string, death_end string, lifespan_src string",
    "families": "id long, gedcom_xref string, husband_id long, wife_id long, marriage_start string, marriage_end string",
    "family_children": "family_id long, child_id long, link_type string",
    "events": "id long, subject_type string, subject_id long, event_type string, date_raw string, place_raw string, source_count long, note string, line_no long",
    "event_dates": "event_id long, date_start string, date_end string, precision string, qualifier string, parse_status string",
    "places": "id long, place_raw string, place_normalized string, lat double, lon double, radius_km double, precision_tier string, admin1 string, admin2 string, country string, geocode_source string, geocode_conf double, review_status string",
    "geocode_cache": "query_hash string, query_text string, response_json string, fetched_at string",
    "tag_counts": "tag string, n_lines long",
    "people_without_events": "gedcom_xref string",
    "kinship_edges": "from_id long, to_id long, edge_type string, weight double",
    "kinship_distance": "a_id long, b_id long, blood_degree int, graph_degree int, mrca_id long, same_branch int",
    "presence_intervals": "id long, individual_id long, event_id long, place_id long, date_start string, date_end string, role string, presence_conf double, precision_tier string, radius_km double",
    "presence_evidence": "interval_id long, event_id long",
    "candidate_pairs": "id long, a_interval_id long, b_interval_id long, a_id long, b_id long, overlap_start string, overlap_end string, overlap_days long, distance_km double, combined_radius double",
    "scored_candidates": "candidate_id long, score double, s_proximity double, s_temporal double, s_precision double, s_confidence double, s_unrelatedness double, s_independence double, explanation string, config_hash string, engine_version string",
    "context_cache": "query_hash string, request_json string, response_json string, status string, version string, fetched_at string",
    "suppression_log": "id long, a_id long, b_id long, reason string, detail string",
}

LATE = ("scored_candidates", "suppression_log", "candidate_pairs", "presence_intervals", "presence_evidence")

#: Tables that a pass makes stale.
STALE = {
    "ingest": (*LATE, "kinship_distance", "kinship_edges", "event_dates", "events", "family_children", "families", "individuals", "raw_records", "tag_counts", "people_without_events"),
    "dates": (*LATE, "event_dates"),
    "places": LATE,
    "kinship": ("kinship_distance", "kinship_edges"),
    "presence": LATE,
    "candidates": LATE[:3],
    "score": LATE[:2],
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir.  Only where executors run in the driver, as in tests, a local one serves if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='heirloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders of the ``scratch`` blocks that are open, the innermost last.
_open: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All that is settled inside goes to one folder, which is removed at the end of the block; passes over a store run in one."""
    path = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield path
    finally:
        _open.remove(path)
        p, fs = file_system(spark, path)
        fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """A path of Hadoop's and the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{_open[-1] if _open else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace(spark: SparkSession, fresh: str, path: str, aside: str) -> None:
    """Give a complete folder the name of an old one, which is moved aside first and deleted last."""
    (new, fs), (name, _), (old, _) = file_system(spark, fresh), file_system(spark, path), file_system(spark, aside)
    held = fs.exists(name)
    if held and not fs.rename(name, old) or not fs.rename(new, name):
        raise OSError(f"{path} was not replaced")
    if held:
        fs.delete(old, True)


class Store:
    """The tables of one tree under a root folder; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def exists(self, table: str) -> bool:
        """Whether a table is there.  If its last replacement stopped between its two renames, the old rows are put back."""
        p, fs = self._fs(f"{self.root}/{table}")
        if fs.exists(p):
            return True
        aside = fs.globStatus(self._fs(f"{self.root}/_old-{table}-*")[0])
        return bool(aside) and fs.rename(aside[0].getPath(), p)

    def read(self, table: str) -> DataFrame:
        if not self.exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}")

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Replace a table as a whole.  The rows are complete beside it before the old ones go, so a plan may read what it replaces.

        The old rows are moved aside, the new ones take their name, and only then the old ones are deleted: at every moment one of both is whole.
        """
        wanted = self.spark.createDataFrame([], SCHEMAS[table]).schema
        named = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        fresh = f"{self.root}/_{table}-{uuid.uuid4().hex}"
        named.write.parquet(fresh)
        replace(self.spark, fresh, f"{self.root}/{table}", f"{self.root}/_old-{table}-{uuid.uuid4().hex}")
        return self.read(table)

    def drop(self, table: str) -> None:
        p, fs = self._fs(f"{self.root}/{table}")
        if fs.exists(p):
            fs.delete(p, True)

    def clear_for(self, step: str) -> None:
        for table in STALE[step]:
            self.drop(table)

    def put_meta(self, **values: str) -> None:
        """Set keys; those set before and not named keep their values."""
        new = self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], SCHEMAS["meta"])
        old = self.read("meta").join(new, "key", "left_anti")
        self.write("meta", old.unionByName(new))

    def migrate(self) -> bool:
        """Create the tables unless the stored version is current; whether anything was done."""
        if self.read("meta").where((F.col("key") == "schema_version") & (F.col("value") == SCHEMA_VERSION)).limit(1).count():
            return False
        for table, schema in SCHEMAS.items():
            if not self.exists(table):
                self.write(table, self.spark.createDataFrame([], schema))
        self.put_meta(schema_version=SCHEMA_VERSION)
        return True

    def rebuild_derived(self) -> None:
        """Empty all tables but the caches and the places that people confirmed or corrected."""
        kept = self.read("places").where(F.col("review_status").isin("confirmed", "corrected"))
        self.write("places", kept)
        for table in SCHEMAS:
            if table not in ("meta", "places", "geocode_cache", "context_cache"):
                self.write(table, self.spark.createDataFrame([], SCHEMAS[table]))


def artifact_path(folder: str, name: str) -> Path:
    """Path of an artifact; names that leave the folder are refused."""
    base = Path(folder).resolve()
    path = (base / name).resolve()
    if path == base or not path.is_relative_to(base):
        raise ValueError(f"{name} lies outside {folder}")
    return path


def csv_line(columns: Sequence[str]) -> Column:
    """Values of a row as a line: quotes only where a comma, quote or line end needs them; nulls are empty."""
    need = lambda c: c.rlike(r'[",\r\n]')
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws(",", *[F.when(need(c), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in cells])


def write_csv(df: DataFrame, folder: str, name: str) -> Path:
    """Write a report as one CSV file: header, LF, quotes only where a comma, quote or line end needs them.

    Rows keep the order of ``df`` and come to the driver one partition at a time, as the file is one on its disk.
    """
    path = artifact_path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8", newline="") as out:
        out.write(",".join(df.columns) + "\n")
        for row in df.select(csv_line(df.columns).alias("value")).toLocalIterator():
            out.write(row["value"] + "\n")
    return path
