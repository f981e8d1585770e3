"""Pass 1: intervals of events, lifespans of people, marriages of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heirloom.config import Config, load_config
from heirloom.functions.dates import normalize_date
from heirloom.sources.progress import report, warn
from heirloom.sources.store import Store, settle


def with_dates(df: DataFrame, *keys: str, settings: dict | None = None) -> DataFrame:
    """Add the struct d of the dates that ``keys`` write: a text and, if open dates are to be clamped, the start and end of a life.

    Files write the same date many times, so each is read once.  The distinct ones are few bytes but slow to read, hence a
    fixed number of partitions, which Spark won't merge.  They are written, so that the join back is a broadcast if they are
    small and splits a frequent date if not.
    """
    spark = df.sparkSession
    written = df.select(*keys).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    raw, *life = [F.col(k) for k in keys]
    read = settle(written.withColumn("d", normalize_date(raw, *life, settings=settings)), "dates")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("e").join(read.alias("r"), on, "left").select("e.*", "r.d")


def life_bounds(dated: DataFrame) -> DataFrame:
    """subject_id, life_start, life_end: earliest start of a birth and latest end of a death, of dates that stand without guessing.

    ``dated``: events with the struct d of their dates, nothing clamped.  Burials don't count, and neither
    do open dates: these bounds clamp open dates.
    """
    d = dated.where("subject_type = 'individual' AND event_type IN ('BIRT', 'DEAT') AND d.date_start IS NOT NULL AND d.precision <> 'inferred'")
    at = lambda kind, field: F.when(F.col("event_type") == kind, F.col(f"d.{field}"))
    return d.groupBy("subject_id").agg(F.min(at("BIRT", "date_start")).alias("life_start"), F.max(at("DEAT", "date_end")).alias("life_end"))


def dated_events(events: DataFrame, settings: dict | None = None) -> DataFrame:
    """``events`` with the struct d of their dates; open dates of people are clamped to their lives.

    Only events decide: running the pass again gives the same rows.  Both steps are written to the shared
    folder; a written date is read once, and again only with the bounds of lives that open dates are clamped to.
    """
    plain = settle(with_dates(events, "date_raw", settings=settings), "dates")
    bounds = life_bounds(plain).withColumn("subject_type", F.lit("individual"))
    both = plain.join(bounds, ["subject_type", "subject_id"], "left")
    known = F.coalesce("life_start", "life_end").isNotNull()
    # wherever the qualifier stands, after a calendar too, its letters are in the text
    again = known & F.col("date_raw").rlike("(?i)BEF|AFT")
    again = F.coalesce(again, F.lit(False))
    clamped = with_dates(both.where(again).drop("d"), "date_raw", "life_start", "life_end", settings=settings)
    return settle(both.where(~again).unionByName(clamped).drop("life_start", "life_end"), "dated")


def event_dates(dated: DataFrame) -> DataFrame:
    return dated.where("d.date_start IS NOT NULL").select(F.col("id").alias("event_id"), "d.date_start", "d.date_end", "d.precision", "d.qualifier", "d.parse_status")


def lifespans(people: DataFrame, dated: DataFrame) -> DataFrame:
    """``people`` with birth and death bounds: burials count as deaths here."""
    at = lambda kinds, field: F.when(F.col("event_type").isin(*kinds), F.col(f"d.{field}"))
    birth, death = ("BIRT",), ("DEAT", "BURI")
    life = dated.where("subject_type = 'individual' AND d.date_start IS NOT NULL").groupBy(F.col("subject_id").alias("id")).agg(
        F.min(at(birth, "date_start")).alias("birth_start"), F.max(at(birth, "date_end")).alias("birth_end"),
        F.min(at(death, "date_start")).alias("death_start"), F.max(at(death, "date_end")).alias("death_end"),
    )
    stated = F.col("birth_start").isNotNull() | F.col("death_start").isNotNull()
    return people.drop("birth_start", "birth_end", "death_start", "death_end", "lifespan_src").join(life, "id", "left").withColumn("lifespan_src", F.when(stated, "stated").otherwise("unknown"))


def marriages(families: DataFrame, dated: DataFrame) -> DataFrame:
    """``families`` with the interval of their last marriage event that has one."""
    m = dated.where("subject_type = 'family' AND event_type = 'MARR' AND d.date_start IS NOT NULL")
    last = m.groupBy(F.col("subject_id").alias("id")).agg(F.max_by("d", "id").alias("m"))
    t = families.drop("marriage_start", "marriage_end").join(last, "id", "left")
    return t.select(*families.drop("marriage_start", "marriage_end").columns, F.col("m.date_start").alias("marriage_start"), F.col("m.date_end").alias("marriage_end"))


def run(store: Store, config: Config | None = None) -> dict:
    config = config or load_config()
    dated, seen = dated_events(store.read("events"), config["date"]), Observation("dates")
    store.clear_for("dates")
    counts = {
        "events_in": F.count(F.lit(1)), "rows_out": F.count_if(F.col("d.date_start").isNotNull()), "unparsed": F.count_if(F.col("d.date_start").isNull()), "partial": F.count_if(F.col("d.parse_status") == "partial"),
        "clamped_open_intervals": F.count_if(F.col("d.qualifier").rlike("BEF|AFT")),
    }
    store.write("event_dates", event_dates(dated.observe(seen, *[c.alias(n) for n, c in counts.items()])))
    store.write("individuals", lifespans(store.read("individuals"), dated))
    store.write("families", marriages(store.read("families"), dated))
    n = seen.get
    warn("dates", n["unparsed"], "events have no date, or none that could be read")
    return report("dates", **n)
