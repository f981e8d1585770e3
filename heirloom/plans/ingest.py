"""Pass 0: a genealogy file to people, families, children and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heirloom.config import Config, load_config
from heirloom.functions.kin import link_type
from heirloom.functions.text import group, trimmed
from heirloom.operators.hierarchy import assembled, clean, first_child, with_tree
from heirloom.operators.ids import dense_ids
from heirloom.sources.gedcom import UNPARSED, parse_lines, read_lines
from heirloom.sources.progress import report, warn
from heirloom.sources.store import Store, settle

# Tags of facts that count as events.
EVENT_TAGS = ("BIRT", "CHR", "BAPM", "RESI", "CENS", "MARR", "DIV", "DEAT", "BURI", "IMMI", "EMIG", "MILI", "OCCU", "PROB", "WILL", "EVEN")


def xref_of(value):
    """The reference that a value is, or null."""
    return group(trimmed(value), r"\A(@[^@\s\x{A0}]+@)\z")


def line_table(lines: DataFrame) -> DataFrame:
    """Lines (line_no, raw) of one file parsed, with record, parent, the parent's tag and full value.

    Each step reads its lines more than once (ends of buckets, continuations), so what it reads is written.
    """
    parsed = settle(parse_lines(lines).drop("raw"), "parsed")
    return assembled(settle(with_tree(parsed), "tree"))


def raw_records(lines: DataFrame) -> DataFrame:
    """Every line; ids are line numbers."""
    return lines.select(F.col("line_no").alias("id"), F.col("record_xref").alias("gedcom_xref"), "tag", "level", "value", F.col("parent_line").alias("parent_id"), "line_no")


def roots(lines: DataFrame, tag: str) -> DataFrame:
    """line_no and xref of the records of a kind that have one.  Of records with the same xref the first is kept."""
    found = lines.where((F.col("level") == 0) & (F.col("tag") == tag) & F.col("xref").isNotNull())
    return found.groupBy("xref").agg(F.min("line_no").alias("line_no"))


def children_of(lines: DataFrame, parents: DataFrame, keep: list[str]) -> DataFrame:
    """Lines whose parent is a line of ``parents`` (line_no and ``keep``)."""
    p = parents.select(F.col("line_no").alias("parent_line"), *keep)
    return lines.select("line_no", "parent_line", "tag", "value", "full").join(p, "parent_line")


def below(lines: DataFrame, parents: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Lines of some tags right below lines of some others: few of all, and only these are shuffled."""
    return lines.where(F.col("parent_tag").isin(*parents) & F.col("tag").isin(*tags))


def people(lines: DataFrame, living_cutoff: int) -> DataFrame:
    """One row for each person: id, gedcom_xref, names, sex, is_living."""
    base = dense_ids(settle(roots(lines, "INDI"), "roots"), "line_no")
    own = below(lines, ("INDI",), ("NAME", "BIRT", "SEX", "DEAT", "BURI")).groupBy(F.col("parent_line").alias("line_no")).agg(
        F.min(F.when(F.col("tag") == "NAME", F.struct("line_no", "full"))).alias("n"), F.min(F.when(F.col("tag") == "BIRT", F.col("line_no"))).alias("birth_line"),
        first_child("SEX", clean(F.col("value"))).alias("sex"), F.bool_or(F.col("tag").isin("DEAT", "BURI")).alias("dead"),
    ).select("line_no", F.col("n.line_no").alias("name_line"), clean(F.col("n.full")).alias("name_full"), "birth_line", "sex", "dead")
    parts = below(lines, ("NAME",), ("GIVN", "SURN")).groupBy(F.col("parent_line").alias("name_line")).agg(
        F.bool_or(F.col("tag") == "GIVN").alias("has_given"), F.bool_or(F.col("tag") == "SURN").alias("has_surname"),
        first_child("GIVN", clean(F.col("full"))).alias("given"), first_child("SURN", clean(F.col("full"))).alias("surname"),
    )
    years = below(lines, ("BIRT",), ("DATE",)).groupBy(F.col("parent_line").alias("birth_line")).agg(first_child("DATE", F.col("value")).alias("date"))
    t = base.join(own, "line_no", "left").join(parts, "name_line", "left").join(years, "birth_line", "left")
    slashed = r"\A([^\n\r]*?)\s*/([^/]*)/"
    part = lambda flag, value, n: F.when(F.col(flag), F.col(value)).otherwise(clean(group(F.col("name_full"), slashed, n)))
    year = group(F.col("date"), r"([0-9]{3,4})").cast("int")
    living = ~F.coalesce("dead", F.lit(False)) & (year.isNull() | (year > living_cutoff))
    return t.select("line_no", F.col("xref").alias("gedcom_xref"), part("has_given", "given", 1).alias("name_given"), part("has_surname", "surname", 2).alias("name_surname"), "name_full", "sex", living.cast("int").alias("is_living"), "id")


def families(lines: DataFrame, persons: DataFrame) -> DataFrame:
    """One row for each family: id, gedcom_xref, husband_id, wife_id; references that lead nowhere are null."""
    base = dense_ids(settle(roots(lines, "FAM"), "roots"), "line_no")
    couple = below(lines, ("FAM",), ("HUSB", "WIFE")).groupBy(F.col("parent_line").alias("line_no")).agg(first_child("HUSB", F.col("value")).alias("h"), first_child("WIFE", F.col("value")).alias("w"))
    found = base.join(couple, "line_no", "left").select("line_no", "xref", "id", xref_of(F.col("h")).alias("h"), xref_of(F.col("w")).alias("w"))
    who = lambda name: persons.select(F.col("gedcom_xref").alias(name), F.col("id").alias(f"{name}_id"))
    both = found.join(who("h"), "h", "left").join(who("w"), "w", "left")
    return both.select("line_no", F.col("xref").alias("gedcom_xref"), F.col("h_id").alias("husband_id"), F.col("w_id").alias("wife_id"), "id")


def family_children(lines: DataFrame, persons: DataFrame, fams: DataFrame) -> DataFrame:
    """family_id, child_id, link_type: the link is what the child says of this family in its first FAMC line that names it.

    A child listed twice in a family is one row.
    """
    f = fams.select("line_no", F.col("id").alias("family_id"), F.col("gedcom_xref").alias("family_xref"))
    listed = children_of(below(lines, ("FAM",), ("CHIL",)), f, ["family_id", "family_xref"]).select("family_id", "family_xref", xref_of(F.col("value")).alias("child_xref"))
    p = persons.select(F.col("id").alias("child_id"), F.col("gedcom_xref").alias("child_xref"))
    links = listed.join(p, "child_xref").distinct()
    said = children_of(below(lines, ("INDI",), ("FAMC",)), persons.select("line_no", F.col("gedcom_xref").alias("child_xref")), ["child_xref"])
    said = said.select("child_xref", xref_of(F.col("value")).alias("family_xref"), "line_no").groupBy("child_xref", "family_xref").agg(F.min("line_no").alias("line_no"))
    pedigree = children_of(below(lines, ("FAMC",), ("PEDI",)), said, ["child_xref", "family_xref"]).groupBy("child_xref", "family_xref").agg(first_child("PEDI", F.col("value")).alias("pedi"))
    return links.join(pedigree, ["child_xref", "family_xref"], "left").select("family_id", "child_id", link_type(trimmed(F.col("pedi"))).alias("link_type"))


def events(lines: DataFrame, persons: DataFrame, fams: DataFrame) -> DataFrame:
    """Dated and placed facts of people and families; ids follow the lines."""
    subjects = persons.select("line_no", F.lit("individual").alias("subject_type"), F.col("id").alias("subject_id")).unionByName(fams.select("line_no", F.lit("family").alias("subject_type"), F.col("id").alias("subject_id")))
    named = children_of(below(lines, ("INDI", "FAM"), EVENT_TAGS), subjects, ["subject_type", "subject_id"]).select("line_no", "subject_type", "subject_id", F.col("tag").alias("fact"))
    facts = dense_ids(settle(named, "facts"), "line_no")
    parts = below(lines, EVENT_TAGS, ("TYPE", "DATE", "PLAC", "NOTE", "SOUR")).groupBy("parent_line").agg(
        *[first_child(t, clean(F.col("full"))).alias(t.lower()) for t in ("TYPE", "DATE", "PLAC", "NOTE")], F.count_if(F.col("tag") == "SOUR").alias("sources"),
    ).withColumnRenamed("parent_line", "line_no")
    t = facts.join(parts, "line_no", "left")
    kind = F.when(F.col("fact") == "EVEN", F.coalesce("type", "fact")).otherwise(F.col("fact"))
    return t.select("subject_type", "subject_id", kind.alias("event_type"), F.col("date").alias("date_raw"), F.col("plac").alias("place_raw"), F.coalesce("sources", F.lit(0)).alias("source_count"), "note", "line_no", "id")


def tag_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("tag").agg(F.count(F.lit(1)).alias("n_lines")).orderBy("tag")


def people_without_events(persons: DataFrame, facts: DataFrame) -> DataFrame:
    busy = facts.where("subject_type = 'individual'").select(F.col("subject_id").alias("id")).distinct()
    return persons.join(busy, "id", "left_anti").select("gedcom_xref").orderBy("gedcom_xref")


def run(spark: SparkSession, store: Store, path: str, config: Config | None = None) -> dict:
    """Read one file and replace the tables of this pass; what depends on them is cleared.

    A store holds one tree: xrefs and line numbers are those of one file, so a path that names several is refused.  The file is read in ranges.  Counts come with the
    writes; lines of each tag, and people without events, are tables.
    """
    config = config or load_config()
    raw, encoding = read_lines(spark, path)
    read, told, made = Observation("lines"), Observation("records"), Observation("events")
    raw = settle(raw.observe(read, F.coalesce(F.sum("bad"), F.lit(0)).alias("unmappable_bytes")), "raw").drop("bad")
    lines = settle(line_table(raw), "lines")
    store.clear_for("ingest")
    top = lambda tag: F.count_if((F.col("level") == 0) & (F.col("tag") == tag))
    store.write("raw_records", raw_records(lines).observe(told, F.count_if(F.col("tag") == UNPARSED).alias("unparsed_lines"), top("INDI").alias("individuals"), top("FAM").alias("families")))
    persons = settle(people(lines, int(config["privacy"]["living_cutoff_year"])), "people")
    fams = settle(families(lines, persons), "families")
    none = F.lit(None).cast("string")
    store.write("individuals", persons.select("*", *[none.alias(c) for c in ("birth_start", "birth_end", "death_start", "death_end")], F.lit("unknown").alias("lifespan_src")))
    store.write("families", fams.select("*", none.alias("marriage_start"), none.alias("marriage_end")))
    store.write("family_children", family_children(lines, persons, fams))
    facts = store.write("events", events(lines, persons, fams).observe(made, F.count(F.lit(1)).alias("events")))
    tags, idle = store.write("tag_counts", tag_counts(lines)), store.write("people_without_events", people_without_events(persons, facts))
    bad = read.get["unmappable_bytes"]
    store.put_meta(input_encoding=encoding, input_unmappable_bytes=str(bad))
    n = told.get
    warn("ingest", n["unparsed_lines"], "lines of the file are no records")
    return report("ingest", encoding=encoding, unmappable_bytes=bad, tags=tags.count(), **n, **made.get, individuals_with_no_events=idle.count())
