"""The service catalogue: search, lookup, optional courses and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline.functions.text import filled, matches, or_default


def search(catalogue: DataFrame, query: str) -> DataFrame:
    return catalogue.filter(matches(query, "title", "summary"))


def lookup(catalogue: DataFrame, id_: int) -> DataFrame:
    """The entry of this id; of repeated ids the first by title and summary, none if there is none."""
    return catalogue.filter(F.col("id") == id_).orderBy("title", "summary").limit(1)


def selected_detail(selected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each selection with its entry; a miss is kept and flagged. Of repeated ids the first by title and summary counts, as in `lookup`."""
    first = catalogue.filter("id is not null").groupBy("id").agg(F.min(F.struct("title", "summary")).alias("_entry"))
    entry = first.select("id", "_entry.title", "_entry.summary", F.lit(True).alias("_found"))
    return selected.join(entry, selected.program_id == entry.id, "left").select(*selected.columns, "title", "summary", F.coalesce("_found", F.lit(False)).alias("found"))


def has_courses(courses: Column | str = "courses") -> Column:
    return F.size(F.coalesce(courses, F.array().cast("array<string>"))) > 0


def default_choice(choice: Column | str, courses: str = "courses") -> tuple[Column, Column]:
    """The chosen course or else the first, and its place from 0; an unknown course has place 0."""
    chosen = or_default(choice, F.get(F.col(courses), F.lit(0)))
    return chosen, F.greatest(F.coalesce(F.array_position(courses, chosen), F.lit(0)) - 1, F.lit(0)).cast("int")


def instructor(course: Column | str, first_takes: tuple[str, ...], first: str, second: str) -> Column:
    course = F.col(course) if isinstance(course, str) else course
    return F.when(course.isin(*first_takes), F.lit(first)).otherwise(F.lit(second))


def staff_email(name: Column | str, prefix: str, email: str, other: str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.startswith(name, F.lit(prefix)), F.lit(email)).otherwise(F.lit(other))


def course_branch(course: Column | str, exact: str, prefix: str) -> Column:
    """`exact`, `prefix` or `other`, by equality first."""
    course = F.col(course) if isinstance(course, str) else course
    return F.when(course == exact, F.lit("exact")).when(F.startswith(course, F.lit(prefix)), F.lit("prefix")).otherwise(F.lit("other"))


def inquiry_text(title: str = "title", course: str = "course") -> Column:
    """The text of an inquiry, with the course only where there is one."""
    return F.when(filled(course), F.concat(F.lit("Interested in "), F.col(title), F.lit(" ("), F.col(course), F.lit(")"))).otherwise(F.concat(F.lit("Interested in "), F.col(title)))


def round_robin(catalogue: DataFrame, group: str, order: str, tie: str, buckets: int = 3, chunk: int = 100_000) -> DataFrame:
    """A bucket from 0 for each row, in turn within its group by a number `order`, and by `tie` where that is equal.

    Rows are numbered within chunks of `order`, and a chunk begins where the group's chunks
    before it end, so that a group that holds most rows is no single task. Null groups are one
    group; rows without `order` are its first.
    """
    part = F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(1 << 62)))
    rows = catalogue.withColumn("_chunk", part)
    within = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(order, tie)) - 1
    sizes = rows.groupBy(F.col(group).alias("_group"), F.col("_chunk").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_group", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_within", within).join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_chunk") == F.col("_part")))
    return rows.withColumn("bucket", F.pmod(F.col("_before") + F.col("_within"), F.lit(buckets)).cast("int")).drop("_chunk", "_within", "_group", "_part", "_before")
