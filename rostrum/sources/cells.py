"""Input lists: cells -> companies with their people."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import squash

# fixed values: accepted headers, by priority
COMPANY_HEADERS = ["company", "company name", "companies", "company_name", "organisation", "organization"]
PERSON_HEADERS = ["director name", "director", "person name", "name"]
ROLE_HEADERS = ["designation", "role", "title"]
HEADER_ROWS = 5
FIRST_COLUMNS = 10


def cell_text(v: Column) -> Column:
    """SRC3. ``v``: STRUCT<text, result, rich_text ARRAY<STRUCT<text>>>."""
    rich = F.array_join(F.transform(v["rich_text"], lambda p: p["text"]), "")
    return F.coalesce(F.when(v["rich_text"].isNotNull(), rich), v["text"], v["result"], F.lit(""))


def csv_width(spark, path: str, multi_line: bool = False) -> int:
    """An upper bound of the columns of any row, by one aggregate over the rows
    (a comma inside quotes counts too, which only adds empty columns)."""
    rows = spark.read.text(path).select("value")
    if multi_line:  # rows wider than one column come back whole
        parsed = spark.read.csv(path, schema="value string, whole string", columnNameOfCorruptRecord="whole", multiLine=True)
        rows = parsed.select(F.concat_ws(",", "value", "whole").alias("value"))
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    return (rows.agg(F.max(commas)).first()[0] or 0) + 1


def read_csv_cells(spark, path: str, width: int | None = None, multi_line: bool = False) -> DataFrame:
    """SRC1 source: a headerless CSV as ``(row_no, col_no, value)`` cells.

    Rows may be ragged: ``width`` columns are read (None: as many as the widest
    line has), so a title row of one cell hides nothing; short rows lack their
    last cells.  ``multi_line`` accepts line breaks inside quotes, for which a
    file can't be split.  ``row_no`` follows the position in a file; of several
    files each keeps its order and none is mixed with another.
    """
    names = [f"_c{i}" for i in range(width or csv_width(spark, path, multi_line))]
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), header=False, multiLine=multi_line)
    lines = raw.withColumn("row_no", F.monotonically_increasing_id() + 1)
    cells = F.array(*[F.struct(F.lit(i + 1).alias("col_no"), F.col(c).alias("value")) for i, c in enumerate(names)])
    return lines.select("row_no", F.explode(cells).alias("c")).select("row_no", "c.*").where("value is not null")


def header_layout(cells: DataFrame, by: str | None = None) -> DataFrame:
    """SRC2. At most one row: ``header_row, company_col, person_col, role_col``;
    with ``by``, the column that tells many lists apart, one of each.

    Only the first five rows are read, so this side is bounded by their width.
    """
    if by:
        return _layouts(cells, by)
    top = cells.where(F.col("row_no") <= HEADER_ROWS).withColumn("h", F.lower(squash(F.col("value"))))
    row = (top.where(F.col("h").isin(COMPANY_HEADERS)).groupBy("row_no").agg(F.max("col_no").alias("company_col"))
           .agg(F.min(F.struct("row_no", "company_col")).alias("r")).where(F.col("r").isNotNull()).select("r.*"))
    named = top.join(F.broadcast(row), "row_no")

    def first_of(headers: list[str]) -> Column:
        rank = F.array_position(F.array(*[F.lit(h) for h in headers]), F.col("h"))
        return F.min(F.when(rank > 0, F.struct(rank.alias("rank"), "col_no")))["col_no"]

    return named.groupBy(F.col("row_no").alias("header_row"), "company_col").agg(
        first_of(PERSON_HEADERS).alias("person_col"), first_of(ROLE_HEADERS).alias("role_col"))


def _layouts(cells: DataFrame, by: str) -> DataFrame:
    top = cells.where(F.col("row_no") <= HEADER_ROWS).select(by, "row_no", "col_no", F.lower(squash(F.col("value"))).alias("h"))
    at = F.max_by("col_no", F.struct(-F.col("row_no"), "col_no")).alias("company_col")  # last one of the first row
    row = top.where(F.col("h").isin(COMPANY_HEADERS)).groupBy(by).agg(F.min("row_no").alias("header_row"), at)

    def first_of(headers: list[str]) -> Column:
        rank = F.array_position(F.array(*[F.lit(h) for h in headers]), F.col("h"))
        return F.min(F.when(rank > 0, F.struct(rank.alias("rank"), "col_no")))["col_no"]

    named = top.join(row, by).where(F.col("row_no") == F.col("header_row"))
    return named.groupBy(by, "header_row", "company_col").agg(first_of(PERSON_HEADERS).alias("person_col"), first_of(ROLE_HEADERS).alias("role_col"))


def sheet_rows(cells: DataFrame, by: str | None = None) -> DataFrame:
    """SRC1 + F10: usable ``(row_no, company, person, role)`` input rows; with
    ``by``, the rows of many lists, each by its own header, and that column."""
    keys = [by, "row_no"] if by else ["row_no"]
    value = squash(F.col("value"))
    if by:
        joined = cells.withColumn("value", value).join(header_layout(cells, by), by, "left")
    else:
        layout = F.broadcast(header_layout(cells).withColumn("sheet", F.lit(1)))  # one row
        joined = cells.withColumn("value", value).withColumn("sheet", F.lit(1)).join(layout, "sheet", "left")
    known = F.col("company_col").isNotNull()

    def pick(col: str) -> Column:
        return F.max(F.when(F.col("col_no") == F.col(col), F.col("value")))

    first = F.min_by("value", F.when(~known & (F.col("value") != "") & (F.col("col_no") <= FIRST_COLUMNS), F.col("col_no")))
    rows = (joined.where(~known | (F.col("row_no") > F.col("header_row"))).groupBy(*keys)
            .agg(F.coalesce(pick("company_col"), first).alias("company"), pick("person_col").alias("person"), pick("role_col").alias("role")))
    person = F.col("person")
    usable = F.length(person).between(2, 150) & ~person.rlike(r"^(?i)(?:null|n/?a|not found)$")
    return (rows.where(F.length("company").between(2, 150) & ~F.col("company").rlike(r"^(?i)compan(?:y|ies)\s*name?$"))
            .select(*keys, "company", F.when(usable, person).alias("person"),
                    F.when(usable, F.coalesce("role", F.lit(""))).alias("role")))


def company_people(rows: DataFrame) -> DataFrame:
    """A1, flat: one row per company and person (``person`` NULL for none).

    First spelling of each, first stated role.  Both levels combine map-side.
    """
    key, who = F.lower("company"), F.lower("person")
    stated = F.when(F.col("role") != "", F.col("row_no"))
    people = (rows.withColumn("company_key", key).groupBy("company_key", who.alias("person_key"))
              .agg(F.min(F.struct("row_no", "company")).alias("c"), F.min(F.struct("row_no", "person")).alias("p"),
                   F.coalesce(F.min_by("role", stated), F.lit("")).alias("role")))
    names = people.groupBy("company_key").agg(F.min("c")["company"].alias("company_name"), F.max("person_key").isNotNull().alias("has_people"))
    return (people.join(names, "company_key").where(F.col("person_key").isNotNull() | ~F.col("has_people"))
            .select("company_key", "company_name", "person_key", F.col("p.row_no").alias("pos"),
                    F.when(F.col("person_key").isNotNull(), F.col("p.person")).alias("person_name"),
                    F.when(F.col("person_key").isNotNull(), F.col("role")).alias("designation")))


def companies(people: DataFrame) -> DataFrame:
    """A1, nested: ``company_name, directors`` (empty array when none), for lists
    whose companies name a handful of people each."""
    person = F.struct("pos", F.col("person_name").alias("name"), "designation")
    listed = F.array_sort(F.collect_list(F.when(F.col("person_key").isNotNull(), person)))
    return people.groupBy("company_key", "company_name").agg(F.transform(
        listed, lambda x: F.struct(x["name"].alias("name"), x["designation"].alias("designation"))).alias("directors"))


def supplied_people(listed: DataFrame) -> DataFrame:
    """J9: people back out of the nested form, one row each."""
    return listed.select("company_key", "company_name", F.posexplode("directors").alias("person_pos", "d")).select(
        "company_key", "company_name", "person_pos", F.col("d.name").alias("person_name"), F.col("d.designation").alias("designation"))
