"""Reports on scraped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_names(levels: DataFrame, target_level: int | None = None) -> DataFrame:
    """Distinct field names of each plan in the order of levels and fields: ``plan_id, pos, name``."""
    used = levels if target_level is None else levels.where(F.col("level") <= target_level)
    names = used.select("plan_id", "level", F.posexplode("fields").alias("at", "f")).where(F.col("f.name") != "")
    first = names.groupBy("plan_id", F.col("f.name").alias("name")).agg(F.min(F.struct("level", "at")).alias("first"))
    listed = first.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("names"))
    return listed.select("plan_id", F.posexplode("names").alias("pos", "n")).select("plan_id", "pos", "n.name")


def null_rates(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Empty values (null or blank string) per plan and field: ``plan_id, pos, name, empty, total``.

    Counts the filled values, so both aggregations combine before they shuffle.
    """
    filled = (
        rows.select("plan_id", F.explode("fields").alias("name", "value"))
        .where(F.col("value") != "")
        .groupBy("plan_id", "name")
        .agg(F.count("*").alias("filled"))
    )
    totals = rows.groupBy("plan_id").agg(F.count("*").alias("total"))
    return (
        names.join(totals, "plan_id", "left")
        .join(filled, ["plan_id", "name"], "left")
        .select(
            "plan_id",
            "pos",
            "name",
            (F.coalesce("total", F.lit(0)) - F.coalesce("filled", F.lit(0))).alias("empty"),
            F.coalesce("total", F.lit(0)).alias("total"),
        )
    )


def null_issues(rates: DataFrame) -> DataFrame:
    """Fields that are empty in more than half of the rows, and plans without rows."""
    quoted = F.concat(F.lit("Field '"), F.col("name"), F.lit("' is empty in "))
    issue = F.when(F.col("empty") == F.col("total"), F.concat(quoted, F.lit("all rows"))).when(
        F.col("empty") > F.col("total") * 0.5, F.concat(quoted, F.col("empty"), F.lit("/"), F.col("total"), F.lit(" rows"))
    )
    of_fields = rates.where(F.col("total") > 0).withColumn("issue", issue).where(F.col("issue").isNotNull())
    of_plans = (
        rates.where(F.col("total") == 0)
        .select("plan_id", F.lit(-1).alias("pos"), F.lit("No data extracted").alias("issue"))
        .distinct()
    )
    return of_fields.select("plan_id", "pos", "issue").unionByName(of_plans)


def fix_decisions(sample: DataFrame, names: DataFrame) -> DataFrame:
    """One ``fix_field`` decision per plan whose sample shows issues.

    ``sample`` are the rows of ``scrape.sample`` (a few per plan), of which three are shown.
    """
    issues = null_issues(null_rates(sample, names)).groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "issue"))), lambda i: i["issue"]).alias("issues")
    )
    listed = names.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda n: n["name"]).alias("field_names")
    )
    shown = (
        sample.where(F.col("row") <= 3)
        .select("plan_id", "row", F.to_json("fields", {"ignoreNullFields": "false"}).alias("json"))
        .groupBy("plan_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "json"))), lambda r: r["json"]).alias("sample_rows"))
    )
    return issues.join(listed, "plan_id", "left").join(shown, "plan_id", "left").select(
        "plan_id",
        F.lit("fix_field").alias("decision"),
        F.lit("sample_analysis").alias("step"),
        F.array(F.lit("fix"), F.lit("skip")).alias("options"),
        "issues",
        "field_names",
        "sample_rows",
    )


def row_and_column_counts(rows: DataFrame) -> DataFrame:
    """Rows and distinct columns of each plan's result."""
    totals = rows.groupBy("plan_id").agg(F.count("*").alias("total_rows"))
    columns = (
        rows.select("plan_id", F.explode(F.map_keys("fields")).alias("name"))
        .distinct()
        .groupBy("plan_id")
        .agg(F.count("*").alias("total_columns"))
    )
    return totals.join(columns, "plan_id", "left").select(
        "plan_id", "total_rows", F.coalesce("total_columns", F.lit(0)).alias("total_columns")
    )
