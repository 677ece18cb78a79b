"""Results as files, wide tables and plan upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quotes are doubled, blanks at both ends stay, and an empty or missing value is written as nothing at all.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON Lines; a null value is written as null."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def csv_value(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str]) -> Column:
    """One CSV line per row, for sinks that take text."""
    return F.concat_ws(",", *[csv_value(F.col(c)) for c in columns])


def column_union(rows: DataFrame, preferred: tuple[str, ...] = ()) -> DataFrame:
    """Columns of each plan's rows: the preferred ones, then others by first appearance.

    ``rows`` holds ``plan_id, order_key, fields``. The result is ``plan_id, pos, name``.
    """
    wanted = F.array(*[F.lit(p) for p in preferred]) if preferred else F.array().cast("array<string>")
    keys = rows.select("plan_id", "order_key", F.posexplode(F.map_keys("fields")).alias("at", "name"))
    first = (
        keys.where(~F.array_contains(wanted, F.col("name")))
        .groupBy("plan_id", "name")
        .agg(F.min(F.struct("order_key", "at")).alias("first"))
        .groupBy("plan_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda n: n["name"]).alias("names"))
    )
    plans = rows.select("plan_id").distinct().join(first, "plan_id", "left")
    return plans.select(
        "plan_id", F.posexplode(F.concat(wanted, F.coalesce("names", F.array().cast("array<string>")))).alias("pos", "name")
    )


def widen(rows: DataFrame, names: list[str]) -> DataFrame:
    """One column per field, for the rows of one plan."""
    return rows.select(
        *[c for c in rows.columns if c != "fields"],
        *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names],
    )


def upsert_plans(stored: DataFrame, changed: DataFrame, key: str = "url_key") -> DataFrame:
    """Stored rows with the changed ones on top; columns the change leaves null keep their value.

    Write the result to a new path and switch readers over; Spark cannot replace what it reads.
    """
    columns = [c for c in stored.columns if c != key]
    if "seq" in changed.columns:
        # of several changes of one plan the last one counts
        latest = F.max_by(F.struct(*[c for c in changed.columns if c != key]), "seq")
        changed = changed.groupBy(key).agg(latest.alias("_last")).select(key, "_last.*").drop("seq")
    new = changed.select(key, *[F.col(c).alias("new_" + c) for c in columns if c in changed.columns])
    return stored.join(new, key, "full").select(
        key, *[F.coalesce("new_" + c, c).alias(c) if c in changed.columns else F.col(c) for c in columns]
    )
