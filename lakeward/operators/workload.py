"""Questions about a table of statement texts: shape, score, size and target.

The patterns are heuristics on text, as in the reference; nothing is parsed.
Everything per statement is a column expression, so a log of any length is
classified in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeward.session import stage

# Words that mark an aggregation.
AGGREGATION_MARKS = ["group by", "having", "count(", "sum(", "avg(", "max(", "min("]

# Thresholds and assumed sizes.
ROW_THRESHOLD = 1_000_000
ANALYTICAL_ROWS = 100_000
SCORE_THRESHOLD = 5.0
TABLE_THRESHOLD = 3
UNKNOWN_ROWS = 100_000
UNMEASURED_LAKE_ROWS = 10_000_000
LAKE_SOURCE = "iceberg"

# First words of a statement.
STATEMENTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"]

TABLE_PATTERN = r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)"


def tables_used(text: Column) -> Column:
    """Names after FROM and JOIN, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TABLE_PATTERN), 1)


def _matches(text: Column, words: list[str], pattern: str) -> Column:
    """Pattern match that looks for its plain words first, which is much cheaper."""
    present = text.contains(words[0])
    for word in words[1:]:
        present = present | text.contains(word)
    return present & text.rlike(pattern)


def features(queries: DataFrame, text: str = "query") -> DataFrame:
    """What each statement uses, its score and its class, as added columns."""
    lower = F.lower(text)
    marked = F.lit(False)
    for mark in AGGREGATION_MARKS:
        marked = marked | lower.contains(mark)
    measured = queries.withColumns(
        {
            "tables_used": tables_used(F.col(text)),
            "has_join": _matches(lower, ["join"], r"\bjoin\b"),
            "has_aggregation": marked,
            "has_subquery": _matches(lower, ["("], r"\(\s*select\b"),
            "has_window": _matches(lower, ["window", "over"], r"\bwindow\b|\bover\s*\("),
            "has_cte": _matches(lower, ["recursive", "with"], r"\brecursive\b|\bwith\b"),
        }
    ).withColumn("table_count", F.size(F.array_distinct("tables_used")).cast("bigint"))

    def points(condition: str, value: float) -> Column:
        return F.when(F.col(condition), value).otherwise(0.0)

    score = (
        F.col("table_count").cast("double")
        + points("has_join", 2.0)
        + points("has_aggregation", 1.5)
        + points("has_subquery", 2.0)
        + points("has_window", 2.0)
        + points("has_cte", 1.5)
    )
    scored = measured.withColumn("score", score)
    kind = (
        F.when(F.col("has_aggregation") & (F.col("table_count") > 1), "analytical")
        .when(F.col("has_join"), "join")
        .when(F.col("has_aggregation"), "aggregation")
        .when(F.col("score") > 3.0, "complex")
        .otherwise("simple_select")
    )
    return scored.withColumn("query_class", kind)


def second_score(text: Column) -> Column:
    """Joins and windows twice, nested selects, groupings and CTEs once."""
    upper = F.upper(text)

    def times(word: str, after: str = r"\b") -> Column:
        counted = F.regexp_count(upper, F.lit(rf"\b{word}{after}"))
        return F.when(upper.contains(word), counted).otherwise(0)

    total = (
        times("JOIN") * 2
        + times("SELECT")
        - 1
        + times("OVER", r"\s*\(") * 2
        + times("GROUP BY")
        + times("WITH")
    )
    return total.cast("bigint")


def statement_type(text: Column) -> Column:
    """Kind of statement by its first word; anything unknown counts as a select."""
    start = F.upper(F.regexp_replace(text, r"^\s+", ""))
    kind = F.lit("select")
    for word in reversed(STATEMENTS):
        kind = F.when(start.startswith(word), word.lower()).otherwise(kind)
    return kind


def _with_sizes(statements: DataFrame, registry: DataFrame) -> DataFrame:
    """Join each ``table_name`` with its store and the rows to expect.

    Unknown tables and lake tables without statistics get assumed sizes; no
    table (null) means no rows. The registry is staged, so it is broadcast
    when its measured size allows, and a table half of the log uses is then no
    hot key.
    """
    known = stage(
        registry.select(F.col("table_name").alias("_name"), "source", "row_count"), "registry"
    )
    unmeasured = F.when(F.col("source") == LAKE_SOURCE, UNMEASURED_LAKE_ROWS)
    rows = F.coalesce("row_count", unmeasured, F.lit(UNKNOWN_ROWS)).cast("bigint")
    expected = F.when(F.col("table_name").isNotNull(), rows).otherwise(0)
    joined = statements.join(known, F.col("table_name") == F.col("_name"), "left")
    return joined.withColumn("expected_rows", expected).drop("_name", "row_count")


def registered_sizes(queries: DataFrame, registry: DataFrame, key: str, text: str = "query") -> DataFrame:
    """One row per statement and table it names, with the rows to expect there."""
    used = queries.select(key, F.explode(tables_used(F.col(text))).alias("table_name"))
    return _with_sizes(used, registry).select(key, "table_name", "source", "expected_rows")


def route(queries: DataFrame, registry: DataFrame, key: str, text: str = "query") -> DataFrame:
    """``small`` or ``large`` per statement, with the reasons. The key is unique.

    Any lake table makes a statement large; else its expected rows, score,
    number of tables, or being analytical on a middling size do. The text is
    dropped before the only shuffle.
    """
    shape = ["score", "query_class", "table_count"]
    named = features(queries.select(key, text), text).select(
        key, *shape, F.explode_outer("tables_used").alias("table_name")
    )
    described = _with_sizes(named, registry).groupBy(key, *shape).agg(
        F.sum("expected_rows").alias("rows"),
        F.bool_or(F.coalesce(F.col("source") == LAKE_SOURCE, F.lit(False))).alias("uses_lake"),
    )
    rows = F.col("rows")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("uses_lake"), "lake table"),
            F.when(rows > ROW_THRESHOLD, "rows"),
            F.when(F.col("score") > SCORE_THRESHOLD, "score"),
            F.when(F.col("table_count") > TABLE_THRESHOLD, "tables"),
            F.when((F.col("query_class") == "analytical") & (rows > ANALYTICAL_ROWS), "analytical"),
        )
    )
    return described.select(
        key,
        "score",
        "query_class",
        rows.alias("expected_rows"),
        F.array_join(reasons, ",").alias("reasons"),
        F.when(F.size(reasons) > 0, "large").otherwise("small").alias("target"),
    )
