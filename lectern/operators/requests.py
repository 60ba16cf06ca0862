"""Checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violations(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(r, F.lit(True)), F.lit(m)) for r, m in rules]), lambda x: x.isNotNull())


def check_search_request(requests: DataFrame) -> DataFrame:
    """Add violations of search requests: an empty query, a top_k outside 1 to 20."""
    return requests.withColumn("violations", _violations([(F.length("query") < 1, "query"), (~F.col("top_k").between(1, 20), "top_k")]))


def check_course(courses: DataFrame) -> DataFrame:
    """Add violations of courses: names of 1 to 255 characters."""
    return courses.withColumn("violations", _violations([(~F.length("course_name").between(1, 255), "course_name")]))
