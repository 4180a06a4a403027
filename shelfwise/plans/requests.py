"""Batches of revenue questions answered from the star schema.

A question asks for total revenue when it contains the guard phrase; its year
is the first stand-alone year in the text and its brand the first listed brand
contained in it (case-insensitive).  All questions of a batch are answered by
one join against a revenue cube over (year, brand) that also holds the
per-year, per-brand and overall totals, so the cost is one aggregation of the
fact, whatever the batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import cells, grouping_sets
from ..functions.text import YEAR_PATTERN, extract_year
from ..operators.metrics import internal_lines, sales
from ..operators.resolve import match_substring

# The phrase that routes a question to the revenue metric.
GUARD = "total revenue"


def brand_list(star: dict) -> DataFrame:
    """Brands to look for, longest name first (so a brand whose name holds
    another brand's name is found before it), then by name."""
    b = star["dim_product"].select("brand").distinct()
    return b.select("brand", F.row_number().over(
        Window.orderBy(F.length("brand").desc(), "brand")).alias("rank"))


def revenue_cube(star: dict) -> DataFrame:
    """Revenue for every (year, brand), every year, every brand, and overall."""
    lines = internal_lines(star, attrs=["year", "brand"])
    fine = cells(lines, ["year", "brand"], {"total_revenue": sales(lines)})
    return grouping_sets(fine, ["year", "brand"], [["year", "brand"], ["year"], ["brand"], []],
                         ["total_revenue"]).drop("level_id")


def answer_revenue_questions(star: dict, questions: DataFrame, brands: DataFrame | None = None,
                             year_pattern: str = YEAR_PATTERN, guard: str = GUARD) -> DataFrame:
    """``questions(question)`` -> question, year, brand, status, total_revenue."""
    brands = brands if brands is not None else brand_list(star)
    q = questions.select("question").distinct().select(
        "question",
        extract_year("question", year_pattern).alias("year"),
        F.lower("question").contains(guard.lower()).alias("answerable"))
    index = brands.select(F.lit(0).alias("e"), F.lower("brand").alias("alias"),
                          F.col("brand").alias("canonical"), "rank")
    found = match_substring(q.select(F.lit(0).alias("e"), F.col("question").alias("raw")),
                            index)
    q = q.join(found.select(F.col("raw").alias("question"), F.col("canonical").alias("brand")),
               "question", "left")
    cube = revenue_cube(star).select(F.col("year").alias("c_year"), F.col("brand").alias("c_brand"),
                                     "total_revenue")
    a = q.join(cube, F.col("answerable") & F.col("year").eqNullSafe(F.col("c_year"))
               & F.col("brand").eqNullSafe(F.col("c_brand")), "left")
    return a.select("question", "year", "brand",
                    F.when(F.col("answerable"), F.lit("answered"))
                    .otherwise(F.lit("not_answered")).alias("status"),
                    "total_revenue")


def generated_questions(star: dict, empty_year_offset: int = 30) -> DataFrame:
    """A question batch worded from the star's own brands and years: with
    and without year and brand, about a year without data, and off-topic."""
    pairs = internal_lines(star, attrs=["year", "brand"]).select("year", "brand").distinct()
    years = star["dim_time"].select("year").distinct()
    brands = star["dim_product"].select("brand").distinct()
    y, b = F.col("year").cast("string"), F.col("brand")
    parts = [
        pairs.select(F.concat(F.lit("What was the total revenue for "), b, F.lit(" in "), y,
                              F.lit("?")).alias("question")),
        years.select(F.concat(F.lit("Show me the total revenue in "), y, F.lit(".")).alias("question")),
        years.select(F.concat(F.lit("What was the total revenue in "),
                              (F.col("year") + empty_year_offset).cast("string"),
                              F.lit("?")).alias("question")),
        brands.select(F.concat(F.lit("Total Revenue of "), b, F.lit(" overall, please"))
                      .alias("question")),
        brands.select(F.concat(F.lit("How did "), b, F.lit(" sell compared with last year?"))
                      .alias("question")),
        years.select(F.concat(F.lit("Tell me a cake recipe from "), y).alias("question")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
