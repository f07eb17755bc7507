"""Queries of quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.units import common_units, same_figure_other_unit
from folioscope.session import spread
from folioscope.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_figure_other_unit(common_units(spread(table(spark, sf_dir, "grading_baseline_dense"))))


def p1_common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of every graded answer in the common unit of its kind, one row each."""
    figures = common_units(spread(table(spark, sf_dir, "grading_baseline_dense")))
    return figures.select("grade_id", "qid", F.posexplode("figures").alias("figure_no", "f")).select("grade_id", "qid", "figure_no", "f.*")


#: Money as both texts must state it to be among the plain cases, for which SQL can tell the result.
_MONEY = r"(?:USD |US\$|\$)([0-9][0-9,]*(?:\.[0-9]+)?) ?(thousand|million|billion|K|M|B|bn)\b"


def p1_plain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the answers that state one amount of dollars with its scale, and no other figure, as their gold answers do: whether they are found."""
    graded = table(spark, sf_dir, "grading_baseline_dense")
    rest = F.regexp_replace(F.regexp_replace("generated_answer", _MONEY, ""), "FY[0-9]{4}", "")
    plain = graded.where(F.col("gold_answer").rlike(f"^{_MONEY}$") & F.col("generated_answer").rlike(_MONEY) & ~rest.rlike(r"[^ -~]|[0-9(*]") & ~F.col("generated_answer").rlike(r"[-(]\s*\$"))
    found = same_figure_other_unit(common_units(spread(graded))).withColumn("found", F.lit(True))
    return plain.select("grade_id").distinct().join(found, "grade_id", "left").select("grade_id", F.coalesce("found", F.lit(False)).alias("found"))


QUERIES = {"p1_found": p1_found, "p1_common_units": p1_common_units, "p1_plain_cases": p1_plain_cases}
_SCALE = "CASE regexp_extract({0}, '" + _MONEY + "', 2) WHEN 'thousand' THEN 1e3 WHEN 'K' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'M' THEN 1e6 ELSE 1e9 END"
_NUMBER = "CAST(replace(regexp_extract({0}, '" + _MONEY + "', 1), ',', '') AS DOUBLE)"
ORACLE: dict[str, str] = {
    "p1_plain_cases": rf"""WITH p AS (SELECT DISTINCT grade_id, {_SCALE.format("gold_answer")} AS gs, {_NUMBER.format("gold_answer")} AS g, {_SCALE.format("generated_answer")} AS s, {_NUMBER.format("generated_answer")} AS a FROM grading_baseline_dense
WHERE regexp_full_match(gold_answer, '{_MONEY}') AND regexp_matches(generated_answer, '{_MONEY}') AND NOT regexp_matches(regexp_replace(regexp_replace(generated_answer, '{_MONEY}', '', 'g'), 'FY[0-9]{{4}}', '', 'g'), '[^ -~]|[0-9(*]') AND NOT regexp_matches(generated_answer, '[-(]\s*\$'))
SELECT grade_id, bool_or(abs(a * s - g * gs) <= 0.005 * abs(g * gs) AND s <> gs) AS found FROM p GROUP BY grade_id"""
}
