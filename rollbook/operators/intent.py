"""What a user wants against what records and categories say; classifiers are pluggable and fail open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import text as t

# Fragments of categories by vertical.
HEALTHCARE = [
    "general practice", "periodontics", "endodontics", "orthodont", "oral and maxillofacial", "pediatric dentistry", "prosthodont", "dental", "dentist", "dentistry",
    "physician", "doctor", "medical practice", "chiropract", "optometry", "podiatry", "psychiatry", "psychology", "psychotherap", "physical therapy",
    "occupational therapy", "speech therapy", "nurse practitioner", "nursing", "hospital", "clinic", "health system", "urgent care", "veterinar", "radiology",
    "cardiology", "dermatology", "neurology", "pediatric", "obstetric", "gynecolog", "anesthesi", "oncology",
]
LAWYER = [
    "attorney", "lawyer", "legal", "law firm", "law office", "law practice", "litigation", "counsel", "bar association", "criminal defense", "personal injury",
    "estate planning", "family law", "corporate law", "tax law", "patent attorney",
]
REAL_ESTATE = ["real estate", "realtor", "realty", "property management", "mls"]


def vertical(category: Column, name: Column) -> Column:
    """healthcare, lawyer, real_estate; everything unclear is business."""
    c = F.lower(F.coalesce(category, F.lit("")))
    n = F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when(n.rlike(r"(?i),?\s*esq\.?\s*$"), "lawyer").when(n.rlike(r"(?i)(?:,\s*|\s+)(?:dds|dmd|md|do|phd|dvm|dpm|od|optometrist)\.?\s*$"), "healthcare")
        .when(t.any_word(c, HEALTHCARE), "healthcare").when(t.any_word(c, LAWYER), "lawyer").when(t.any_word(c, REAL_ESTATE), "real_estate")
        .when(n.rlike(r"(?i)^\s*dr\.?\s+"), "healthcare").otherwise("business")
    )


def categories_by_intent(categories: DataFrame, aliases: list[str], keep: int) -> DataFrame:
    """The first categories of each site that name the trade; all of them where none does."""
    hit = t.any_word(F.lower("text"), [a.lower() for a in aliases])
    c = categories.withColumn("hit", F.coalesce(hit, F.lit(False)))
    some = c.groupBy("site").agg(F.max("hit").alias("some"))
    r = F.row_number().over(Window.partitionBy("site", "hit").orderBy("pos", "text"))
    return c.withColumn("r", r).join(some, "site").where(~F.col("some") | (F.col("hit") & (F.col("r") <= keep))).select("site", "pos", "text")


Classifier = Callable[[list[tuple[str, str]]], list[bool]]


def filter_by_classifier(records: DataFrame, classify: Classifier, name: str = "company_name", category: str = "category") -> DataFrame:
    """Records that the classifier keeps. It sees each distinct (name, category) once, in batches; an error keeps all."""
    keys = records.select(name, category).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                keep = classify(list(zip(b[name], b[category])))
                if len(keep) != len(b):
                    keep = [True] * len(b)
            except Exception:  # a classifier that fails filters nothing
                keep = [True] * len(b)
            yield b.assign(keep=keep)

    got = keys.mapInPandas(run, f"{name} string, {category} string, keep boolean").where("keep")
    return records.alias("r").join(got.alias("k"), F.col(f"r.{name}").eqNullSafe(F.col(f"k.{name}")) & F.col(f"r.{category}").eqNullSafe(F.col(f"k.{category}")), "left_semi")
