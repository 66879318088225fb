"""Length verdicts and metadata coverage."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import domain
from ..functions.values import is_blank

# Shortest and longest good length, in bytes.
TITLE_RANGE = (30, 60)
DESCRIPTION_RANGE = (120, 160)


def length_verdict(text: Column, shortest: int, longest: int) -> Column:
    """``long``, ``short`` or ``good`` by byte length; NULL for blank text."""
    size = F.octet_length(text)
    return F.when(
        ~is_blank(text),
        F.when(size > longest, "long").when(size < shortest, "short").otherwise("good"),
    )


def title_verdict(text: Column) -> Column:
    return length_verdict(text, *TITLE_RANGE)


def description_verdict(text: Column) -> Column:
    return length_verdict(text, *DESCRIPTION_RANGE)


def has_any(struct: Column, fields: list[str]) -> Column:
    """Whether any field of a struct holds a value."""
    held = [F.coalesce(~struct[f].isin("", "0"), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a | b, held)


def coverage(analyses: DataFrame) -> DataFrame:
    """Per host: pages, and pages with any Open Graph, Twitter or structured data."""
    schema = analyses.schema["analysis"].dataType
    a = F.col("analysis")

    def shown(section):
        return F.count_if(has_any(a[section], schema[section].dataType.names))

    return analyses.groupBy(domain(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        shown("open_graph").alias("with_open_graph"),
        shown("twitter_card").alias("with_twitter"),
        F.count_if(F.size(a["schema_org"]) > 0).alias("with_schema"),
        F.count_if(F.size(a["hreflang"]) > 0).alias("with_hreflang"),
    )
