"""Exports of the analysis record: nested JSON, flat columns, long rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.values import is_blank, own_key
from .joins import join_unique

BOM = "﻿"


def envelope(analyses: DataFrame, metadata: dict[str, Column]) -> DataFrame:
    """page_id with ``metadata`` and ``analysis`` as one nested row."""
    return analyses.select(
        "page_id",
        F.struct(*[c.alias(n) for n, c in metadata.items()]).alias("metadata"),
        "analysis",
    )


def to_json_text(exports: DataFrame) -> DataFrame:
    """The envelope as JSON text, nulls kept; slashes and non-ASCII are not escaped."""
    body = F.to_json(F.struct("metadata", "analysis"), {"ignoreNullFields": "false"})
    return exports.select("page_id", body.alias("json"))


def _flat(column: Column, dtype: T.DataType, path: str):
    if isinstance(dtype, T.StructType):
        for field in dtype:
            yield from _flat(column[field.name], field.dataType, f"{path}.{field.name}")
    elif isinstance(dtype, T.ArrayType):
        items = column
        if isinstance(dtype.elementType, T.StructType):
            names = dtype.elementType.fieldNames()
            items = F.transform(
                column,
                lambda x: F.array_join(F.array(*[x[n].cast("string") for n in names]), "="),
            )
        yield F.coalesce(F.array_join(items, "; "), F.lit("")).alias(path)
    else:
        yield column.alias(path)


def flatten(exports: DataFrame) -> DataFrame:
    """One column per leaf, named by its dotted path; lists joined by ``; `` (pairs as
    ``lang=url``)."""
    out = []
    for field in exports.schema:
        out.extend(_flat(F.col(field.name), field.dataType, field.name))
    return exports.select(*out)


def write_csv(flat: DataFrame, path: str) -> None:
    """CSV with a header; every part file starts with a byte order mark.  White space at the
    ends of values is kept."""
    first, *rest = flat.columns
    renamed = flat.withColumnRenamed(first, BOM + first) if not first.startswith(BOM) else flat
    renamed.write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, by position.  Values may hold line feeds, so a file is one split."""
    # Nothing between two commas is a null, quotes with nothing in them are an empty text.
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\0")


def write_json(exports: DataFrame, path: str) -> None:
    exports.write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


TITLE_BYTES = 60
DESCRIPTION_BYTES = 160


def long_rows(exports: DataFrame) -> DataFrame:
    """page_id, position and one (section, property, value, notes) row per non-empty
    property, in a fixed section order."""
    a = F.col("analysis")
    schema = exports.schema["analysis"].dataType
    row = "array<struct<section:string,property:string,value:string,notes:string>>"

    def one(section, prop, value, notes=F.lit("")):
        return F.struct(
            F.lit(section).alias("section"), prop.alias("property"),
            value.cast("string").alias("value"), notes.alias("notes"),
        )

    def kept(rows):
        return F.filter(F.array(*rows).cast(row), lambda r: ~is_blank(r["value"]))

    def fields(section, struct, prefix):
        return kept(
            one(section, F.lit(prefix + f), a[struct][f]) for f in schema[struct].dataType.names
        )

    def meta_notes(field):
        limit, hint = {
            "title": (TITLE_BYTES, "Too long (recommended: 50-60 chars)"),
            "description": (DESCRIPTION_BYTES, "Too long (recommended: 150-160 chars)"),
        }.get(field, (None, None))
        if limit is None:
            return F.lit("")
        return F.when(F.octet_length(a["meta"][field]) > limit, hint).otherwise("")

    metadata = F.array(
        *[
            one("Metadata", F.lit(f), F.coalesce(F.col(f"metadata.{f}").cast("string"), F.lit("")))
            for f in exports.schema["metadata"].dataType.names
        ]
    ).cast(row)
    meta = kept(
        one("Meta Tags", F.lit(f), a["meta"][f], meta_notes(f))
        for f in schema["meta"].dataType.names
    )
    headings = [
        _numbered(a["headings"][level], "Headings", level.upper(), "Position: ")
        for level in ("h1", "h2", "h3")
    ]
    types = _numbered(a["schema_org"], "Schema.org", "Type", "Index: ")
    hreflang = F.transform(
        a["hreflang"], lambda h: one("Hreflang", h["lang"], h["url"])
    )
    extra = kept(
        one("Additional", F.lit(label), a[f])
        for f, label in (
            ("canonical", "Canonical URL"),
            ("favicon", "Favicon URL"),
            ("word_count", "Word Count"),
        )
    )
    rows = F.concat(
        metadata, meta, fields("Open Graph", "open_graph", "og:"),
        fields("Twitter Card", "twitter_card", "twitter:"),
        *[h.cast(row) for h in headings], types.cast(row), hreflang.cast(row), extra,
    )
    listed = exports.select("page_id", F.posexplode(rows).alias("position", "r"))
    return listed.select("page_id", (F.col("position") + 1).alias("position"), "r.*")


def _numbered(texts: Column, section: str, prop: str, label: str) -> Column:
    return F.transform(
        texts,
        lambda t, i: F.struct(
            F.lit(section).alias("section"), F.lit(prop).alias("property"), t.alias("value"),
            F.concat(F.lit(label), (i + 1).cast("string")).alias("notes"),
        ),
    )


# What an answer tells of the fetch.
HTTP_FIELDS = ["status_code", "content_type", "content_length", "fetch_time_ms", "redirect_count"]


def responses(
    checked: DataFrame, lookups: DataFrame, analyses: DataFrame, limit: int
) -> DataFrame:
    """The answer to each request: id, success, error, data, meta.

    ``checked`` carries the rate-limit columns and a ``cache_key``, ``lookups`` (id,
    hit) tells where the analysis came from, ``analyses`` has one row per key.  A
    denied request, or one whose page was not analysed, gets no data but an ``error``.
    When ``analyses`` has ``HTTP_FIELDS``, ``meta`` has them as ``http``.
    """
    asked = checked.join(lookups.select("id", "hit"), "id", "left")
    keyed = asked.withColumnRenamed("cache_key", "_key").withColumn(
        "cache_key", own_key(F.col("_key"), "id")
    )
    found = join_unique(keyed, analyses.withColumn("_analysed", F.lit(True)), "cache_key", "left")
    success = F.col("allowed") & F.col("_analysed").isNotNull()
    rate = F.struct(
        "remaining", F.lit(limit).alias("limit"), "reset_at",
        F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at_formatted"),
    )
    meta = ["url", "final_url", F.coalesce("hit", F.lit(False)).alias("cache_hit")]
    if set(HTTP_FIELDS) <= set(analyses.columns):
        meta.append(F.struct(*HTTP_FIELDS).alias("http"))
    return found.select(
        "id",
        success.alias("success"),
        F.when(~F.col("allowed"), "Rate limit exceeded")
        .when(F.col("_analysed").isNull(), "No analysis of this URL")
        .alias("error"),
        F.when(success, F.col("analysis")).alias("data"),
        F.struct(*meta, rate.alias("rate_limit")).alias("meta"),
    )
