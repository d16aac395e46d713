"""Corpus quality: time columns, declared schema, deduplication, slices, reference resolution, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.functions.quarters import quarter_index, quarter_label


def normal_headers(df: DataFrame) -> DataFrame:
    """Column names stripped, spaces and hyphens to underscores, lower case."""
    return df.toDF(*[c.strip().replace(" ", "_").replace("-", "_").lower() for c in df.columns])


def add_time_vars(df: DataFrame, date_col: str = "publication_date") -> DataFrame:
    """pub_year, q_idx and pub_qtr of a date; null dates give nulls."""
    q = quarter_index(F.col(date_col))
    return df.withColumns({"pub_year": F.year(date_col).cast("int"), "q_idx": q, "pub_qtr": quarter_label(q)})


def enforce_schema(df: DataFrame, declared: dict[str, str], non_null: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Adds declared columns that are missing as nulls, casts the others (values that don't fit become null) and raises on nulls.

    Columns that aren't declared stay. The non-null check is an assertion inside the plan, without a pass of its own.
    """
    columns = {c: F.expr(f"try_cast(`{c}` AS {kind})") if c in df.columns else F.lit(None).cast(kind) for c, kind in declared.items()}
    out = df.withColumns(columns)
    for c in non_null:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}")).cast(out.schema[c].dataType)))
    return out.orderBy(*order_by) if order_by else out


def deduplicate(df: DataFrame, key: str, order_by: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order. Rows of a null key are one group."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    return df.withColumn("place_", first).where("place_ = 1").drop("place_")


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: original, duplicates, final and rate_pct."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count(F.lit(1)).alias("final"))
    dup = F.col("original") - F.col("final")
    return sums.select("original", dup.alias("duplicates"), "final", F.round(100 * ratio(dup, F.col("original")), 4).alias("rate_pct"))


def append_new(stored: DataFrame, fresh: DataFrame, key: str, date_col: str) -> tuple[DataFrame, DataFrame]:
    """The union in which stored rows win over fresh ones of the same key, and the new watermark (greatest date)."""
    added = fresh.join(stored.select(key), key, "left_anti")
    both = stored.unionByName(deduplicate(added, key, [date_col]), allowMissingColumns=True)
    return both, both.agg(F.max(date_col).alias("watermark"))


def apply_slice(df: DataFrame, expression: str | None = None, group_by: list[str] | None = None, name: str = "slice", **bound: object) -> DataFrame:
    """Rows that meet an expression (its @names replaced by bound values) with slice_key: name, or name__values of the group columns.

    Null group values are a group of their own.
    """
    if expression:
        for k, v in bound.items():
            expression = expression.replace(f"@{k}", repr(str(v)) if not isinstance(v, int | float) else str(v))
        df = df.where(F.expr(expression.replace("==", "=")))
    if not group_by:
        return df.withColumn("slice_key", F.lit(name))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in group_by]
    return df.withColumn("slice_key", F.concat(F.lit(f"{name}__"), F.concat_ws("_", *parts)))


def topic_share(df: DataFrame, topic_col: str, expected: str, threshold: float = 0.3) -> DataFrame:
    """One row: share of rows of the expected topic and whether it reaches the threshold; passes without the column or rows."""
    if topic_col not in df.columns:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("share"), F.lit(True).alias("aligned"))
    share = df.agg(F.avg((F.coalesce(F.col(topic_col) == expected, F.lit(False))).cast("double")).alias("share"))
    return share.select(F.round("share", 6).alias("share"), F.coalesce(F.col("share") >= threshold, F.lit(True)).alias("aligned"))


def resolve_references(refs: DataFrame, works: DataFrame, by: str | None = None) -> DataFrame:
    """Total references, those whose target is in the corpus and their share, over all or by a column of refs."""
    known = works.select(F.col("work_id").alias("known_")).distinct()
    joined = refs.join(known, F.col("ref_id") == F.col("known_"), "left")
    sums = joined.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("refs_total"), F.count("known_").alias("refs_in_corpus"))
    return sums.withColumn("share", F.round(ratio(F.col("refs_in_corpus"), F.col("refs_total")), 6))


def validate_slice(df: DataFrame, key: str, date_col: str, start: Column, end: Column, refs_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """One row of counts: rows, dates outside [start, end], null and duplicate keys, and stored reference counts that are wrong."""
    wrong = F.lit(0).cast("long")
    if refs_col and count_col:
        wrong = F.count_if(F.coalesce(F.size(refs_col), F.lit(0)) != F.coalesce(F.col(count_col), F.lit(0)))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col(date_col) < start) | (F.col(date_col) > end)).alias("out_of_window"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        (F.count(key) - F.countDistinct(key)).alias("duplicate_keys"),
        wrong.alias("wrong_ref_counts"),
    )


def time_periods(df: DataFrame) -> DataFrame:
    """Distinct quarters with their year and number of rows."""
    return df.groupBy("pub_year", "pub_qtr").agg(F.count(F.lit(1)).alias("rows"))


#: Nested raw record of a scholarly work.
RAW_WORK = (
    "id string, doi string, display_name string, type string, language string, publication_date string, publication_year int, cited_by_count int, "
    "open_access struct<is_oa: boolean, oa_status: string, oa_url: string>, has_fulltext boolean, "
    "primary_location struct<source: struct<id: string, display_name: string, type: string>>, "
    "authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, country_code: string>>>>, "
    "topics array<struct<id: string, display_name: string, score: double, field: struct<display_name: string>, domain: struct<display_name: string>>>, "
    "referenced_works array<string>, abstract_inverted_index map<string, array<int>>"
)


def last_segment(url: Column) -> Column:
    """What follows the last slash; null stays null."""
    return F.element_at(F.split(url, "/"), -1)


def flatten_works(raw: DataFrame) -> DataFrame:
    """The corpus table of nested raw records (RAW_WORK): ids without address, first author, topic of highest score (first of ties)."""
    first = F.try_element_at(F.col("authorships"), F.lit(1))
    institutions = F.flatten(F.transform(F.coalesce("authorships", F.array().cast(raw.schema["authorships"].dataType)), lambda a: a["institutions"]))
    countries = F.array_sort(F.array_distinct(F.filter(F.transform(institutions, lambda i: i["country_code"]), lambda c: c.isNotNull())))
    best = F.array_max(F.transform(F.col("topics"), lambda t, i: F.struct(t["score"].alias("score"), (-i).alias("place"), t.alias("topic"))))["topic"]
    date = F.coalesce(F.try_to_date("publication_date", "yyyy-MM-dd"), F.make_date("publication_year", F.lit(1), F.lit(1)))
    return raw.select(
        last_segment(F.col("id")).alias("work_id"),
        F.col("id").alias("work_id_url"),
        "doi",
        F.col("display_name").alias("title"),
        "type",
        "language",
        date.alias("publication_date"),
        "publication_year",
        "cited_by_count",
        F.col("open_access.is_oa").alias("is_oa"),
        F.col("open_access.oa_status").alias("oa_status"),
        "has_fulltext",
        last_segment(F.col("primary_location.source.id")).alias("primary_venue_id"),
        F.col("primary_location.source.display_name").alias("primary_venue_name"),
        F.size(F.coalesce("authorships", F.array().cast(raw.schema["authorships"].dataType))).alias("author_count"),
        last_segment(first["author"]["id"]).alias("first_author_id"),
        first["author"]["display_name"].alias("first_author_name"),
        F.transform(F.col("authorships"), lambda a: last_segment(a["author"]["id"])).alias("author_ids"),
        F.array_sort(F.array_distinct(F.filter(F.transform(institutions, lambda i: last_segment(i["id"])), lambda c: c.isNotNull()))).alias("institution_ids"),
        countries.alias("institution_country_codes"),
        F.when(F.size(countries) > 0, F.size(countries) > 1).alias("is_international_collab"),
        last_segment(best["id"]).alias("primary_topic_id"),
        best["display_name"].alias("primary_topic_name"),
        best["field"]["display_name"].alias("primary_topic_field"),
        best["domain"]["display_name"].alias("primary_topic_domain"),
        F.transform(F.col("referenced_works"), lambda r: last_segment(r)).alias("referenced_works"),
        F.coalesce(F.size("referenced_works"), F.lit(0)).alias("ref_count"),
        abstract_text(F.col("abstract_inverted_index")).alias("abstract"),
    )


def abstract_text(inverted: Column) -> Column:
    """The text of a map word -> places: places without a word are empty strings; of several words at a place the last by name wins."""
    pairs = F.array_sort(F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    # Sorted once; neighbours meet by zipping, so the work follows the number of words.
    following = F.concat(F.transform(F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["p"]), F.array(F.lit(-1)))
    ends = F.zip_with(pairs, following, lambda x, p: F.struct(x["p"].alias("p"), x["w"].alias("w"), (x["p"] != p).alias("last")))
    kept = F.filter(ends, lambda x: x["last"])
    before = F.slice(F.concat(F.array(F.lit(0)), F.transform(kept, lambda x: x["p"])), 1, F.greatest(F.size(kept), F.lit(1)))
    words = F.zip_with(kept, before, lambda x, p: F.concat(F.repeat(F.lit(" "), x["p"] - p), x["w"]))
    return F.when(F.size(pairs) > 0, F.array_join(words, ""))


def reference_list(cell: Column) -> Column:
    """References of a cell written as [a, b], 'a,b' or a single value; blanks go."""
    bare = F.regexp_replace(cell, r"[\[\]'\"]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: last_segment(F.trim(x))), lambda x: x != "")
