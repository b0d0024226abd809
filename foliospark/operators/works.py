"""Works that documents cite: references by type as columns, and each document with its own works, told apart among themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .citations import disambiguated


#: Fields that references show.
FIELDS = ("author", "editor", "year", "date", "title", "location", "publisher", "journaltitle", "volume", "number", "pages", "booktitle", "institution", "howpublished", "note", "url")


def _joined(separator: str, *parts: Column | str) -> Column:
    """The parts (columns or their names) that aren't empty."""
    return F.concat_ws(separator, *(F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts))


def _sentence(*parts: Column | str) -> Column:
    """The parts with commas, and a full stop unless there is an end; nothing of nothing."""
    return F.regexp_replace(_joined(", ", *parts), r"(?s)([^.?!])\z", "$1.")


def _around(before: str, name: str, after: str) -> Column:
    return F.when(F.col(name) == "", "").otherwise(F.concat(F.lit(before), name, F.lit(after)))


def described(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """entries (key, type) and fields (key, name, value) to key, agents, year, title, head and tail: what a reference begins with and what follows its title."""
    listed = fields.filter(F.col("name").isin(*FIELDS, "type")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("f"))
    own = [F.coalesce(F.element_at("f", n), F.lit("")).alias(n) for n in FIELDS]
    rows = entries.join(listed, "key", "left").select("key", "type", *own, F.coalesce(F.element_at("f", "type"), F.lit("Report")).alias("series"))
    rows = rows.withColumns({
        "agents": F.coalesce(F.nullif("author", F.lit("")), "editor"), "year": F.coalesce(F.nullif("year", F.lit("")), F.substring("date", 1, 4)), "place": _sentence(_joined(": ", "location", "publisher")),
        "issue": F.concat("volume", _around("(", "number", ")")), "source": _joined(", ", _around("", "editor", " (ed.)"), "booktitle"),
    })
    kind = F.col("type")
    tail = (
        F.when(kind == "article", _sentence(_joined(" ", "journaltitle", "issue"), "pages"))
        .when(kind.isin("incollection", "inbook", "inproceedings"), _joined(" ", _sentence(_around("In ", "source", ""), "pages"), "place"))
        .when(kind == "mastersthesis", _sentence(F.lit("MA thesis"), "institution"))
        .when(kind.isin("thesis", "phdthesis"), _sentence(F.lit("Dissertation"), "institution"))
        .when(kind.isin("report", "techreport"), _sentence(_joined(" ", "series", "number"), "institution"))
        .when(kind.isin("online", "misc", "unpublished"), _sentence("howpublished", "note", "url"))
        .otherwise(F.col("place"))
    )
    edited = kind.isin("collection", "proceedings") & (F.col("author") == "") & (F.col("agents") != "")
    return rows.select("key", "type", "agents", "year", "title", F.when(edited, _around("", "agents", " (ed.).")).otherwise(_sentence("agents")).alias("head"), tail.alias("tail"))


def by_document(cited: DataFrame, works: DataFrame) -> DataFrame:
    """cited (doc_id, key) with works as described(): doc_id, key, agents, year (with its suffix), title, full.

    Works of one document that agree in agents and year have suffixes in the order of title and key; keys of no work drop out.
    """
    rows = disambiguated(cited.select("doc_id", "key").distinct().join(works, "key"))
    year = F.concat("year", "suffix")
    return rows.select("doc_id", "key", "agents", year.alias("year"), "title", _joined(" ", "head", _sentence(year), _sentence("title"), "tail").alias("full"))
