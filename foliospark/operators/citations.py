"""Citations: first-occurrence numbers, resolution, disambiguation and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters, sep_by, sep_end_by


def cite_map(keys: DataFrame) -> DataFrame:
    """keys: doc_id, cmd_seq, pos (from 0 within the command), key. doc_id, key, ord: its first command's offset and its last place in it."""
    sizes = keys.groupBy("doc_id", "cmd_seq").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("doc_id").orderBy("cmd_seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("doc_id", "cmd_seq", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    first = keys.groupBy("doc_id", "key").agg(F.min(F.struct(F.col("cmd_seq"), (-F.col("pos")).alias("back"))).alias("f"))
    rows = first.select("doc_id", "key", F.col("f.cmd_seq").alias("cmd_seq"), (-F.col("f.back")).alias("pos"))
    return rows.join(offsets, ["doc_id", "cmd_seq"]).select("doc_id", "key", (F.col("offset") + F.col("pos")).alias("ord"))


def resolved(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """cited (doc_id, key, ord) with the known entries (key, author, editor, year, title, type); unknown keys drop out."""
    return cited.join(entries, "key").select("doc_id", "key", "ord", F.coalesce("author", "editor", F.lit("")).alias("agents"), "year", "title", "type")


def disambiguated(rows: DataFrame) -> DataFrame:
    """Adds suffix: a, b, ... in entry order (agents, year, title, key) to citations of a document that agents and year leave ambiguous."""
    group = Window.partitionBy("doc_id", "agents", "year")
    order = group.orderBy(F.asc_nulls_first("title"), "key")
    rank = F.row_number().over(order) - 1
    return rows.withColumn("suffix", F.when(F.count(F.lit(1)).over(group) > 1, letters(rank)).otherwise(""))


def grouped(cites: DataFrame) -> DataFrame:
    """Runs of neighbouring citations with equal agents: doc_id, grp, agents, years in order; cites: doc_id, seq, agents, label."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = cites.withColumn("new", F.coalesce((F.lag("agents").over(w) != F.col("agents")).cast("int"), F.lit(1)))
    rows = rows.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("doc_id", "grp", "agents").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]), ", ").alias("years"))


def grouped_by_names(cites: DataFrame, agents: DataFrame) -> DataFrame:
    """As grouped(), by lists of last names: cites (doc_id, seq, key, label); agents (key, place, last) as of bibliography.agents(). agents shows the list as text."""
    names = agents.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "last"))), lambda x: x["last"]).alias("agents"))
    rows = cites.join(names, "key", "left").select("doc_id", "seq", F.coalesce("agents", F.array().cast("array<string>")).alias("agents"), "label")
    return grouped(rows).withColumn("agents", sep_end_by(F.col("agents"), ", ", " & "))


def written(groups: DataFrame, mode: str = "author_in_parentheses") -> DataFrame:
    """One line for each document: the groups in order, in one of the citation modes."""
    return written_in(groups, (mode,)).select("doc_id", "citation")


def written_in(groups: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """doc_id, mode, citation: written() in several modes, for which the groups are made and gathered once."""

    def part(x: Column, mode: str) -> Column:
        a, y = x["agents"], x["years"]
        return y if mode == "year" else a if mode == "author" else F.concat(a, F.lit(" ("), y, F.lit(")")) if mode == "textual" else F.concat(a, F.lit(" "), y)

    def line(mode: str) -> Column:
        parts = F.transform("_groups", lambda x: part(x, mode))
        made = sep_end_by(parts, ", ", " and ") if mode in ("textual", "author") else F.array_join(parts, "; ")
        return F.concat(F.lit("("), made, F.lit(")")) if mode == "author_in_parentheses" else made

    rows = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("grp", "agents", "years"))).alias("_groups"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), line(m).alias("citation")) for m in modes)))
    return rows.select("doc_id", each.alias("x")).select("doc_id", "x.*")


def full_reference(agents, year, title, kind, place):
    """The reference of an entry by its type, as one string."""
    head = F.concat(agents, F.lit(". "), year, F.lit(". "))
    return (
        F.when(kind == "book", F.concat(head, title, F.lit(". "), place, F.lit(".")))
        .when(kind == "article", F.concat(head, title, F.lit(". "), place, F.lit(", in press.")))
        .when(kind == "collection", F.concat(agents, F.lit(" (ed.). "), year, F.lit(". "), title, F.lit(". "), place, F.lit(".")))
        .otherwise(F.concat(head, title, F.lit(".")))
    )


def agent_lines(agents: DataFrame) -> DataFrame:
    """agents: key, place, first, prefix, last, suffix. One row a key: outer, inner, citing and editors.

    outer begins with "Last, First von, Jr" and goes on with "First von Last, Jr", which all of inner are; citing holds last names; editors is what
    follows names of editors.
    """
    part = {c: F.coalesce(c, F.lit("")) for c in ("first", "prefix", "last", "suffix")}
    last_first = sep_by(part["last"], sep_by(sep_by(part["first"], part["prefix"], " "), part["suffix"], ", "), ", ")
    first_last = sep_by(sep_by(part["first"], sep_by(part["prefix"], part["last"], " "), " "), part["suffix"], ", ")
    rows = agents.select("key", F.struct("place", last_first.alias("lf"), first_last.alias("fl"), part["last"].alias("last")).alias("a")).groupBy("key").agg(F.array_sort(F.collect_list("a")).alias("all"))
    outer = F.transform("all", lambda a, i: F.when(i == 0, a["lf"]).otherwise(a["fl"]))
    inner, last = F.transform("all", lambda a: a["fl"]), F.transform("all", lambda a: a["last"])
    return rows.select("key", *(sep_end_by(x, ", ", " & ").alias(n) for n, x in (("outer", outer), ("inner", inner), ("citing", last))), F.when(F.size("all") == 1, "(ed.)").otherwise("(eds.)").alias("editors"))
