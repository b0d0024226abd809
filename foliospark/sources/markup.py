"""Tags and texts of marked-up pages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without contents, and those whose contents are no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
#: Comments, declarations, raw elements as wholes, tags with quoted values, texts; a < that begins nothing is a text.
TOKEN = r"""(?si)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+>|[^<]+|<"""


#: Bytes of pages that a task takes; their tags weigh many times as much.
TASK_BYTES = 8 << 20


def dealt(pages: DataFrame, doc_id: str = "page_id", text: str = "html") -> DataFrame:
    """Pages by id over as many tasks as their bytes call for, however few row groups hold them; what follows by page needs no other shuffle."""
    size = pages.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return pages.select(doc_id, text).repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), doc_id)


def tokens(pages: DataFrame, doc_id: str = "page_id", text: str = "html") -> DataFrame:
    """doc_id, seq, role (open, close, leaf), kind (element, raw, text, other), name, text; a null page has none."""
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("seq", "text"))
    name = F.lower(F.regexp_extract("text", r"^</?([A-Za-z][^\s/>]*)", 1))
    rows = rows.select("doc_id", "seq", name.alias("name"), "text")
    kind = F.when(F.col("name").isin(*RAW) & F.rlike("text", F.lit(r"(?s)^<[A-Za-z].*</")), "raw").when(F.col("name") != "", "element").when(F.rlike("text", F.lit("^<[!?]")), "other").otherwise("text")
    rows = rows.select("doc_id", "seq", kind.alias("kind"), "name", "text")
    leaf = (F.col("kind") != "element") | F.col("name").isin(*VOID) | F.col("text").endswith("/>")
    role = F.when(leaf & ~F.startswith("text", F.lit("</")), "leaf").when(F.startswith("text", F.lit("</")), "close").otherwise("open")
    return rows.select("doc_id", "seq", role.alias("role"), "kind", "name", "text")


def escaped_end(name):
    """The end tag of an element."""
    return F.concat(F.lit("</"), name, F.lit(">"))
