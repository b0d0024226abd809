"""The text functions as SQL functions of a session: their bodies are SQL, so the optimizer puts them in place and they cost what they say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from .text import LIGATURES


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """Signature to body of every function."""
    ligated = reduce(lambda t, p: f"replace({t}, {_quoted(p[0])}, {_quoted(p[1])})", LIGATURES, "s")
    escaped = reduce(lambda t, p: f"replace({t}, {_quoted(p[0])}, {_quoted(p[1])})", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), "s")
    letters = "substring('abcdefghijklmnopqrstuvwxyz', CAST(pmod(a.n - 1, 26) AS INT) + 1, 1)"
    return {
        "tex_ligatures(s STRING) RETURNS STRING": ligated,
        "xml_escape(s STRING) RETURNS STRING": escaped,
        "fmt_sep_by(a STRING, b STRING, separator STRING) RETURNS STRING": "concat_ws(separator, nullif(a, ''), nullif(b, ''))",
        "fmt_end_with_dot(s STRING) RETURNS STRING": "CASE WHEN s = '' OR endswith(s, '.') THEN s ELSE concat(s, '.') END",
        "fmt_wrap(s STRING, a STRING, b STRING) RETURNS STRING": "CASE WHEN s = '' THEN '' ELSE concat(a, s, b) END",
        "fmt_extra_year(n BIGINT) RETURNS STRING": f"aggregate(sequence(1, 14), named_struct('n', n + 1, 's', ''), (a, i) -> CASE WHEN a.n > 0 THEN named_struct('n', (a.n - 1) div 26, 's', concat({letters}, a.s)) ELSE a END, a -> a.s)",
        "anchor_id(region STRING, path ARRAY<BIGINT>) RETURNS STRING": "concat('sec-', CASE region WHEN 'front' THEN 'front-' WHEN 'back' THEN 'back-' ELSE '' END, regexp_replace(array_join(transform(path, x -> CAST(x AS STRING)), '-'), '(^|-)0(-0)*$', ''))",
        "section_file(n INT) RETURNS STRING": "format_string('section-%03d.xhtml', n)",
    }


def register(spark: SparkSession) -> None:
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
