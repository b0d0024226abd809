"""Kernels over tables of sources: one Python stage for each document, faulty ones become error rows.

sources has path and text (wholetext scan). Includes are resolved within a bounded map of the include files, whose total size is
checked against INCLUDE_BYTES before it is sent to the executors.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most that include files may weigh together.
INCLUDE_BYTES = 64_000_000
#: Characters of texts whose results a task holds at a time, and bytes of texts that it takes at a time.
HELD, TAKEN = 4_000_000, 16 << 20
#: Calls that may be open at once; a text nested more deeply becomes an error row.
DEEPEST = 100_000
TOKENS = "path string, pos int, kind string, text string, cat int, active boolean, level int, error string"
ATOMS = "path string, node_id int, last_id int, parent_id int, depth int, ord int, kind string, name string, text string, arg_kind string, arg_ord int, error string"
FIELDS = "path string, seq int, key string, type string, name string, kind string, value string, error string"
PAGES = "path string, file string, content string, error string"


def includes(files: DataFrame) -> dict[str, str]:
    """Names to texts of the files that others include; refuses more than INCLUDE_BYTES."""
    size = files.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > INCLUDE_BYTES:
        raise ValueError(f"include files weigh {size} bytes, more than {INCLUDE_BYTES}")
    return {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.select("path", "text").collect()}


def spread(sources: DataFrame) -> DataFrame:
    """Sources dealt over all cores, whatever files, row groups or small shuffled partitions they come in: the kernels cost far more than moving the texts once."""
    return sources.repartition(2 * sources.sparkSession.sparkContext.defaultParallelism, "path", "text")


def _taken(sources: DataFrame) -> DataFrame:
    """path and text; long texts cross to Python in batches of bounded size."""
    conf, name = sources.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= TAKEN:
        conf.set(name, str(TAKEN))
    return sources.select("path", "text")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    """Paths and texts (null: empty) of a batch, a few at a time as Python strings."""
    for at in range(0, batch.num_rows, 100):
        few = batch.slice(at, 100)
        for path, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
            yield path, text or ""


def deep() -> None:
    """Lets the kernels follow deep but legal nesting; their frames are Python's own and don't use the stack of the process."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))


def _each(make, schema: str, files: dict[str, str] | None):
    """make(text, files) gives rows; a failure gives one row with the error."""
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [c.split() for c in schema.split(", ")]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for path, text in _texts(batch):
                held += len(text)
                try:
                    out += [(path, *r, None) for r in make(text, files)]
                except Exception as e:  # noqa: BLE001  whatever one document does, the others go on
                    out.append((path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}"))
                if len(out) > 50_000 or held > HELD:
                    yield flush(out)
                    out, held = [], 0
            yield flush(out)

    return run


def _mapped(sources: DataFrame, make, schema: str, files: dict[str, str] | None) -> DataFrame:
    return _taken(sources).mapInArrow(_each(make, schema, files), schema)


def _failed(path: str, e: Exception) -> pa.RecordBatch:
    """The one row of tokens of a text that can't be read."""
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string())
    values = (path, *[None] * 6, f"{type(e).__name__}: {e}")
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in TOKENS.split(", ")])


_KINDS = ("char", "cs", "param")


def _columns(path: str, found: list) -> pa.RecordBatch:
    """Tokens of lex_runs() as rows of TOKENS, a row for each character of a run."""
    from ..kernels.lexer import LETTER, OTHER, SPACE

    if not found:
        return pa.RecordBatch.from_arrays([pa.array([], pa.string() if i in (0, 2, 3, 7) else pa.bool_() if i == 5 else pa.int32()) for i in range(8)], names=[c.split()[0] for c in TOKENS.split(", ")])
    kinds, texts, cats, active, levels = zip(*found, strict=True)
    text = "".join(texts)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(found)), np.fromiter(map(len, texts), np.int64, len(found)))
    run = np.fromiter((k == "words" for k in kinds), bool, len(found))[of]
    starts = np.flatnonzero(run | np.append(True, of[1:] != of[:-1]))
    of, run, first = of[starts], run[starts], points[starts]
    met, place = np.unique(first, return_inverse=True)
    alone = np.fromiter((SPACE if c == 32 else LETTER if chr(c).isalpha() else OTHER for c in met.tolist()), np.int32, len(met))[place]
    width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.append(0, np.cumsum(width))[np.append(starts, len(points))].astype(np.int32)
    n = len(starts)

    def same(value: str | None) -> pa.Array:
        return pa.repeat(pa.scalar(value, pa.string()), n)

    kind = np.fromiter((0 if k == "words" else _KINDS.index(k) for k in kinds), np.int32, len(found))[of]
    return pa.RecordBatch.from_arrays(
        [
            same(path), pa.array(np.arange(n, dtype=np.int32)), pa.array(_KINDS).take(pa.array(kind)), pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text.encode())),
            pa.array(np.where(run, alone, np.array(cats, np.int32)[of])), pa.array(np.array(active, bool)[of]), pa.array(np.array(levels, np.int32)[of]), same(None),
        ],
        names=[c.split()[0] for c in TOKENS.split(", ")],
    )


def _runs(path: str, found: list) -> pa.RecordBatch:
    """Tokens of lex_runs() as rows of TOKENS; a run is one row of kind words at the place of its first character."""
    kinds, texts, cats, active, levels = zip(*found, strict=True) if found else [()] * 5
    lengths = np.fromiter((len(t) if k == "words" else 1 for k, t in zip(kinds, texts, strict=True)), np.int32, len(found))
    same = [pa.repeat(pa.scalar(v, pa.string()), len(found)) for v in (path, None)]
    columns = [same[0], pa.array(np.cumsum(lengths, dtype=np.int32) - lengths), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(cats, pa.int32()), pa.array(active, pa.bool_()), pa.array(levels, pa.int32()), same[1]]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENS.split(", ")])


def tokens(sources: DataFrame, files: dict[str, str] | None = None, runs: bool = False) -> DataFrame:
    """A row for each token; runs: neighbouring letters, other characters and single spaces between them are one row of kind words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernels.lexer import lex_runs

        deep()
        for batch in batches:
            out: list[pa.RecordBatch] = []
            held = 0
            for path, text in _texts(batch):
                try:
                    made = (_runs if runs else _columns)(path, lex_runs(text, files))
                except Exception as e:  # noqa: BLE001  whatever one document does, the others go on
                    made = _failed(path, e)
                out.append(made)
                held += made.num_rows
                if held > 200_000:
                    yield pa.concat_batches(out)
                    out, held = [], 0
            if out:
                yield pa.concat_batches(out)

    return _taken(sources).mapInArrow(run, TOKENS)


def atoms(sources: DataFrame, files: dict[str, str] | None = None, runs: bool = False, named: str | None = None, whole: str | None = None) -> DataFrame:
    """Preorder rows of every text's syntax tree; runs: plain nodes with single white ones between are one row of kind words.

    named: rows only of what is at the top, of commands and environments whose names match, and of all below those whose names match whole (patterns).
    """
    patterns = (re.compile(named), re.compile(whole or "(?!)")) if named is not None else (None, None)

    def make(text, inc):
        from ..kernels.lexer import lex_runs
        from ..kernels.parser import parse, rows

        return rows(parse(lex_runs(text, inc)), runs, *patterns)

    return _mapped(sources, make, ATOMS, files)


def bib_fields(sources: DataFrame) -> DataFrame:
    def make(text, inc):
        from ..kernels.bibtex import parse_bib

        return parse_bib(text)

    return _mapped(sources, make, FIELDS, None)


def _made(doc: dict, form: str, works: dict[str, dict] | None) -> list[tuple[str, str]]:
    from ..kernels import writers

    if form == "html":
        return [("index.html", writers.to_html(doc, works))]
    if form == "xml":
        return [("document.xml", writers.to_tei(doc, works))]
    if form == "multi":
        return list(writers.to_pages(doc, works).items())
    if form == "epub":
        return list(writers.epub_files(doc, works).items())
    if form == "native":
        return [("document.json", json.dumps(doc, ensure_ascii=False, sort_keys=True))]
    raise ValueError(f"unknown format {form}")


def parsed(sources: DataFrame, files: dict[str, str] | None = None, joined: bool = False, whole: bool = True) -> DataFrame:
    """path, document (JSON), cites (its keys), media (names of its images), error. joined: see Reader; not whole: document is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernels.document import read_document

        deep()
        types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "document", "cites", "media", "error"])

        for batch in batches:
            rows, held = [], 0
            for path, text in _texts(batch):
                held += len(text)
                try:
                    doc = read_document(text, files, joined=joined or not whole)
                    rows.append((path, json.dumps(doc, ensure_ascii=False) if whole else None, list(doc["cites"]), sorted({m for m in doc["media"] if m}), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                if held > HELD:
                    yield flush(rows)
                    rows, held = [], 0
            yield flush(rows)

    return _taken(sources).mapInArrow(run, "path string, document string, cites array<string>, media array<string>, error string")


def with_works(documents: DataFrame, works: DataFrame) -> DataFrame:
    """parsed() with works: those that a document cites, out of a table of any size (works.described()); the rest of it goes nowhere."""
    from .works import by_document

    cited = documents.select(F.col("path").alias("doc_id"), F.explode(F.array_distinct("cites")).alias("key"))
    found = by_document(cited, works).groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("key", "agents", "year", "title", "full")).alias("works"))
    return documents.join(found, "path", "left")


def with_media(documents: DataFrame, media: DataFrame) -> DataFrame:
    """parsed() with images: names and contents of the files (path, content) that a document's images name by their last part; what isn't there is left out."""
    from ..sources.files import with_media as met

    named = documents.select(F.col("path").alias("doc_id"), F.posexplode("media").alias("media_id", "_name")).withColumn("name", F.element_at(F.split("_name", "/"), -1))
    found = met(named, media).filter("content IS NOT NULL").groupBy("doc_id", "name").agg(F.first("content").alias("content"))
    return documents.join(found.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("name", "content")).alias("images")), "path", "left")


def _listed(row: dict) -> dict[str, dict]:
    return {w["key"]: w for w in row.get("works") or []}


def pages(sources: DataFrame, form: str = "html", works: DataFrame | dict[str, dict] | None = None, files: dict[str, str] | None = None) -> DataFrame:
    """Documents written in a format: html, xml, multi (one row a page), epub (one row a file of the archive), native (JSON).

    works: a table as of works.described(), joined with what each document cites; or a few works as a dictionary.
    """
    if isinstance(works, DataFrame):

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["path", "file", "content", "error"])

        def make_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deep()
            for batch in batches:
                out: list[tuple] = []
                held = 0
                for row in (r for at in range(0, batch.num_rows, 100) for r in batch.slice(at, 100).to_pylist()):
                    held += len(row["document"] or "")
                    try:
                        out += [(row["path"], *made, None) for made in _made(json.loads(row["document"]), form, _listed(row))] if row["error"] is None else [(row["path"], None, None, row["error"])]
                    except Exception as e:  # noqa: BLE001
                        out.append((row["path"], None, None, f"{type(e).__name__}: {e}"))
                    if held > HELD:
                        yield flush(out)
                        out, held = [], 0
                yield flush(out)

        return with_works(parsed(sources, files, joined=form != "native"), works).select("path", "document", "works", "error").mapInArrow(make_all, PAGES)

    def make(text, inc):
        from ..kernels.document import read_document

        return _made(read_document(text, inc, joined=form != "native"), form, works)

    return _mapped(sources, make, PAGES, files)


def archives(sources: DataFrame, works: DataFrame | None = None, files: dict[str, str] | None = None, seed: str = "", date: str = "", cover: tuple[str, bytes] | None = None, media: DataFrame | None = None) -> DataFrame:
    """path, content, error: an EPUB for each document. Its identifier follows from seed and path, so a repeated task makes the same file.

    media (path, content) are the files of images; each archive holds those that its document shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from ..kernels import writers

        deep()
        for batch in batches:
            for row in batch.to_pylist():
                made, error = None, row["error"]
                try:
                    name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{seed}/{row['path']}"))
                    images = {x["name"]: x["content"] for x in row.get("images") or []}
                    made = writers.to_epub(json.loads(row["document"]), _listed(row), name, date, images, cover) if error is None else None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), pa.array([made], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    rows = parsed(sources, files, joined=True)
    rows = rows if works is None else with_works(rows, works)
    rows = rows if media is None else with_media(rows, media)
    return rows.drop("cites", "media").mapInArrow(run, "path string, content binary, error string")


def works(fields: DataFrame) -> DataFrame:
    """The works of parsed bibliographies (rows of bib_fields()) with what they inherit, as works.described() has them."""
    from .bibliography import resolved
    from .works import described

    return described(*resolved(fields.filter("error IS NULL").select("key", "type", "name", "value")))
