"""Command line: python -m foliospark [-t FORMAT] [-b FILE] [-o FOLDER] PATH converts TeX files."""

from __future__ import annotations

import argparse
import datetime
import sys
import uuid

FORMATS = ("html", "html-multi", "xml", "epub", "itok", "itex", "idoc")
VERSION = "0.1.0"
ENDINGS = {"html": "html", "xml": "xml", "epub": "epub", "idoc": "json"}


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="foliospark", description="Converts TeX documents.")
    p.add_argument("path")
    p.add_argument("-t", "--to", default="html", type=str.lower, choices=FORMATS)
    p.add_argument("-b", "--bib")
    p.add_argument("--cover")
    p.add_argument("-o", "--output")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    o = options(args)
    if o.to in ("epub", "html-multi") and not o.output:
        print(f"an output path is needed for {o.to}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import corpus
    from .operators.bibliography import checkpointed
    from .shipping import ship
    from .sources import files, sink

    def say(text: str) -> None:
        if o.verbose:
            print(text, file=sys.stderr)

    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    ship(spark)
    sink.register(spark)
    works = None
    if o.bib:
        try:
            works = checkpointed(corpus.works(spark.read.format("foliospark_bib").load(o.bib)))
            say(f"{works.count()} works in {o.bib}")
        except Exception as e:  # an unreadable bibliography is no reason to stop
            print(f"warning: bibliography can't be read: {e}\nwarning: going on without it", file=sys.stderr)
            works = None
    sources = files.tex_files(spark, o.path)
    beside = o.path.rsplit("/", 1)[0] if "/" in o.path else "."
    include = corpus.includes(files.tex_files(spark, f"{beside}/*.tex")) if o.path.endswith(".tex") else None
    if o.to == "epub":
        image = spark.read.format("binaryFile").load(o.cover).select("content").first()["content"] if o.cover else None
        cover = (f"cover.{o.cover.rsplit('.', 1)[-1]}", bytes(image)) if image else None
        media = files.media_files(spark, beside) if o.path.endswith(".tex") else None
        rows = corpus.archives(sources, works, include, str(uuid.uuid4()), datetime.date.today().isoformat(), cover, media)
    elif o.to in ("itok", "itex"):
        rows = (corpus.tokens if o.to == "itok" else corpus.atoms)(sources, include)
    else:
        rows = corpus.pages(sources, {"html-multi": "multi", "idoc": "native"}.get(o.to, o.to), works, include)
    if o.to in ("itok", "itex") and o.output:
        files.write_native(rows, o.output)
        return 0
    rows = checkpointed(rows)
    failed = 0
    for r in rows.filter("error IS NOT NULL").select("path", "error").toLocalIterator():
        print(f"error: {r['path']}: {r['error']}", file=sys.stderr)
        failed += 1
    rows = rows.filter("error IS NULL")
    if not o.output:
        for r in rows.toLocalIterator():
            print(r["content"] if "content" in rows.columns else r)
        return 1 if failed else 0
    single = sources.limit(2).count() == 1
    folder, _, own = o.output.rstrip("/").rpartition("/")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tex$", "")
    if o.to == "html-multi":
        folder, target = o.output, F.col("file") if single else F.concat_ws("/", name, "file")
    elif single:
        folder, target = folder or ("/" if o.output.startswith("/") else "."), F.lit(own)
    else:
        folder, target = o.output, F.concat(name, F.lit(f".{ENDINGS[o.to]}"))
    rows.select(target.alias("target"), F.col("content").cast("binary").alias("content")).write.format("foliospark_files").mode("append").save(folder)
    say(f"written to {o.output}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
