import random

import pytest

from pyspark.sql import functions as F

from foliospark import __main__ as command
from foliospark.functions import text as fn
from foliospark.operators import anchors, bibliography, citations, corpus, includes, numbering, works
from foliospark.sources import files, sink
from foliospark.streaming import documents


def test_numbers_match_a_fold(spark):
    r, events, want = random.Random(2), [], []
    for doc in range(12):
        region, n, chapter, counts, phantom = "front", [0] * 7, 0, {"figure": 0, "note": 0}, 0
        for seq in range(60):
            kind = r.choice(["header", "header", "figure", "note", "region", "star"])
            level, place = r.randint(1, 7), r.choice(["front", "main", "back"])
            events.append((doc, seq, "header" if kind == "star" else kind, level if kind in ("header", "star") else None, kind == "star", place if kind == "region" else None, None))
            if kind == "region" and place != region:
                region, n = place, [0] * 7
            elif kind == "header":
                n[level - 1] += 1
                if level > 1:
                    n[level:] = [0] * (7 - level)
                if level == 2:
                    chapter, counts = n[1], {"figure": 0, "note": 0}
                want.append((doc, seq, region, ".".join(map(str, n))))
            elif kind == "star":
                phantom += 1
            elif kind in counts:
                counts[kind] += 1
                want.append((doc, seq, kind, (chapter, counts[kind])))
    frame = spark.createDataFrame(events, "doc_id int, seq int, kind string, level int, starred boolean, region string, label string")
    got = [(x.doc_id, x.seq, x.region, x.number) for x in numbering.section_numbers(frame).collect()]
    got += [(x.doc_id, x.seq, x.kind, (x.chapter, x.n)) for x in numbering.chapter_counters(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_cite_map_takes_the_last_place_in_the_first_command(spark):
    rows = [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 2, 0, "b"), (1, 2, 1, "c")]
    got = {x.key: x.ord for x in citations.cite_map(spark.createDataFrame(rows, "doc_id int, cmd_seq int, pos int, key string")).collect()}
    assert got == {"a": 2, "b": 1, "c": 4}


def test_inheritance_matches_recursion(spark):
    r, own, edges, want = random.Random(4), [], [], []
    for db in range(25):
        keys = [f"{db}-{i}" for i in range(6)]
        fields = {k: {n: f"{k}.{n}" for n in "abc" if r.random() < 0.4} for k in keys}
        parents = {k: r.sample(keys, r.randint(0, 2)) for k in keys}
        own += [(k, n, v) for k in keys for n, v in fields[k].items()]
        edges += [(k, p, i + 1) for k in keys for i, p in enumerate(parents[k])]

        def find(k, seen):
            out = {}
            for p in parents[k]:
                if p not in seen:
                    out |= find(p, seen | {p})
            return out | fields[k]

        want += [(k, n, v) for k in keys if fields[k] for n, v in find(k, {k}).items()]
    got = bibliography.xdata(spark.createDataFrame(own, "key string, name string, value string"), spark.createDataFrame(edges, "child string, parent string, ord int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_crossref_keeps_private_fields_away(spark):
    own = spark.createDataFrame([("c", "title", "own"), ("p", "title", "T"), ("p", "booktitle", "B"), ("p", "keywords", "k"), ("p", "author", "A"), ("p", "bookauthor", "BA"), ("p", "year", "1")], "key string, name string, value string")
    got = {x.name: x.value for x in bibliography.crossref(own, spark.createDataFrame([("c", "p")], "child string, parent string")).filter("key = 'c'").collect()}
    assert got == {"title": "own", "booktitle": "T", "bookauthor": "BA", "year": "1"}


def test_letters(spark):
    got = [x[0] for x in spark.createDataFrame([(i,) for i in (-1, 0, 25, 26, 701, 702)], "n int").select(fn.letters(F.col("n"))).collect()]
    assert got == ["", "a", "z", "aa", "zz", "aaa"]


def test_faulty_documents_become_error_rows(spark, tmp_path):
    (tmp_path / "a.tex").write_text(r"\begin{document}\input{part}\end{document}")
    (tmp_path / "b.tex").write_text("{")
    rows = {x.path.rsplit("/", 1)[-1]: x for x in corpus.pages(files.tex_files(spark, str(tmp_path)), "html", files={"part.tex": "inside"}).collect()}
    assert "inside" in rows["a.tex"].content and rows["a.tex"].error is None and rows["b.tex"].content is None and "TeXError" in rows["b.tex"].error


def test_include_paths(spark):
    refs = spark.createDataFrame([("m", "a"), ("m", "b.tex"), ("m", "c")], "path string, name string")
    found = includes.resolved(refs.withColumnRenamed("name", "include"), spark.createDataFrame([("a.tex",), ("b.tex",), ("a",)], "file string"))
    assert {x.include: x.target for x in found.collect()} == {"a": "a", "b.tex": "b.tex", "c": None}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tex").write_text(r"\begin{document}x\end{document}")
    done = documents.converted(documents.tex_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    done.awaitTermination(60)
    assert "<p>x</p>" in spark.table("pages").first().content


def test_letters_never_end(spark):
    got = [x[0] for x in spark.createDataFrame([(18277,), (18278,), (475253,), (475254,)], "n int").select(fn.letters(F.col("n"))).collect()]
    assert got == ["zzz", "aaaa", "zzzz", "aaaaa"]


def test_long_lineages(spark):
    n = 40
    own = spark.createDataFrame([(f"k{i}", "f", str(i)) for i in range(n)] + [("k39", "deep", "yes")], "key string, name string, value string")
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}", 0) for i in range(n - 1)] + [("k39", "k0", 0)], "child string, parent string, ord int")
    got = {(r["key"], r["name"]): r["value"] for r in bibliography.xdata(own, edges).filter("key = 'k0'").collect()}
    assert got == {("k0", "f"): "0", ("k0", "deep"): "yes"}


def test_media_that_cannot_be_read(spark):
    media = spark.createDataFrame([("d", 1, "a.png"), ("d", 2, "b.png")], "doc_id string, media_id int, name string")
    found = spark.createDataFrame([("x/a.png", bytearray(b"1"))], "path string, content binary")
    assert {r["media_id"]: r["content"] for r in files.with_media(media, found).collect()} == {1: b"1", 2: None}


def test_works_inherit_and_are_told_apart(spark):
    text = "@book{c, editor={Roe, Jane}, title={All}, location={Bern}, publisher={P}}@incollection{a, author={Doe, Al}, title={T}, year=1999, crossref={c}, pages={1--2}}@article{b, author={Doe, Al}, title={S}, year=1999, journal={J}, volume=3}@xdata{x, year=2000}"
    known = corpus.works(corpus.bib_fields(spark.createDataFrame([("a.bib", text)], "path string, text string")))
    cited = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("x", "a"), ("x", "none"), ("y", "a")], "doc_id string, key string")
    rows = works.by_document(cited, known).collect()
    assert [(r["key"], r["year"]) for r in rows if r["doc_id"] == "y"] == [("a", "1999")]
    got = {r["key"]: r for r in rows if r["doc_id"] == "x"}
    assert set(got) == {"a", "b", "c"} and got["a"]["year"] == "1999b" and got["b"]["year"] == "1999a"
    assert got["a"]["full"] == "Doe Al. 1999b. T. In Roe Jane (ed.), All, 1–2. Bern: P." and got["b"]["full"] == "Doe Al. 1999a. S. J 3."


@pytest.mark.parametrize("to, files_", [("html", ["out"]), ("html-multi", ["index.xhtml", "notes.xhtml", "section-001.xhtml"]), ("epub", ["out"]), ("xml", ["out"])])
def test_command_line_writes_files(spark, tmp_path, to, files_, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tex").write_text("\\documentclass{book}\\begin{document}\\mainmatter\\chapter{One}\\input{b}\\footnote{n}\\end{document}")
    (tmp_path / "in" / "b.tex").write_text("included text")
    out = tmp_path / "out"
    assert command.main(["-t", to, "-o", str(out), str(tmp_path / "in" / "a.tex")]) == 0
    made = [p for p in sorted(out.rglob("*") if out.is_dir() else [out]) if not p.name.endswith(".crc")]
    assert [p.name for p in made] == files_
    assert to == "epub" and made[0].read_bytes()[:2] == b"PK" or any("included text" in p.read_text() for p in made)


def test_deep_nesting_is_no_error(spark):
    rows = [("deep.tex", "\\begin{document}" + "{" * 3000 + "x" + "}" * 3000 + "\\end{document}"), ("bad.tex", "{")]
    got = {r["path"]: (r["error"], r["content"]) for r in corpus.pages(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["deep.tex"][0] is None and "<p>x</p>" in got["deep.tex"][1] and got["bad.tex"][0].startswith("TeXError")


def test_documents_carry_only_the_works_they_cite(spark, monkeypatch):
    bib = "@article{a, author={Doe, Al}, title={T}, year=1999, journaltitle={J}}@book{b, author={Roe, Jo}, title={Much}, year=2001, publisher={P}}"
    known = corpus.works(corpus.bib_fields(spark.createDataFrame([("a.bib", bib)], "path string, text string")))
    rows = [(f"d{i}", f"\\begin{{document}}\\citet{{{k}}}\\end{{document}}") for i, k in enumerate(("a", "b", "a,b", "none", "a"))] + [("bad", "{")]
    sources = spark.createDataFrame(rows, "path string, text string")
    docs = {r["path"]: r for r in corpus.with_works(corpus.parsed(sources), known).collect()}
    assert [[w["key"] for w in docs[f"d{i}"]["works"] or []] for i in (0, 1, 3, 4)] == [["a"], ["b"], [], ["a"]] and docs["bad"]["works"] is None and "TeXError" in docs["bad"]["error"]
    got = {r["path"]: (r["content"], r["error"]) for r in corpus.pages(sources, "html", known).collect()}
    assert "Doe Al (1999)" in got["d0"][0] and "Doe Al. 1999. T. J." in got["d0"][0] and "Much" not in got["d0"][0] and got["bad"][0] is None and "TeXError" in got["bad"][1]
    assert got["d2"][0] == corpus.pages(sources.filter("path = 'd2'"), "html", {r["key"]: r.asDict() for r in docs["d2"]["works"]}).first()["content"]


def test_archives_hold_the_images_their_documents_show(spark):
    import io
    import zipfile

    rows = [(f"d{i}", f"\\begin{{document}}\\begin{{figure}}\\includegraphics{{x/{m}}}\\caption{{c}}\\end{{figure}}\\end{{document}}") for i, m in enumerate(("a.png", "b.png", "gone.png"))]
    media = spark.createDataFrame([("y/a.png", bytearray(b"A")), ("y/b.png", bytearray(b"B"))], "path string, content binary")
    made = corpus.archives(spark.createDataFrame(rows, "path string, text string"), seed="s", date="2020-01-01", media=media).collect()
    held = {r["path"]: {n: z.read(n) for n in z.namelist() if n.endswith(".png")} for r in made for z in [zipfile.ZipFile(io.BytesIO(r["content"]))]}
    assert held == {"d0": {"OEBPS/a.png": b"A"}, "d1": {"OEBPS/b.png": b"B"}, "d2": {}}


def test_anchors_of_parsed_items_and_headers(spark):
    text = "\\mainmatter\\part{P}\\chapter[s]{C}\\label{c}\\section*{U}\\label{u}\\begin{exe}\\ex a\\label{i1}\\ex b\\begin{xlist}\\ex c\\ex d\\label{i2}\\begin{xlist}\\ex e\\label{i3}\\end{xlist}\\end{xlist}\\ex f\\label{i4 x}\\end{exe}\\section{S}\\footnote{n\\label{n}}\\ref{i2} \\ref{no}\\chapter{D}\\begin{exe}\\ex g\\label{i5}\\end{exe}\\ref{c}"
    atoms = corpus.atoms(spark.createDataFrame([("a", f"\\begin{{document}}{text}\\end{{document}}"), ("bad", "{")], "path string, text string"))
    rows = anchors.events(anchors.tree(atoms))
    bound = {r["label"]: r["anchor"] for r in numbering.labels(rows).collect()}
    assert bound == {"c": "sec-1", "u": "sec-1", "i1": "item-1-1", "i2": "item-1-2-2", "i3": "item-1-2-2-1", "i4 x": "item-1-3", "n": "sec-1-1", "i5": "item-2-1"}
    assert {(r["label"], r["target"]) for r in anchors.link_targets(rows).collect()} == {("i2", "section-003.xhtml#item-1-2-2"), ("no", ""), ("c", "section-002.xhtml#sec-1")}
    assert {"sec-unnumbered-1", "note-1-1"} <= {r["anchor"] for r in anchors.extracted(rows).collect()}


def test_sink_publishes_whole_jobs_only(spark, tmp_path):
    sink.register(spark)
    out = tmp_path / "out"
    rows = spark.range(50).selectExpr("concat('d', id % 5, '/f', id, '.html') AS target", "concat('é', id) AS content", "id AS more")
    rows.repartition(4).write.format("foliospark_files").mode("append").save(str(out))
    assert {p.relative_to(out).as_posix(): p.read_text() for p in out.rglob("*") if p.is_file()} == {f"d{i % 5}/f{i}.html": f"é{i}" for i in range(50)}
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="below the folder"):
            rows.selectExpr(f"CASE id WHEN 49 THEN '{bad}' ELSE concat('n', id) END AS target".replace("id", "more"), "content").write.format("foliospark_files").mode("append").save(str(out))
    assert not [p for p in out.iterdir() if p.name[0] != "d"] and not (tmp_path / "x").exists()
    rows.limit(1).write.format("foliospark_files").mode("overwrite").save(str(out))
    assert [p.relative_to(out).as_posix() for p in out.rglob("*") if p.is_file()] == ["d0/f0.html"]


def test_failed_attempts_leave_nothing(tmp_path):
    w = sink.FileWriter(str(tmp_path / "out"), ["target", "content"], False)
    one = w.write(iter([("a/b", "first")]))
    w.write(iter([("a/b", "again")]))  # an attempt whose message is lost
    with pytest.raises(ZeroDivisionError):
        w.write(x if x else 1 / 0 for x in [("c", "x"), None])
    w.commit([one, None])
    assert [p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*")] == ["a", "a/b"] and (tmp_path / "out/a/b").read_text() == "first"


def test_bibliographies_are_read_in_parts(spark, tmp_path, monkeypatch):
    sink.register(spark)
    for i in range(6):
        (tmp_path / f"f{i}.bib").write_text(f"@book{{k{i}, title = {{T{i}}}, year = 200{i}}}" if i != 3 else "@book{k3, title = ")
    (tmp_path / "other.txt").write_text("@book{no, title = {no}}")
    rows = spark.read.format("foliospark_bib").load(str(tmp_path)).collect()
    want = corpus.bib_fields(files.bib_files(spark, f"{tmp_path}/*.bib")).collect()
    assert sorted(map(repr, (r[1:] for r in rows))) == sorted(map(repr, (r[1:] for r in want))) and len({r["path"] for r in rows}) == 6
    monkeypatch.setattr(sink, "PART", 60)
    assert len(sink.BibReader(str(tmp_path)).partitions()) > 2 and spark.read.format("foliospark_bib").load(str(tmp_path / "f1.bib")).filter("name = 'year'").first()["value"] == "2001"
