"""Work that has to stay bounded or spread as tables grow, with the results that it had before."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.kernels.document import read_document
from foliospark.kernels.lexer import lex, lex_runs
from foliospark.kernels.parser import parse, rows
from foliospark.kernels.writers import epub_files, to_html, to_pages, to_tei

ODD = [
    "one two  three\nfour", r"\emph two three", r"a\char65 b c", r"x y\char45 - z", r"\section*[s t]{u v} w", r"\item [a b] c [d]", r"^ab c_de f", r"{\catcode`\a=12 a b} c d", r"\sin²x y", "``a b'' c--d e",
    r"\def\x#1{<#1>}\x ab c \x{d e} f", r"\multicolumn{2}l c", r"\'{ab c} d\discretionary{}{}{}e f", r"\unknown*[a b][c]{d e}f g", r"\newcommand{\n}[2][d]{(#1 #2)}\n ab \n[q r]{s} t", r"\input{f}g h \input f i", "a\\&b c\\%d",
]


@pytest.mark.parametrize("text", ODD)
def test_runs_give_the_same_trees(text):
    files = {"f": "in side"}
    assert rows(parse(lex_runs(text, files))) == rows(parse(lex(text, files)))


def test_long_texts_are_few_tokens():
    assert len(lex_runs("word " * 1000 + "end")) == 1 and len(lex_runs("one two\n" * 10)) == 20


def test_joined_documents_are_written_alike():
    text = "\\documentclass{book}\\title{A b}\\begin{document}\\mainmatter\\chapter{One two}\\label{a} x y \\emph{z w} <\\&>\\footnote{a note} \\ref{a}\\begin{tabular}{l}a b&c\\\\\\end{tabular}\n\n\\gll a {b c} d\\\\ x y\\\\\n\\trans whole text\\end{document}"
    apart, joined = read_document(text), read_document(text, joined=True)
    assert apart != joined
    for f in (to_html, to_tei, to_pages, epub_files):
        assert f(apart) == f(joined)


def test_tokens_as_columns():
    from foliospark.operators.corpus import _columns

    for text in [*ODD, "", "é 😀 ²x\\$ ~"]:
        made = _columns("p", lex_runs(text, {"f": "in side"}))
        made.validate(full=True)
        assert [tuple(r.values()) for r in made.to_pylist()] == [("p", i, t.kind, t.text, t.cat, t.active, t.level, None) for i, t in enumerate(lex(text, {"f": "in side"}))]


def test_sources_are_dealt_over_cores(spark):
    from foliospark.plans import kernels

    bibs = kernels._bibs(spark, "/root/testdata/sf0.001").rdd.glom().map(len).collect()
    assert sum(n > 0 for n in bibs) > 1


def test_results_of_large_batches_come_in_parts():
    from foliospark.operators import corpus

    text = "\\begin{document}" + "word " * 20_000 + "\\end{document}"
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * 100), pa.array([text] * 100)], names=["path", "text"])
    made = corpus._each(lambda t, inc: [("f", t)], corpus.PAGES, None)(iter([batch]))
    sizes = [b.num_rows for b in made]
    assert sum(sizes) == 100 and max(sizes) <= 1 + corpus.HELD // len(text)


def test_modes_are_made_in_one_pass(spark):
    from foliospark.plans import citing

    plan = citing.cite_modes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("l_orderkey") == citing.cite_groups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey")


def test_pages_are_dealt_by_their_bytes(spark, monkeypatch):
    from foliospark.plans import trees
    from foliospark.sources import markup

    monkeypatch.setattr(markup, "TASK_BYTES", 10_000)
    size = sum(len(r.html.encode()) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect())
    assert trees._tree(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-size // 10_000) > 4


def test_walks_of_files_carry_no_texts(spark, monkeypatch):
    from foliospark.operators import includes

    kept, checkpointed = [], includes.checkpointed
    monkeypatch.setattr(includes, "checkpointed", lambda df: kept.append(df.columns) or checkpointed(df))
    lines = [("a", i, f"t{i}", None) for i in range(12) if i != 10] + [("a", 10, None, "b"), ("b", 1, "x", None), ("b", 2, None, "a"), ("b", 3, None, "none")]
    frame = spark.createDataFrame(lines, "file string, pos int, text string, include string")
    roots = spark.createDataFrame([("a",)], "file string")
    got = sorted(map(tuple, includes.spliced(includes.resolved(frame, frame.select("file").distinct()), roots).collect()), key=lambda r: r[1])
    want = [("a", f"t{i}", 1, None) for i in range(10)] + [("b", "x", 2, None), ("b", None, 2, "cycle"), ("b", None, 2, "missing"), ("a", "t11", 1, None)]
    assert [r[2:] for r in got] == want and [r[1] for r in got] == list(range(1, 15))
    assert not any("text" in columns for columns in kept)


def test_spliced_texts_cross_no_sort_and_rounds_are_deleted(spark):
    from pathlib import Path

    from foliospark.operators import includes

    lines = [("a", i, f"t{i}", None) for i in range(4) if i != 2] + [("a", 2, None, "b"), ("b", 1, "x", None), ("b", 2, None, "a"), ("b", 5, None, "empty"), ("b", 7, "y", None)]
    frame = spark.createDataFrame(lines, "file string, pos int, text string, include string")
    listing = spark.createDataFrame([("a",), ("b",), ("empty",)], "file string")
    spark.range(1).checkpoint()
    root = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    there = set(root.glob("table-*"))
    out = includes.spliced(includes.resolved(frame, listing), spark.createDataFrame([("a",)], "file string"))
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert got == [("a", i, *x) for i, x in enumerate([("a", "t0", 1, None), ("a", "t1", 1, None), ("b", "x", 2, None), ("b", None, 2, "cycle"), ("b", "y", 2, None), ("a", "t3", 1, None)], 1)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    kept = [set(spark.read.parquet(str(p)).columns) for p in set(root.glob("table-*")) - there]
    assert kept and not any("_open" in columns for columns in kept)


def test_marks_braces_and_names_are_read_at_once(monkeypatch):
    from foliospark.kernels.lexer import Lexer

    calls, raw = [], Lexer.raw
    monkeypatch.setattr(Lexer, "raw", lambda self: calls.append(1) or raw(self))
    lex_runs("\\begin{itemize}" + "50\\% of {it} \\& that\nline " * 1000 + "\\end{itemize}")
    assert len(calls) < 10


MARKED = [r"a \% b\%c \{d\} \% {e}", "\\&\n\\& %x\n\\$ ", r"\def\%{Q}a \% b{\let\&=a\&}\&", r"{\catcode`\%=12 \% %}\%", r"\begin{a b}x\end{a b}", r"\begin{figure*}\%\end{figure*}", "{a} {b}\n{c}\n\n{d}", r"\\% gone", r"a\emph{b}\% c"]


@pytest.mark.parametrize("text", MARKED)
def test_marks_give_the_same_trees(text):
    assert rows(parse(lex_runs(text))) == rows(parse(lex(text)))


@pytest.mark.parametrize("text", [*ODD, *MARKED])
def test_rows_of_runs_stand_for_the_same_nodes(text):
    made = rows(parse(lex_runs(text, {"f": "in side"})), runs=True)
    apart = []
    for me, last, parent, depth, order, kind, name, shown, arg, place in made:
        words = [x for w in shown.split(" ") for x in (("plain", w), ("white", ""))][:-1] if kind == "words" else [(kind, shown)]
        apart += [(me + i, me + i if kind == "words" else last, parent, depth, order + i, k, name, t, arg, place) for i, (k, t) in enumerate(words)]
    assert apart == rows(parse(lex_runs(text, {"f": "in side"})))
    assert len(rows(parse(lex_runs("one two three " * 100)), runs=True)) < 5


def test_tokens_and_nodes_are_counted_by_runs(spark):
    from foliospark.operators import corpus
    from foliospark.plans import kernels

    small = "/root/testdata/sf0.001"
    sources = kernels._sources(spark, small)
    assert corpus.tokens(sources, runs=True).count() * 10 < corpus.tokens(sources).count()
    for query in (kernels.lex_tex, kernels.parse_tex):
        plan = query(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "words" in plan
    want = {(r.path, r.kind): (r.n, r.deepest) for r in corpus.atoms(sources).groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).collect()}
    assert {(r.path, r.kind): (r.n, r.deepest) for r in kernels.parse_tex(spark, small).collect()} == want
    tokens = {r.path: r["count"] for r in corpus.tokens(sources).groupBy("path").count().collect()}
    assert {r.path: r.n_tokens for r in kernels.lex_tex(spark, small).collect()} == tokens


def test_plain_fields_take_no_lexer(monkeypatch):
    from foliospark.kernels import bibtex

    text = "@book{k, title = b # { Some title}, note = {x}, author = {von B, Al and Roe, Jane}, location = {A and B}}"
    want = [(0, "k", "book", "title", "literal", "Some title"), (0, "k", "book", "note", "literal", "x"), (0, "k", "book", "author", "agents", "von B Al; Roe Jane"), (0, "k", "book", "location", "list", "A|B")]
    calls, read = [], bibtex.read_inlines
    monkeypatch.setattr(bibtex, "read_inlines", lambda t: calls.append(t) or read(t))
    assert bibtex.parse_bib(text) == want and not calls
    for odd in ("a  b", "a\nb", "``a''", "a--b", "{A} b", r"\'e", "a\tb", "~", "", " a "):
        assert bibtex.read(odd) == bibtex.plain(read(odd))


def test_bibliographies_are_parsed_once(spark):
    from foliospark.plans import kernels

    plan = kernels.bib_resolved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


TREE = r"\documentclass{book}\begin{document}one two \chapter[s \label{in}]{A \emph{b \label{x_{y} z}}} words \begin{figure}\includegraphics[w \emph{x}]{x/f}\caption{c \ref{x y}}\end{figure}\citet[see \emph{p}][q]{k, l}{loose \label{m}}\begin{exe}\ex a\begin{xlist}\ex b\end{xlist}\end{exe}\end{document}"


def test_rows_of_named_nodes():
    import re

    from foliospark.operators import anchors

    tree = parse(lex_runs(TREE))
    every, some = rows(tree), rows(tree, named=re.compile(anchors.NAMED), whole=re.compile(anchors.TEXTS))
    spans = [r for r in every if r[5] in ("command", "group") and re.fullmatch(anchors.TEXTS, r[6])]
    assert some == [r for r in every if r[3] == 0 or r[5] in ("command", "group") and re.fullmatch(anchors.NAMED, r[6]) or any(s[0] < r[0] <= s[1] for s in spans)]
    assert len(some) < len(every)


def test_events_and_counts_of_named_nodes(spark):
    from foliospark.operators import anchors, corpus

    sources = spark.createDataFrame([("1", TREE), ("2", "\\begin{document}plain text\\end{document}"), ("3", "\\emph{bad")], "path string, text string")
    every = anchors.tree(corpus.atoms(sources))
    some = anchors.tree(corpus.atoms(sources, named=anchors.NAMED, whole=anchors.TEXTS))
    for f in (anchors.events, anchors.counts):
        got = sorted(map(str, f(some).collect()))
        assert got and got == sorted(map(str, f(every).collect()))


def test_trees_are_kept_without_running_text(spark, monkeypatch):
    from foliospark.plans import documents

    kept = []
    monkeypatch.setattr(documents, "written", lambda df: kept.append(df) or df)
    documents._nodes(spark, "/root/testdata/sf0.001")
    assert kept[0].filter("depth > 2 AND kind = 'white'").count() == 0
    assert kept[0].filter("kind = 'command' AND name = 'emph'").count() == 0


def test_shared_trees_are_columns(spark):
    from foliospark.plans import documents

    assert documents._nodes(spark, "/root/testdata/sf0.001").inputFiles()


def test_words_in_braces_and_brackets_are_taken_at_once(monkeypatch):
    from foliospark.kernels.parser import Parser

    calls, node = [], Parser.node
    monkeypatch.setattr(Parser, "node", lambda self: calls.append(1) or node(self))
    made = parse(lex_runs(r"\section[short]{One more}\label{a}"))
    assert len(calls) == 2 and rows(made) == rows(parse(lex(r"\section[short]{One more}\label{a}")))


@pytest.mark.parametrize("text", ["a\n\n\nb", "a\n\n b", "a\n\n%x\nb", "a\n\n", "\n\na", r"\def\par{P}a" + "\n\nb", "\\emph{a}\n\n\\emph{b}", r"\section[a]b{c}", r"\section[a]]{c}", r"\section[[a]]{c}", r"\section[]{c}"])
def test_blank_lines_and_brackets_as_before(text):
    assert rows(parse(lex_runs(text))) == rows(parse(lex(text)))
