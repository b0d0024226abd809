import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pytest

from foliospark.kernels.bibtex import BibParser, agent, parse_bib, split_words
from foliospark.kernels.document import anchor_id, plain, read_document, read_inlines
from foliospark.kernels.lexer import TeXError, lex
from foliospark.kernels.parser import parse, rows
from foliospark.kernels.writers import cited, epub_files, split, to_epub, to_html, to_pages, to_tei


def shown(text, **kw):
    return "".join(t.show() for t in lex(text, **kw))


@pytest.mark.parametrize(
    "text, want",
    [
        ("a  b", "a b"),
        ("  a", "a"),
        ("a\n\n\n b", "a\\parb"),
        ("a% gone\n   b", "ab"),
        ("a%x\n\nb", "a\\parb"),
        ("{a{b}}", "{a{b}}"),
        (r"\newcommand{\x}[2][q]{<#1|#2>}\x{a}\x[b]{c}", "<q|a><b|c>"),
        (r"\newcommand{\x}{1}\providecommand{\x}{2}\x", "1"),
        (r"\renewcommand{\x}{2}\x", "2"),
        (r"\def\a#1.#2{(#2#1)}\a xy.z", "(zxy)"),
        (r"{\def\a{1}\a}\def\a{2}\a", "{1}2"),
        (r"{\newcommand{\a}{1}}\a", "{}1"),
        (r"\iftrue a\iffalse b\else c\fi\else d\fi", "ac"),
        (r"\let\b=\iftrue\b x\else y\fi", "x"),
        (r"\NewDocumentCommand\f{s o m}{\IfBooleanTF{#1}{S}{N}\IfNoValueTF{#2}{-}{#2}#3}\f*{x}\f[y]{z}", "S-xNyz"),
        (r"\newenvironment{e}[1]{B#1}{E}\begin{e}{q}mid\end{e}", "BqmidE"),
        (r"\char65 \number'17 \number" + '"FF .', "A15255."),
        (r"{\catcode`\%=12 %}", "{%}"),
        (r"\(x\)\[y\]", "$x$$$y$$"),
        (r"\def\a{b}\meaning\a", "macro:->b"),
        (r"\input{f}", "inside"),
        (r"\year", ""),
        (r"\let\x=\y\def\y{1}\x", "\\x"),
        (r"\let\x=\y\def\y{1}\let\z=\x\meaning\z", "undefined"),
        (r"{\catcode`\a=13 a}a", "{a}a"),
        (r"\input{f}\input{f}", "insideinside"),
    ],
)
def test_lexer(text, want):
    assert shown(text, resolver={"f.tex": "inside"}) == want


@pytest.mark.parametrize("text", ["{", "}", r"\begin{a}\end{b}", r"\def\a{\a}\a", r"\fi", r"\input{nothing}", "\x7f", r"\catcode65=16 ", r"\input{g}"])
def test_lexer_errors(text):
    with pytest.raises(TeXError):
        lex(text, resolver={"g.tex": r"x\input{h}", "h.tex": r"y\input{g}"})


def test_long_texts_are_no_loops():
    assert len(lex(r"\(x\) " * 60_000)) == 240_000 and len(lex(r"\def\a{b}" + r"\a " * 150_000)) == 150_000


def test_notes_and_works_have_pages():
    d = read_document("\\documentclass{book}\\begin{document}\\mainmatter\\chapter{One}\\label{a}text\\footnote{A note} \\citet{k}.\\end{document}")
    works = {"k": {"agents": "Roe", "year": "1999", "full": "Roe. 1999. Book."}}
    pages = to_pages(d, works)
    assert list(pages) == ["index.xhtml", "section-001.xhtml", "notes.xhtml", "bibliography.xhtml"]
    assert 'href="notes.xhtml#notetext-1-1"' in pages["section-001.xhtml"] and 'href="section-001.xhtml#note-1-1"' in pages["notes.xhtml"] and "Roe. 1999. Book." in pages["bibliography.xhtml"]
    assert 'href="notes.xhtml"' in pages["index.xhtml"]
    with zipfile.ZipFile(BytesIO(to_epub(d, works, "u-1", cover=("cover.png", b"png")))) as z:
        names, package = z.namelist(), z.read("OEBPS/content.opf").decode()
        assert {"OEBPS/notes.xhtml", "OEBPS/bibliography.xhtml", "OEBPS/cover.png"} <= set(names) and names[0] == "mimetype"
        assert 'content="cover-image"' in package and 'media-type="image/png"' in package and "urn:uuid:u-1" in package and "Notes" in z.read("OEBPS/toc.ncx").decode()
        for n in names:
            if n.endswith((".xhtml", ".opf", ".ncx", ".xml")):
                ElementTree.fromstring(z.read(n))


def test_pure_mode_ignores_includes():
    assert shown(r"a\input{f}b") == "ab"


@pytest.mark.parametrize(
    "text, want",
    [(r"\'{e}", "é"), (r"\^{\i}", "ı̂"), (r"\alpha\Omega", "αΩ"), ("--- -- ``a'' ?`b", "— – “a” ¿b"), (r"\discretionary{a}{b}{c}", "c"), ("~", "\xa0"), (r"\o\O", "øØ"), (r"\sin", "sin"), (r"\t{oo}", "o͡o"), (r"\biguplus\colon\TeX", "⊎:TeX"), (r"\'{}", " ́"), (r"\%\&", "%&")],
)
def test_rewriting(text, want):
    import unicodedata

    got = "".join(n.text if n.kind == "plain" else " " for n in parse(lex(text)))
    assert unicodedata.normalize("NFC", got) == unicodedata.normalize("NFC", want)


def test_preorder_rows_nest():
    got = rows(parse(lex(r"a \section*[s]{T \emph{x}} $a^2$ \begin{tabular}{l}a&b\\\end{tabular}")))
    for i, (node, last, parent, depth, *_rest) in enumerate(got):
        assert node == i <= last
        if parent >= 0:
            assert parent < node <= last <= got[parent][1] and depth == got[parent][3] + 1


TEXT = r"""\documentclass{book}\title{A \emph{T}}\author{X}\date{1999}
\begin{document}\frontmatter\chapter{Pre}\mainmatter
\chapter{One\footnote{in title}}\label{c1} Text \citep[see][12]{a, b} and \ref{s1}, \ref{zz}.

Next. \section{Sec}\label{s1}
\begin{figure}\centering\includegraphics{f.png}\caption{Cap}\label{f}\end{figure}
\begin{tabular}{l}a & b\\ \multicolumn{2}{l}{c}\\\end{tabular}
\begin{exe}\ex one \label{e1} \ex two \begin{xlist}\ex sub \label{e2}\end{xlist}\end{exe}
\chapter*{Star} x\footnote{n}\end{document} ignored"""
WORKS = {"a": {"agents": "Doe", "year": "2000", "full": "Doe. 2000."}, "b": {"agents": "Doe", "year": "2001", "full": "Doe. 2001."}}


def test_document_counters():
    d = read_document(TEXT)
    ids = {k: anchor_id(a) for k, a in d["labels"].items()}
    assert ids == {"c1": "sec-1", "s1": "sec-1-1", "f": "figure-1-1", "e1": "item-1-1", "e2": "item-1-2-1"}
    assert d["cites"] == {"a": 0, "b": 1} and d["media"] == ["f.png"]
    assert [(n["chapter"], n["n"]) for n in d["notes"]] == [(1, 1)]  # numbers go by chapter alone, so the later note takes the place of the earlier
    assert plain(d["meta"]["title"]) == "A T"


def test_repeated_keys_keep_numbers_and_leave_gaps():
    d = read_document(r"\begin{document}\cite{a,b}\cite{b,c}\cite{a,d}\end{document}")
    assert d["cites"] == {"a": 0, "b": 1, "c": 3, "d": 5}


def test_writers():
    d = read_document(TEXT)
    html, tei = to_html(d, WORKS), to_tei(d, WORKS)
    assert "(see Doe 2000, 2001, 12)" in html and '<a href="#sec-1-1">1.1</a>' in html and '<a href="">???</a>' in html
    assert '<td colspan="2">c</td>' in html and "<h2>Notes</h2>" in html and html.startswith("<!DOCTYPE html>")
    assert tei.index("<front>") < tei.index("<body>") and '<ref target="#sec-1-1">1.1</ref>' in tei
    assert [n for n, _, _ in split(d, 2)] == ["section-001.xhtml", "section-002.xhtml", "section-003.xhtml"]
    assert 'href="section-002.xhtml#sec-1"' in to_pages(d, WORKS)["index.xhtml"]
    names = list(epub_files(d, WORKS))
    assert names[:4] == ["mimetype", "META-INF/container.xml", "OEBPS/content.opf", "OEBPS/toc.ncx"]
    with zipfile.ZipFile(BytesIO(to_epub(d, WORKS))) as z:
        assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip"
    assert to_epub(d, WORKS) == to_epub(d, WORKS)


@pytest.mark.parametrize("mode, want", [("parentheses", "(Doe 2000, 2001; Roe 1999)"), ("text", "Doe (2000, 2001) and Roe (1999)"), ("author", "Doe and Roe"), ("year", "2000, 2001; 1999"), ("inline", "Doe 2000, 2001; Roe 1999")])
def test_citation_modes(mode, want):
    works = WORKS | {"r": {"agents": "Roe", "year": "1999"}}
    assert cited({"mode": mode, "pre": [], "post": [], "keys": ["a", "b", "unknown", "r"]}, works) == want


@pytest.mark.parametrize("text", [r"\begin{document}\textit{x}\end{document}", r"x\begin{document}\end{document}", "no document", r"\begin{document}\begin{nothing}\end{nothing}\end{document}"])
def test_document_errors(text):
    with pytest.raises(TeXError):
        read_document(text)


def test_gloss():
    d = read_document("\\begin{document}\\gll a {b c} d\\\\ x y\\\\\n\\trans whole\\end{document}")
    g = d["blocks"][0]
    assert [[plain(c["body"]) for c in r] for r in g["rows"]] == [["a", "b c", "d"], ["x", "y"], ["whole"]] and g["rows"][2][0]["span"] == 3


@pytest.mark.parametrize(
    "name, want",
    [
        ("Jane Roe", ("Jane", "", "Roe", "")),
        ("Roe", ("", "", "Roe", "")),
        ("Jane de la Roe", ("Jane", "de la", "Roe", "")),
        ("de la Roe, Jane", ("Jane", "de la", "Roe", "")),
        ("de la Roe, Jr, Jane", ("Jane", "de la", "Roe", "Jr")),
        ("jane roe", ("", "jane", "roe", "")),
        ("{Big Corp and Sons}", ("", "", "Big Corp and Sons", "")),
        ("A, B, C, D", ("C, D", "", "A", "B")),
    ],
)
def test_names(name, want):
    assert tuple(agent(name).values()) == want


def test_word_split():
    assert split_words("A and {B and C} and  D and") == ["A", "{B and C}", "D"]


def test_bib():
    text = r'@string{x = "Foo"} text @book{k, title = x # { and} # " B", month = MAR, year = 1990, year = 1991, note = undefined} @misc(k, note={late}) @comment{c} @string{x="Bar"} @misc{m, title = x}'
    got = {(k, n): v for _, k, _, n, _, v in parse_bib(text)}
    assert got == {("k", "title"): "Foo and B", ("k", "month"): "3", ("k", "year"): "1991", ("k", "note"): "", ("m", "title"): "Bar"}
    with pytest.raises(TeXError):
        BibParser("@book{k, title = {open").entries()


def test_snippets():
    import unicodedata

    assert unicodedata.normalize("NFC", plain(read_inlines(r"B{\"a}r \& \emph{co}"))) == unicodedata.normalize("NFC", "B\u00e4r & co")


def test_pages_are_whole():
    text = r"\documentclass{book}\title{Much}\subtitle{More}\author{Roe}\begin{document}\mainmatter\chapter{One}\section{Two}\citet{a}\footnote{n}\begin{quotation}\subsection{In}\end{quotation}\chapter*{Star}\begin{figure}\includegraphics{f.png}\caption{Cap}\end{figure}\chapter{Last}x\footnote{\begin{itemize}\item i\end{itemize}}\end{document}"
    pages = to_pages(read_document(text), {"a": {"agents": "Doe", "year": "2000", "full": "Doe. 2000."}})
    for page in pages.values():
        ElementTree.fromstring(page)
        assert "<header><h1>Much</h1><h2>More</h2><p>Roe</p></header>" in page and page.count("<main>") == 1
    one, notes = pages["section-001.xhtml"], pages["notes.xhtml"]
    assert '<span class="citation-group"><a href="bibliography.xhtml#bib-0" class="citation">Doe</a> (<a href="bibliography.xhtml#bib-0" class="citation">2000</a>)</span>' in one and 'id="bib-0"' in pages["bibliography.xhtml"]
    assert '<h5 id="sec-1-1-1">1.1.1 In</h5>' in one and "<figcaption>Figure 1.1: Cap</figcaption>" in pages["section-002.xhtml"]
    assert '<section id="sec-back-unnumbered-2">' in notes and '<section id="sec-back-unnumbered-3"><h3>Chapter 1</h3><ol class="notes"><li id="notetext-1-1"><p>n <a href="section-001.xhtml#note-1-1" class="note-backref">↩</a></p></li>' in notes
    assert '</ul><p><a href="section-003.xhtml#note-2-1" class="note-backref">↩</a></p></li>' in notes and '<section id="sec-back-unnumbered-5"><h2>Bibliography</h2>' in pages["bibliography.xhtml"]
    assert '>1.1 Two</a>' in pages["index.xhtml"] and '<li><a href="notes.xhtml#sec-back-unnumbered-4">Chapter 2</a></li>' in pages["index.xhtml"]
