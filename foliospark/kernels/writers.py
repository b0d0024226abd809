"""Documents to HTML, TEI XML and EPUB text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape as _escape

from .document import anchor_id, anchor_number, plain

#: Names of divisions in TEI.
DIVISIONS = {1: "part", 2: "chapter", 3: "section", 4: "subsection", 5: "subsubsection"}
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


#: Characters that are written in another way.
_ESCAPED = re.compile("[&<>\"']")


def esc(text: str) -> str:
    return text if not _ESCAPED.search(text) else _escape(text, {'"': "&quot;", "'": "&#39;"})


def el(name: str, body: str, **attrs: str) -> str:
    shown = "".join(f' {k.rstrip("_").replace("_", ":")}="{esc(v)}"' for k, v in attrs.items() if v is not None)
    return f"<{name}{shown}>{body}</{name}>" if body or name not in ("img", "ptr", "meta", "link") else f"<{name}{shown}/>"


def sections(blocks: list[dict]) -> list[dict]:
    """Headers and what follows them as nested sections; what stands before the first header has a section without one."""
    root: dict = {"level": 0, "header": None, "blocks": [], "parts": []}
    stack = [root]
    for b in blocks:
        if b["kind"] == "header":
            while stack[-1]["level"] >= b["level"]:
                stack.pop()
            s = {"level": b["level"], "header": b, "blocks": [], "parts": []}
            stack[-1]["parts"].append(s)
            stack.append(s)
        else:
            stack[-1]["blocks"].append(b)
    return root


def cited(x: dict, works: dict[str, dict], link=lambda key, text: text, notes=plain) -> str:
    """Text of a citation in its mode; unknown works drop out. works: key to agents and year.

    link: what agents and years become, by the key of their work; those of several works link to the first. notes: what stands before and after.
    """
    groups: list[tuple[str, str, list[str]]] = []
    for k in x["keys"]:
        if k in works:
            w = works[k]
            if groups and groups[-1][0] == w["agents"]:
                groups[-1][2].append(link(k, w["year"]))
            else:
                groups.append((w["agents"], link(k, w["agents"]), [link(k, w["year"])]))
    mode, parts = x["mode"], []
    for i, (_, agents, years) in enumerate(groups):
        pre = notes(x["pre"]) + " " if x["pre"] and i == 0 else ""
        post = ", " + notes(x["post"]) if x["post"] and i == len(groups) - 1 else ""
        y = ", ".join(years) + post
        parts.append(agents if mode == "author" else pre + y if mode in ("year", "yearpar") else f"{agents} ({pre}{y})" if mode == "text" else f"{pre}{agents} {y}")
    joined = (", ".join(parts[:-1]) + " and " + parts[-1] if len(parts) > 1 else "".join(parts)) if mode in ("text", "author") else "; ".join(parts)
    return f"({joined})" if mode in ("parentheses", "yearpar") else joined


class Html:
    """linked: agents and years of citations link to the bibliography."""

    def __init__(self, doc: dict, works: dict[str, dict] | None = None, version: int = 5, files: dict[str, str] | None = None, linked: bool = False):
        self.doc, self.works, self.version, self.files, self.linked = doc, works or {}, version, files or {}, linked

    def target(self, a: dict) -> str:
        i = anchor_id(a)
        return f"{self.files.get(i, '')}#{i}"

    def new(self, name: str, body: str, **attrs: str) -> str:
        """An element of HTML 5, or a division of that class before it."""
        return el(name, body, **attrs) if self.version == 5 else el("div", body, class_=name, **attrs)

    def inlines(self, xs: list[dict]) -> str:
        out = ""
        for x in xs:
            k = x["kind"]
            if k == "str":
                out += esc(x["text"])
            elif k == "space":
                out += " "
            elif k == "style":
                tag = {"emph": "em", "sup": "sup", "sub": "sub"}.get(x["style"])
                out += el(tag, self.inlines(x["body"])) if tag else el("span", self.inlines(x["body"]), class_="normal")
            elif k == "math":
                out += el("span", self.inlines(x["body"]), class_="math")
            elif k == "link":
                out += el("a", self.inlines(x["body"]), href=x["target"], class_=x.get("class"))
            elif k == "pointer":
                a = self.doc["labels"].get(x["label"])
                out += el("a", esc(anchor_number(a)) if a else "???", href=self.target(a) if a else "")
            elif k == "note":
                i = anchor_id(x["anchor"])
                text = f"notetext-{i.removeprefix('note-')}"
                out += el("a", el("sup", str(x["anchor"]["n"])), id=i, href=f"{self.files.get(text, '')}#{text}")
            elif k == "cite":
                out += el("span", cited(x, self.works, self.work, self.inlines), class_="citation-group") if self.linked else esc(cited(x, self.works))
        return out

    def work(self, key: str, text: str) -> str:
        """A link to a work in the bibliography."""
        return el("a", esc(text), href=self.target({"kind": "bib", "n": self.doc["cites"][key]}), class_="citation") if text else ""

    def table(self, rows: list) -> str:
        return el("table", "".join(el("tr", "".join(el("td", self.inlines(c["body"]), colspan=str(c["span"]) if c["span"] > 1 else None) for c in r)) for r in rows))

    def blocks(self, bs: list[dict]) -> str:
        out = ""
        for b in bs:
            k = b["kind"]
            if k == "para":
                out += el("p", self.inlines(b["body"]))
            elif k in ("itemize", "enumerate"):
                out += el("ul" if k == "itemize" else "ol", "".join(el("li", self.blocks(i)) for i in b["items"]))
            elif k == "quotation":
                out += el("blockquote", self.blocks(b["blocks"]))
            elif k == "figure":
                out += self.new("figure", el("img", "", src=b["image"], alt="") + self.new("figcaption", self.caption("Figure", b)), id=anchor_id(b["anchor"]))
            elif k == "table":
                out += el("div", self.table(b["rows"]) + el("p", self.caption("Table", b), class_="caption"), id=anchor_id(b["anchor"]), class_="table")
            elif k in ("simpletable", "gloss"):
                out += self.table(b["rows"])
            elif k == "examples":
                out += el("dl", "".join(el("dt", f"({anchor_number(i['anchor'])})", id=anchor_id(i["anchor"])) + el("dd", self.blocks(i["body"])) for i in b["items"]), class_="itemlist")
            elif k == "header":  # within other blocks; it has no section of its own
                out += self.heading(b, anchor_id(b["anchor"]))
        return out

    def caption(self, name: str, b: dict) -> str:
        return f"{name} {anchor_number(b['anchor'])}: " + self.inlines(b["caption"])

    def numbered(self, h: dict) -> str:
        """A header's title with its number, if it has one."""
        number = anchor_number(h["anchor"]) if not h["anchor"].get("phantom") else ""
        return (f"{number} " if number else "") + self.inlines(h["body"])

    def heading(self, h: dict, id_: str | None = None) -> str:
        return el(f"h{min(6, h['level'] + 1)}", self.numbered(h), id=id_)

    def section(self, s: dict, deep: bool = True) -> str:
        inner = self.heading(s["header"]) + self.blocks(s["blocks"]) + ("".join(self.section(p) for p in s["parts"]) if deep else "")
        return self.new("section", inner, id=anchor_id(s["header"]["anchor"]))

    def contents(self, parts: list[dict]) -> str:
        return el("ul", "".join(el("li", el("a", self.numbered(p["header"]), href=self.target(p["header"]["anchor"])) + (self.contents(p["parts"]) if p["parts"] else "")) for p in parts))

    def appended(self, i: int) -> str:
        """The anchor of the i-th unnumbered section after the text's own."""
        return f"sec-back-unnumbered-{self.doc.get('phantoms', 0) + i}"

    def chapters(self) -> dict[int, list[dict]]:
        """Notes by their chapters."""
        out: dict[int, list[dict]] = {}
        for n in self.doc["notes"]:
            out.setdefault(n["chapter"], []).append(n)
        return out

    def note(self, n: dict) -> str:
        """A note's text; its last paragraph ends in a link back to its mark."""
        i, body = f"{n['chapter']}-{n['n']}", n["body"]
        back = {"kind": "link", "target": f"{self.files.get(f'note-{i}', '')}#note-{i}", "class": "note-backref", "body": [{"kind": "str", "text": "↩"}]}
        if body and body[-1]["kind"] == "para":
            body = [*body[:-1], {"kind": "para", "body": [*body[-1]["body"], {"kind": "space"}, back]}]
        else:
            body = [*body, {"kind": "para", "body": [back]}]
        return el("li", self.blocks(body), id=f"notetext-{i}")

    def notes(self) -> str:
        out = "".join(self.new("section", el("h3", f"Chapter {c}") + el("ol", "".join(map(self.note, ns)), class_="notes"), id=self.appended(i)) for i, (c, ns) in enumerate(self.chapters().items(), 2))
        return self.new("section", el("h2", "Notes") + out, id=self.appended(1)) if out else ""

    def references(self) -> str:
        keys = sorted((k for k in self.doc["cites"] if k in self.works), key=lambda k: (self.works[k].get("full", ""), k))
        chapters = self.chapters()
        return self.new("section", el("h2", "Bibliography") + "".join(el("p", esc(self.works[k].get("full", "")), id=f"bib-{self.doc['cites'][k]}") for k in keys), id=self.appended(len(chapters) + 1 + bool(chapters))) if keys else ""

    def page(self, body: str) -> str:
        m = self.doc["meta"]
        head = el("head", el("meta", "", charset="UTF-8") + el("title", esc(plain(m["title"]))))
        start = "<!DOCTYPE html>\n" if self.version == 5 else '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">\n'
        return start + el("html", head + el("body", body), xmlns="http://www.w3.org/1999/xhtml")

    def title(self) -> str:
        m = self.doc["meta"]
        return self.new("header", "".join(el(t, self.inlines(x)) for t, x in (("h1", m["title"]), ("h2", m["subtitle"]), *(("p", a) for a in m["authors"]), ("p", m["date"])) if x))

    def whole(self) -> str:
        root = sections(self.doc["blocks"])
        toc = self.new("nav", self.contents(root["parts"])) if root["parts"] else ""
        return self.page(self.title() + toc + self.new("main", self.blocks(root["blocks"]) + "".join(map(self.section, root["parts"]))) + self.notes() + self.references())


def to_html(doc: dict, works=None, version: int = 5) -> str:
    return Html(doc, works, version).whole()


def split(doc: dict, level: int) -> list[tuple[str, list[dict], bool]]:
    """File names with their sections: below the level a section and its parts are one file, above it each has its own."""
    out = []

    def walk(parts: list[dict]) -> None:
        for p in parts:
            deep = p["level"] >= level
            out.append((f"section-{len(out) + 1:03d}.xhtml", p, deep))
            if not deep:
                walk(p["parts"])

    walk(sections(doc["blocks"])["parts"])
    return out


def anchors(s: dict, deep: bool) -> list[str]:
    found: list[str] = []

    def walk(x) -> None:
        if isinstance(x, dict):
            if "anchor" in x:
                found.append(anchor_id(x["anchor"]))
            for v in x.values():
                if isinstance(v, (dict, list)):
                    walk(v)
        elif isinstance(x, list):
            for v in x:
                if not (isinstance(v, dict) and v.get("kind") in ("str", "space")):
                    walk(v)

    walk([s["header"], s["blocks"], s["parts"] if deep else []])
    return found


def extra_pages(doc: dict, h: Html) -> list[tuple[str, str, str]]:
    """File, title and body of the pages after the text: notes, then the bibliography, if there are any."""
    both = (("notes.xhtml", "Notes", h.notes()), ("bibliography.xhtml", "Bibliography", h.references()))
    return [x for x in both if x[2]]


def page_files(doc: dict, level: int) -> dict[str, str]:
    """Anchors to the file that holds them, notes' texts and works included."""
    files: dict[str, str] = {}
    for name, s, deep in reversed(split(doc, level)):
        files.update(dict.fromkeys(anchors(s, deep), name))
    works = {f"bib-{n}": "bibliography.xhtml" for n in doc["cites"].values()}
    return files | {f"notetext-{n['chapter']}-{n['n']}": "notes.xhtml" for n in doc["notes"]} | works


def to_pages(doc: dict, works=None, level: int = 2, version: int = 5, files: dict[str, str] | None = None) -> dict[str, str]:
    """Multi-file HTML: name to page; the index holds the title, the contents and what stands before the first header, notes and bibliography come last.

    Every page of HTML 5 begins with the document's header. files: page_files() of the level, where it is known.
    """
    h, root = Html(doc, works, version, page_files(doc, level) if files is None else files, linked=True), sections(doc["blocks"])
    extra, title = extra_pages(doc, h), h.title()

    def chapters() -> str:
        return el("ul", "".join(el("li", el("a", f"Chapter {c}", href=f"notes.xhtml#{h.appended(i)}")) for i, c in enumerate(h.chapters(), 2)))

    def page(body: str) -> str:
        return h.page((title if version == 5 else "") + h.new("main", body))

    ends = "".join(el("li", el("a", name, href=file) + (chapters() if file == "notes.xhtml" else "")) for file, name, _ in extra)
    contents = h.contents(root["parts"])
    contents = contents.removesuffix("</ul>") + ends + "</ul>" if contents.endswith("</ul>") else el("ul", ends) if ends else contents
    out = {"index.xhtml": h.page(title + h.new("nav", contents) + h.new("main", h.blocks(root["blocks"])))}
    return out | {name: page(h.section(s, deep)) for name, s, deep in split(doc, level)} | {name: page(body) for name, _, body in extra}


def to_tei(doc: dict, works=None) -> str:
    works = works or {}

    def inlines(xs):
        out = ""
        for x in xs:
            k = x["kind"]
            if k in ("str", "space"):
                out += esc(x.get("text", " "))
            elif k == "style":
                out += el("emph" if x["style"] == "emph" else "hi", inlines(x["body"]), rend=None if x["style"] == "emph" else x["style"])
            elif k == "math":
                out += el("formula", inlines(x["body"]))
            elif k == "link":
                out += el("ref", inlines(x["body"]), target=x["target"])
            elif k == "pointer":
                a = doc["labels"].get(x["label"])
                out += el("ref", esc(anchor_number(a)) if a else "???", target=f"#{anchor_id(a)}" if a else "")
            elif k == "note":
                out += el("note", blocks(x["body"]), n=str(x["anchor"]["n"]))
            elif k == "cite":
                out += esc(cited(x, works))
        return out

    def table(rows, head=""):
        return el("table", head + "".join(el("row", "".join(el("cell", inlines(c["body"]), cols=str(c["span"]) if c["span"] > 1 else None) for c in r)) for r in rows))

    def blocks(bs):
        out = ""
        for b in bs:
            k = b["kind"]
            if k == "para":
                out += el("p", inlines(b["body"]))
            elif k in ("itemize", "enumerate"):
                out += el("list", "".join(el("item", blocks(i)) for i in b["items"]), rend="bulleted" if k == "itemize" else "numbered")
            elif k == "quotation":
                out += el("quote", blocks(b["blocks"]))
            elif k == "figure":
                out += el("figure", el("head", inlines(b["caption"])) + el("graphic", "", url=b["image"]), xml_id=anchor_id(b["anchor"]))
            elif k == "table":
                out += table(b["rows"], el("head", inlines(b["caption"])))
            elif k in ("simpletable", "gloss"):
                out += table(b["rows"])
            elif k == "examples":
                out += el("list", "".join(el("item", blocks(i["body"]), n=anchor_number(i["anchor"])) for i in b["items"]), rend="examples")
        return out

    def section(s):
        return el("div", el("head", inlines(s["header"]["body"])) + blocks(s["blocks"]) + "".join(map(section, s["parts"])), type=DIVISIONS.get(s["level"], "unknown"))

    m, root = doc["meta"], sections(doc["blocks"])
    regions: dict[str, list] = {"front": [], "body": [], "back": []}
    at = 0
    for s in root["parts"]:  # front while it lasts, then the main run, then the rest
        r = {"front": 0, "main": 1}.get(s["header"]["anchor"]["region"], 2)
        at = max(at, r)
        regions[("front", "body", "back")[at]].append(s)
    head = el("teiHeader", el("fileDesc", el("titleStmt", el("title", inlines(m["title"])) + "".join(el("author", inlines(a)) for a in m["authors"]))))
    text = "".join(el(r, ("" if r != "body" else blocks(root["blocks"])) + "".join(map(section, ss))) for r, ss in regions.items() if ss or r == "body")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + el("TEI", head + el("text", text), xmlns="http://www.tei-c.org/ns/1.0")


#: Media types of images by the endings of their names.
IMAGES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml"}


def epub_files(doc: dict, works=None, uuid: str = "00000000-0000-4000-8000-000000000000", date: str = "", media: tuple[str, ...] = (), cover: str | None = None) -> dict[str, str]:
    """Text files of an EPUB in archive order; identifier and date are given, so the result is a function of its input. media: names of image files."""
    files = page_files(doc, 3)
    pages = to_pages(doc, works, level=3, version=1, files=files)
    title = esc(plain(doc["meta"]["title"]))

    def item(name: str, file: str, kind: str) -> str:
        return f'<item id="{name}" href="{esc(file)}" media-type="{kind}"/>'

    manifest = item("ncx", "toc.ncx", "application/x-dtbncx+xml") + "".join(item(n.removesuffix(".xhtml"), n, "application/xhtml+xml") for n in pages)
    manifest += "".join(item("cover-image" if n == cover else f"image-{i}", n, IMAGES.get(n.rsplit(".", 1)[-1].lower(), "application/octet-stream")) for i, n in enumerate(media))
    spine = "".join(f'<itemref idref="{n.removesuffix(".xhtml")}"/>' for n in pages)
    about = el("dc:title", title) + el("dc:identifier", f"urn:uuid:{uuid}", id="id") + el("dc:language", "en") + el("dc:date", esc(date))
    about += '<meta name="cover" content="cover-image"/>' if cover else ""
    # fixed values: the package and contents formats' namespaces and attributes
    opf = f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{about}</metadata><manifest>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>'
    order = iter(range(1, 1 << 30))

    def point(label: str, target: str, inner: str = "") -> str:
        i = next(order)
        return el("navPoint", el("navLabel", el("text", label)) + f'<content src="{target}"/>' + inner, id=f"nav-{i}", playOrder=str(i))

    def points(parts) -> str:
        out = ""
        for p in parts:
            i, name = next(order), anchor_id(p["header"]["anchor"])
            inner = el("navLabel", el("text", esc(plain(p["header"]["body"])))) + f'<content src="{files.get(name, "index.xhtml")}#{name}"/>' + points(p["parts"])
            out += el("navPoint", inner, id=f"nav-{i}", playOrder=str(i))
        return out

    def depth(parts):
        return max((1 + depth(p["parts"]) for p in parts), default=0)

    tree = sections(doc["blocks"])["parts"]
    points_ = points(tree) + "".join(point(t, n) for n, t in (("notes.xhtml", "Notes"), ("bibliography.xhtml", "Bibliography")) if n in pages)
    ncx = f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:{uuid}"/><meta name="dtb:depth" content="{max(1, depth(tree))}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points_}</navMap></ncx>'
    return {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/content.opf": opf, "OEBPS/toc.ncx": ncx} | {f"OEBPS/{n}": p for n, p in pages.items()}


def to_epub(doc: dict, works=None, uuid: str = "00000000-0000-4000-8000-000000000000", date: str = "", media: dict[str, bytes] | None = None, cover: tuple[str, bytes] | None = None) -> bytes:
    """The archive; the type comes first and uncompressed, and all times are the same. cover: name and content of its image."""
    images = dict(media or {}) | (dict([cover]) if cover else {})
    texts = epub_files(doc, works, uuid, date, tuple(images), cover[0] if cover else None)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in {**texts, **{f"OEBPS/{n}": b for n, b in images.items()}}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()
