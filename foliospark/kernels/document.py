"""Syntax trees to documents: metadata, blocks and inlines, with counters, labels and citations.

Plain dictionaries and lists, so that a document is also a JSON value. Titles and note bodies are read before they are numbered, figures,
tables and items are numbered where they start.
"""

from __future__ import annotations

from .lexer import TeXError, lex_runs
from .parser import SECTIONS, Node, expanded, literal, parse

#: Citation commands and their modes.
CITE_MODES = {"cite": "inline", "citealt": "inline", "citealp": "inline", "citet": "text", "textcite": "text", "citep": "parentheses", "parencite": "parentheses", "autocite": "parentheses", "citeauthor": "author", "citeyear": "year", "citeyearpar": "yearpar"}
GLOSSES = {"g" + "l" * n: n for n in range(2, 9)}
REGIONS = {"frontmatter": "front", "mainmatter": "main", "appendix": "back", "backmatter": "back"}


class Reader:
    """joined: text with single spaces in it is one inline; otherwise each word and each space is one."""

    def __init__(self, joined: bool = False):
        self.joined = joined
        self.region, self.section, self.phantom = "front", [0] * 7, 0
        self.chapter, self.count = 0, {"figure": 0, "table": 0, "note": 0, "item": 0}
        self.sub: list[list[int]] = []
        self.anchor = {"kind": "document"}
        self.labels: dict[str, dict] = {}
        self.cites: dict[str, int] = {}
        self.n_cites, self.media, self.notes = 0, [], {}
        self.meta: dict = {"title": [], "subtitle": [], "authors": [], "date": []}

    # ---- inlines

    def inlines(self, nodes: list[Node]) -> list[dict]:
        nodes = nodes if self.joined else expanded(nodes)
        merged: list[dict] = []
        last = ""  # the kind of the last one
        for i, n in enumerate(nodes):
            if n.kind == "white":
                if last != "space":
                    merged.append({"kind": "space"})
                    last = "space"
                continue
            if n.kind in ("plain", "words") and last != "str":
                merged.append({"kind": "str", "text": n.text})
                last = "str"
                continue
            rest = n.kind == "command" and n.text in ("em", "rm")
            for x in [{"kind": "style", "style": "emph" if n.text == "em" else "normal", "body": self.inlines(nodes[i + 1 :])}] if rest else self.inline(n):
                if x["kind"] == "str" and last == "str":
                    merged[-1] = {"kind": "str", "text": merged[-1]["text"] + x["text"]}
                elif not (x["kind"] == "space" and last == "space"):
                    merged.append(x)
                    last = x["kind"]
            if rest:
                break
        return merged

    def inline(self, n: Node) -> list[dict]:
        if n.kind in ("plain", "words"):
            return [{"kind": "str", "text": n.text}]
        if n.kind in ("white", "newline"):
            return [{"kind": "space"}]
        if n.kind == "group" and not n.text:
            return self.inlines(n.body)
        if n.kind == "math":
            return [{"kind": "math", "display": n.text == "display", "body": self.inlines(n.body)}]
        if n.kind in ("sup", "sub"):
            return [{"kind": "style", "style": n.kind, "body": self.inlines(n.body)}]
        if n.kind == "command":
            c = n.text
            if c == "emph":
                return [{"kind": "style", "style": "emph", "body": self.inlines(n.arg("m"))}]
            if c == "label":
                self.labels[literal(n.arg("m"))] = self.anchor
                return []
            if c == "ref":
                return [{"kind": "pointer", "label": literal(n.arg("m"))}]
            if c == "url":
                t = literal(n.arg("m"))
                return [{"kind": "link", "target": t, "body": [{"kind": "str", "text": t}]}]
            if c == "href":
                return [{"kind": "link", "target": literal(n.arg("m")), "body": self.inlines(n.arg("m", 1))}]
            if c == "footnote":
                body = self.blocks(n.arg("m"))
                self.count["note"] += 1
                a = {"kind": "note", "chapter": self.chapter, "n": self.count["note"]}
                self.notes[(self.chapter, self.count["note"])] = body
                return [{"kind": "note", "anchor": a, "body": body}]
            if c == "nocite":
                self.register(n)
                return []
            if c in CITE_MODES:
                keys = self.register(n)
                pre, post = (n.arg("o"), n.arg("o", 1)) if len([1 for k, _ in n.args if k == "o"]) > 1 else ([], n.arg("o"))
                return [{"kind": "cite", "mode": CITE_MODES[c], "pre": self.inlines(pre), "post": self.inlines(post), "keys": keys}]
        raise TeXError(f"unexpected {n.kind} {n.text!r} in running text")

    def register(self, n: Node) -> list[str]:
        keys = [k.strip() for k in literal(n.arg("m")).split(",") if k.strip()]
        fresh = {k: self.n_cites + i for i, k in enumerate(keys) if k not in self.cites}
        self.cites |= fresh
        self.n_cites += len(keys)
        return keys

    # ---- blocks

    def header(self, n: Node) -> dict:
        level = SECTIONS[n.text]
        title = trimmed(self.inlines(n.arg("m")))
        if n.starred or n.text.startswith("add"):
            self.phantom += 1
            a = {"kind": "section", "region": self.region, "phantom": self.phantom, "path": []}
        else:
            self.section[level - 1] += 1
            if level > 1:
                self.section[level:] = [0] * (7 - level)
            if level == 2:
                self.chapter, self.count = self.section[1], dict.fromkeys(self.count, 0)
            a = self.anchor = {"kind": "section", "region": self.region, "phantom": 0, "path": list(self.section)}
        return {"kind": "header", "level": level, "anchor": a, "body": title}

    def numbered(self, kind: str) -> dict:
        self.count[kind] += 1
        self.anchor = {"kind": kind, "chapter": self.chapter, "n": self.count[kind]}
        return self.anchor

    def float(self, n: Node) -> dict:
        a, caption, image, table = self.numbered(n.text), [], "", []

        def walk(nodes: list[Node]) -> None:
            nonlocal caption, image, table
            for x in nodes:
                if x.kind == "command" and x.text == "caption":
                    caption = trimmed(self.inlines(x.arg("m")))
                elif x.kind == "command" and x.text == "includegraphics":
                    image = literal(x.arg("m"))
                    self.media.append(image)
                elif x.kind == "command" and x.text == "label":
                    self.inline(x)
                elif x.kind == "group" and x.text == "tabular":
                    table = self.tabular(x)
                elif x.kind == "group":
                    walk(x.body)

        walk(n.body)
        return {"kind": n.text, "anchor": a, "caption": caption, "image": image, "rows": table}

    def tabular(self, n: Node) -> list:
        out, row, cell = [], [], []

        def close() -> None:
            nonlocal cell
            span = next((x for x in cell if x.kind == "command" and x.text == "multicolumn"), None)
            if span is not None:
                digits = literal(span.arg("m")).strip()
                row.append({"span": int(digits) if digits.isdigit() else 1, "body": trimmed(self.inlines(span.arg("m", 2)))})
            else:
                row.append({"span": 1, "body": trimmed(self.inlines(cell))})
            cell = []

        for x in n.body:
            if x.kind == "command" and x.text == "hline" or x.kind == "par":
                continue
            if x.kind == "align":
                close()
            elif x.kind == "newline":
                close()
                out.append(row)
                row = []
            else:
                cell.append(x)
        return out

    def items(self, n: Node, mark: str) -> list[list[Node]]:
        parts: list[list[Node]] = []
        for x in n.body:
            if x.kind == "command" and x.text == mark:
                parts.append([])
            elif parts:
                parts[-1].append(x)
        return parts

    def examples(self, n: Node) -> dict:
        nested = n.text == "xlist"
        if nested:
            self.items_stack_push()
        out = []
        for part in self.items(n, "ex"):
            path = self.next_item()
            self.anchor = {"kind": "item", "chapter": self.chapter, "path": path}
            out.append({"anchor": self.anchor, "body": self.blocks(part)})
        if nested:
            self.sub.pop()
        return {"kind": "examples", "items": out}

    def items_stack_push(self) -> None:
        self.sub.append([0])

    def next_item(self) -> list[int]:
        if self.sub:
            self.sub[-1][0] += 1
        else:
            self.count["item"] += 1
        return [self.count["item"], *(x[0] for x in self.sub)]

    def gloss(self, nodes: list[Node], lines: int) -> tuple[dict, int]:
        """An interlinear gloss: so many aligned lines of words, then perhaps a translation; and how many nodes it took."""
        rows, words, word, i = [], [], [], 0
        while i < len(nodes) and len(rows) < lines:
            x = nodes[i]
            i += 1
            if x.kind in ("white", "newline", "par"):
                if word:
                    words.append(trimmed(self.inlines(word)))
                    word = []
                if x.kind == "newline":
                    rows.append(words)
                    words = []
            else:
                word.append(x)
        while i < len(nodes) and nodes[i].kind in ("white", "par"):
            i += 1
        table = [[{"span": 1, "body": w} for w in r] for r in rows]
        if i < len(nodes) and nodes[i].kind == "command" and nodes[i].text in ("glt", "trans"):
            table.append([{"span": max((len(r) for r in rows), default=1), "body": trimmed(self.inlines([x for x in nodes[i + 1 :] if x.kind != "par"]))}])
            i = len(nodes)
        return {"kind": "gloss", "rows": table}, i

    def blocks(self, nodes: list[Node]) -> list[dict]:
        out: list[dict] = []
        run: list[Node] = []

        def flush() -> None:
            body = trimmed(self.inlines(run))
            run.clear()
            if body:
                out.append({"kind": "para", "body": body})

        i = 0
        while i < len(nodes):
            n = nodes[i]
            i += 1
            if n.kind in ("words", "white", "plain"):
                run.append(n)
                continue
            c = n.text
            if n.kind == "par":
                flush()
            elif n.kind == "command" and c in SECTIONS:
                flush()
                out.append(self.header(n))
            elif n.kind == "command" and c in REGIONS:
                flush()
                if REGIONS[c] != self.region:
                    self.region, self.section = REGIONS[c], [0] * 7
            elif n.kind == "command" and c in GLOSSES:
                flush()
                nodes = [*nodes[:i], *expanded(nodes[i:])]
                g, took = self.gloss(nodes[i:], GLOSSES[c])
                out.append(g)
                i += took
            elif n.kind == "command" and c in ("centering", "maketitle", "tableofcontents", "bibliography"):
                continue
            elif n.kind == "group" and c:
                flush()
                if c in ("itemize", "enumerate"):
                    out.append({"kind": c, "items": [self.blocks(p) for p in self.items(n, "item")]})
                elif c == "quotation":
                    out.append({"kind": "quotation", "blocks": self.blocks(n.body)})
                elif c in ("figure", "table"):
                    out.append(self.float(n))
                elif c == "tabular":
                    out.append({"kind": "simpletable", "rows": self.tabular(n)})
                elif c in ("exe", "xlist"):
                    out.append(self.examples(n))
                elif c == "center":
                    out += self.blocks(n.body)
                else:
                    raise TeXError(f"environment {c} has no meaning")
            else:
                run.append(n)
        flush()
        return out

    def document(self, nodes: list[Node]) -> dict:
        body: list[Node] | None = None
        for n in nodes:
            if n.kind == "group" and n.text == "document":
                body = n.body
                break
            if n.kind == "command" and n.text in ("title", "subtitle", "date"):
                self.meta[n.text] = trimmed(self.inlines(n.arg("m")))
            elif n.kind == "command" and n.text == "author":
                self.meta["authors"] = [trimmed(self.inlines(n.arg("m")))]
            elif n.kind in ("white", "par") or n.kind == "command" and n.text in ("documentclass", "usepackage"):
                continue
            else:
                n = expanded([n])[0]
                raise TeXError(f"unexpected {n.kind} {n.text!r} before the document")
        if body is None:
            raise TeXError("no document")
        blocks = self.blocks(body)
        return {"meta": self.meta, "blocks": blocks, "labels": self.labels, "cites": self.cites, "media": self.media, "phantoms": self.phantom, "notes": [{"chapter": c, "n": n, "body": b} for (c, n), b in sorted(self.notes.items())]}


def trimmed(xs: list[dict]) -> list[dict]:
    i, j = 0, len(xs)
    while i < j and xs[i]["kind"] == "space":
        i += 1
    while j > i and xs[j - 1]["kind"] == "space":
        j -= 1
    return xs[i:j]


def plain(xs: list[dict]) -> str:
    out = ""
    for x in xs:
        k = x["kind"]
        out += x["text"] if k == "str" else " " if k == "space" else ",".join(x["keys"]) if k == "cite" else f"<{x['label']}>" if k == "pointer" else "" if k == "note" else plain(x["body"])
    return out


def read_document(text: str, resolver=None, now=None, joined: bool = False) -> dict:
    return Reader(joined).document(parse(lex_runs(text, resolver, now)))


def read_inlines(text: str) -> list[dict]:
    """A snippet, such as a bibliography field, as inlines."""
    return trimmed(Reader().inlines([n for n in parse(lex_runs(text)) if n.kind != "par"]))


def anchor_id(a: dict) -> str:
    k = a["kind"]
    if k == "document":
        return "start"
    if k == "section":
        where = {"front": "front-", "back": "back-"}.get(a["region"], "")
        if a["phantom"]:
            return f"sec-{where}unnumbered-{a['phantom']}"
        path = list(a["path"][1:])
        while path and not path[-1]:
            path.pop()
        return f"sec-{where}" + "-".join(map(str, path))
    if k == "item":
        return "item-" + "-".join(map(str, [a["chapter"], *a["path"]]))
    if k == "bib":
        return f"bib-{a['n']}"
    return f"{k}-{a['chapter']}-{a['n']}"


def anchor_number(a: dict) -> str:
    k = a["kind"]
    if k == "section":
        path = list(a["path"][1:] if any(a["path"][1:]) else a["path"][:1])
        while path and not path[-1]:
            path.pop()
        return ".".join(map(str, path))
    if k == "item":
        return str(a["path"][-1])
    return "start" if k == "document" else f"{a['chapter']}.{a['n']}"
