"""BibTeX files to entries, and names and lists with braces."""

from __future__ import annotations

import re

from .document import plain, read_inlines
from .lexer import WHOLE, TeXError
from .parser import PERHAPS

#: The month macros, and how fields are read.
MONTHS = {m: str(i + 1) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
AGENTS = frozenset(("author", "editor", "bookauthor", "translator"))
LISTS = frozenset("institution language location organization origlocation origpublisher publisher school address".split())
RAW = frozenset(("crossref", "xdata"))
_KEY = re.compile(r"[\w@.:;!?+\-*/\[\]']+")
_BLANKS, _BRACE, _QUOTE, _BARE = re.compile(r"\s*"), re.compile(r"[\\{}]"), re.compile(r'[\\{}"]'), re.compile(r"[^#,})]*")
_AND = {"and": re.compile(r"(?:(?<=\s)|^)and(?=\s|\Z)")}


class BibParser:
    def __init__(self, text: str):
        self.text, self.at, self.macros = text, 0, dict(MONTHS)

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise TeXError(f"line {line}: {what} expected")

    def blanks(self) -> None:
        self.at = _BLANKS.match(self.text, self.at).end()

    def expect(self, chars: str) -> str:
        self.blanks()
        if self.at >= len(self.text) or self.text[self.at] not in chars:
            self.fail(" or ".join(chars))
        self.at += 1
        return self.text[self.at - 1]

    def word(self, what: str) -> str:
        self.blanks()
        m = _KEY.match(self.text, self.at)
        if not m:
            self.fail(what)
        self.at = m.end()
        return m[0]

    def braced(self) -> str:
        depth, start = 1, self.at
        while m := _BRACE.search(self.text, self.at):
            c, self.at = m[0], m.end()
            if c == "\\":
                self.at += 1
            else:
                depth += 1 if c == "{" else -1
                if not depth:
                    return self.text[start : self.at - 1]
        self.at = len(self.text)
        self.fail("}")

    def quoted(self) -> str:
        depth, start = 0, self.at
        while m := _QUOTE.search(self.text, self.at):
            c, self.at = m[0], m.end()
            if c == "\\":
                self.at += 1
            elif c in "{}":
                depth += 1 if c == "{" else -1
            elif depth <= 0:
                return self.text[start : self.at - 1]
        self.at = len(self.text)
        self.fail('"')

    def value(self) -> str:
        out = ""
        while True:
            self.blanks()
            c = self.text[self.at : self.at + 1]
            if c == "{":
                self.at += 1
                out += self.braced()
            elif c == '"':
                self.at += 1
                out += self.quoted()
            else:
                m = _BARE.match(self.text, self.at)
                name, self.at = m[0].strip(), m.end()
                out += name if name[:1].isdigit() else self.macros.get(name.lower(), "")
            self.blanks()
            if self.text[self.at : self.at + 1] != "#":
                return out
            self.at += 1

    def fields(self) -> list[tuple[str, str]]:
        out = []
        while True:
            self.blanks()
            c = self.text[self.at : self.at + 1]
            if c in ("}", ")"):
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            if not c:
                self.fail("}")
            name = re.sub(r"^\d+", "", self.word("field name").lower())
            self.expect("=")
            out.append((name, self.value()))

    def entries(self) -> list[dict]:
        """Entries in order: kind (reference, string, preamble, comment), type, key, fields."""
        out = []
        while (at := self.text.find("@", self.at)) >= 0:
            self.at = at + 1
            kind = self.word("entry type").lower()
            self.expect("{(")
            if kind == "comment":
                out.append({"kind": "comment", "type": kind, "key": "", "fields": [("text", self.braced())]})
            elif kind == "preamble":
                out.append({"kind": "preamble", "type": kind, "key": "", "fields": [("text", self.value())]})
                self.expect("})")
            elif kind == "string":
                fields = self.fields()
                self.macros |= {k.lower(): v for k, v in fields}
                out.append({"kind": "string", "type": kind, "key": "", "fields": fields})
            else:
                key = self.word("citation key")
                out.append({"kind": "reference", "type": kind, "key": key, "fields": self.fields()})
        return out


def split_words(text: str, word: str = "and") -> list[str]:
    """Cut at the word, outside braces and between blanks; empty parts drop out."""
    if word in _AND and not _BRACE.search(text):
        return [p for x in _AND[word].split(text) if (p := x.strip())]
    parts, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        depth += (c == "{") - (c == "}")
        n = i + len(word)
        if depth == 0 and text[i:n] == word and (i == 0 or text[i - 1].isspace()) and (n == len(text) or text[n].isspace()):
            parts.append(text[start:i])
            start = i = n
            continue
        i += 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _cut(text: str, at) -> list[str]:
    if not _BRACE.search(text):
        return text.split() if at is str.isspace else text.split(",")
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c == "{") - (c == "}")
        if depth == 0 and at(c):
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]


def agent(name: str) -> dict[str, str]:
    """first, prefix, last, suffix of one name in any of the three comma forms."""
    parts = [p.strip() for p in _cut(name, ",".__eq__)]
    words = [w for w in _cut(parts[0], str.isspace) if w]
    low = [w[:1].islower() for w in words]
    first, suffix = "", ""
    if len(parts) == 1:
        begin = low.index(True) if True in low else len(words) - 1
        first, words, low = " ".join(words[:begin]), words[begin:], low[begin:]
    elif len(parts) == 2:
        first = parts[1]
    else:
        suffix, first = parts[1], ", ".join(parts[2:])
    k = min(len(low) - low[::-1].index(True) if True in low else 0, max(0, len(words) - 1))
    return {"first": shown(first), "prefix": shown(" ".join(words[:k])), "last": shown(" ".join(words[k:])), "suffix": shown(suffix)}


def shown(text: str) -> str:
    return plain(read_inlines(text)) if any(c in text for c in "\\{}~$-`'") else text


def read(text: str) -> str:
    """The text of a snippet; one of plain words and single spaces is its own."""
    bare = text.strip(" ")
    return bare if WHOLE.fullmatch(bare) and not PERHAPS.search(bare) else plain(read_inlines(text))


def parse_bib(text: str) -> list[tuple[int, str, str, str, str, str]]:
    """seq, key, type, name, kind, value of every field; agents are joined by semicolons, lists by bars. First entry of a key wins, last value of a field."""
    entries = BibParser(text).entries()
    preamble = "".join(v for e in entries if e["kind"] == "preamble" for _, v in e["fields"])
    out, seen = [], set()
    for seq, e in enumerate(entries):
        if e["kind"] != "reference" or e["key"] in seen:
            continue
        seen.add(e["key"])
        for name, value in dict(e["fields"]).items():
            if name in RAW:
                kind, done = "raw", value
            elif name in AGENTS:
                kind, done = "agents", "; ".join(" ".join(a[k] for k in ("prefix", "last", "suffix", "first") if a[k]) for a in map(agent, split_words(value)))
            elif name in LISTS:
                kind, done = "list", "|".join(shown(v) for v in split_words(value))
            else:
                kind, done = "literal", read(preamble + value)
            out.append((seq, e["key"], e["type"], name, kind, done))
    return out
