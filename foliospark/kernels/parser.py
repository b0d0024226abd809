"""Tokens to a syntax tree, and its rewriting to plain Unicode text.

A tree is encoded by preorder rows: node_id in document order, last_id the last node below, so that a subtree is a range.
"""

from __future__ import annotations

import re
import unicodedata

from .lexer import ALIGN, BEGIN, END, LETTER, MATH, OTHER, SPACE, SPACE_TOKEN, SUB, SUP, TeXError, Token

#: Argument specifications of commands (s star, o optional, m mandatory).
CITES = ("cite", "citet", "citep", "citealt", "citealp", "citeauthor", "citeyear", "citeyearpar", "nocite", "textcite", "parencite", "autocite")
SECTIONS = {"part": 1, "chapter": 2, "section": 3, "subsection": 4, "subsubsection": 5, "paragraph": 6, "subparagraph": 7, "addpart": 1, "addchap": 2, "addsec": 3}
SPECS = {
    **{c: "soom" for c in CITES},
    **{c: "som" for c in SECTIONS},
    **{c: "m" for c in "emph textit textbf textrm textsc texttt footnote label ref url title subtitle date author centering caption".split() if c != "centering"},
    "href": "mm", "includegraphics": "om", "caption": "om", "multicolumn": "mmm", "documentclass": "om", "usepackage": "om", "item": "o", "discretionary": "mmm", "bibliography": "m",
    **{c: "" for c in "centering em rm it hline frontmatter mainmatter appendix backmatter par ex trans glt maketitle tableofcontents".split()},
}
ENVIRONMENTS = {"figure": "o", "table": "o", "tabular": "om", "document": "", "quotation": "", "center": "", "itemize": "", "enumerate": "", "exe": "", "xlist": ""}
#: Accents and their combining marks.
ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c",
    "H": "\u030b", "r": "\u030a", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331", "hat": "\u0302", "tilde": "\u0303", "bar": "\u0304",
    "dot": "\u0307", "ddot": "\u0308", "vec": "\u20d7", "acute": "\u0301", "grave": "\u0300", "check": "\u030c", "breve": "\u0306",
    "mathring": "\u030a",
}
#: The accent that ties two characters.
TIES = {"t": "\u0361"}
#: Symbols of text and mathematics and their characters.
SYMBOLS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ",
    "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "ng": "ŋ", "NG": "Ŋ", "dag": "†", "ddag": "‡", "S": "§", "P": "¶", "copyright": "©", "pounds": "£",
    "textbackslash": "\\", "textbar": "|", "textless": "<", "textgreater": ">", "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…",
    "textquoteleft": "‘", "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "-": "\u00ad", "times": "×", "div": "÷",
    "pm": "±", "mp": "∓", "cdot": "⋅", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "∙", "cap": "∩", "cup": "∪", "vee": "∨", "wedge": "∧",
    "setminus": "∖", "oplus": "⊕", "otimes": "⊗", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "equiv": "≡", "approx": "≈",
    "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "in": "∈", "ni": "∋",
    "notin": "∉", "vdash": "⊢", "dashv": "⊣", "models": "⊨", "perp": "⊥", "parallel": "∥", "mid": "∣", "ll": "≪", "gg": "≫", "leftarrow": "←",
    "rightarrow": "→", "to": "→", "gets": "←", "leftrightarrow": "↔", "Leftarrow": "⇐", "Rightarrow": "⇒", "Leftrightarrow": "⇔", "uparrow": "↑",
    "downarrow": "↓", "mapsto": "↦", "infty": "∞", "forall": "∀", "exists": "∃", "neg": "¬", "lnot": "¬", "emptyset": "∅", "nabla": "∇",
    "partial": "∂", "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "surd": "√", "top": "⊤", "bot": "⊥", "angle": "∠", "prime": "′", "aleph": "ℵ",
    "ell": "ℓ", "wp": "℘", "Re": "ℜ", "Im": "ℑ", "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "prec": "≺",
    "succ": "≻", "preceq": "⪯", "succeq": "⪰", "asymp": "≍", "doteq": "≐", "bowtie": "⋈", "smile": "⌣", "frown": "⌢", "amalg": "⨿", "uplus": "⊎",
    "wr": "≀", "dagger": "†", "ddagger": "‡", "diamond": "⋄", "owns": "∋", "land": "∧", "lor": "∨", "triangleleft": "◃", "triangleright": "▹",
    "bigtriangleup": "△", "bigtriangledown": "▽", "triangle": "△", "bigcirc": "◯", "hbar": "ℏ", "imath": "ı", "jmath": "ȷ", "flat": "♭",
    "natural": "♮", "sharp": "♯", "clubsuit": "♣", "diamondsuit": "♢", "heartsuit": "♡", "spadesuit": "♠", "vdots": "⋮", "cdots": "⋯", "ddots": "⋱",
    "backslash": "\\", "vert": "|", "Vert": "‖", "lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "coprod": "∐", "nearrow": "↗",
    "searrow": "↘", "swarrow": "↙", "nwarrow": "↖", "hookleftarrow": "↩", "hookrightarrow": "↪", "iff": "⟺", "longmapsto": "⟼",
    "rightleftharpoons": "⇌", "longleftarrow": "⟵", "Longleftarrow": "⟸", "leftharpoonup": "↼", "leftharpoondown": "↽", "longrightarrow": "⟶",
    "Longrightarrow": "⟹", "rightharpoonup": "⇀", "rightharpoondown": "⇁", "longleftrightarrow": "⟷", "Longleftrightarrow": "⟺", "Uparrow": "⇑",
    "Downarrow": "⇓", "updownarrow": "↕", "Updownarrow": "⇕", "bigoplus": "⨁", "ominus": "⊖", "bigotimes": "⨂", "oslash": "⊘", "odot": "⊙",
    "bigodot": "⨀", "bigcap": "⋂", "bigcup": "⋃", "bigvee": "⋁", "bigwedge": "⋀", "sqcap": "⊓", "sqcup": "⊔", "sqsubset": "⊏", "sqsupset": "⊐",
    "sqsubseteq": "⊑", "sqsupseteq": "⊒", "varepsilon": "ϵ", "vartheta": "ϑ", "varphi": "ϕ", "varrho": "ϱ", "varpi": "ϖ", "varsigma": "ς",
    "lambda": "λ", "Lambda": "Λ", "alpha": "α", "Alpha": "Α", "beta": "β", "Beta": "Β", "gamma": "γ", "Gamma": "Γ", "delta": "δ", "Delta": "Δ",
    "epsilon": "ε", "Epsilon": "Ε", "zeta": "ζ", "Zeta": "Ζ", "eta": "η", "Eta": "Η", "theta": "θ", "Theta": "Θ", "iota": "ι", "Iota": "Ι",
    "kappa": "κ", "Kappa": "Κ", "mu": "μ", "Mu": "Μ", "nu": "ν", "Nu": "Ν", "xi": "ξ", "Xi": "Ξ", "omicron": "ο", "Omicron": "Ο", "pi": "π",
    "Pi": "Π", "rho": "ρ", "Rho": "Ρ", "sigma": "σ", "Sigma": "Σ", "tau": "τ", "Tau": "Τ", "upsilon": "υ", "Upsilon": "Υ", "phi": "φ", "Phi": "Φ",
    "chi": "χ", "Chi": "Χ", "psi": "ψ", "Psi": "Ψ", "omega": "ω", "Omega": "Ω", "Orb": "○", "TeX": "TeX", "biguplus": "⊎", "intop": "∫",
    "ointop": "∮", "bigsqcup": "⊔", "smallint": "∫", "ldotp": ".", "cdotp": "⋅", "colon": ":", "lgroup": "(", "rgroup": ")", "lmoustache": "⎰",
    "rmoustache": "⎱", "arrowvert": "|", "Arrowvert": "∥", "bracevert": "|", "sqrt": "√", "not": "\u0338",
}
FUNCTIONS = frozenset("arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lim liminf limsup ln log max min Pr sec sin sinh sup tan tanh".split())
LITERALS = frozenset("{}$&#%_ ")
MARKED = LITERALS - {" "}
LIGATURES = {"?`": "¿", "!`": "¡", "---": "—", "--": "–", "``": "“", "''": "”", "`": "‘", "'": "’"}
#: Text that a ligature may begin in.
PERHAPS = re.compile("[`']|--")
_LIGATURE = re.compile("|".join(map(re.escape, sorted(LIGATURES, key=lambda x: (-len(x), x)))))


class Node:
    """kind: plain, words, command, group, math, sup, sub, align, white, newline, par; words stand for plain nodes with white between (see expanded()).

    args: (kind, nodes) of commands and environments, kind star, o or m.
    """

    __slots__ = ("args", "body", "kind", "text")

    def __init__(self, kind: str, text: str = "", args=(), body=()):
        self.kind, self.text, self.args, self.body = kind, text, args, body

    def arg(self, kind: str, n: int = 0) -> list[Node]:
        found = [x for k, x in self.args if k == kind]
        return found[n] if n < len(found) else []

    @property
    def starred(self) -> bool:
        return any(k == "star" for k, _ in self.args)


_BRACKET, _BRACKETED = re.compile(r"[\[\]]"), re.compile(r"\[([^\[\] ]+)\]")
#: All white nodes are one, as nothing ever changes them.
WHITE = Node("white")


class Parser:
    """Reads tokens of lex() or of lex_runs(); where one character is wanted, it is cut off a run."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def spread(self) -> Token:
        """The next token; words become their runs and spaces first."""
        t = self.tokens[self.at]
        if t.kind == "words":
            self.tokens[self.at : self.at + 1] = [x for w in t.text.split(" ") for x in (Token("char", w, LETTER), SPACE_TOKEN)][:-1]
        return self.tokens[self.at]

    def peek(self) -> Token | None:
        return self.spread() if self.at < len(self.tokens) else None

    def next_is(self, mark: str) -> bool:
        """Whether that character comes next."""
        return self.at < len(self.tokens) and (t := self.tokens[self.at]).kind in ("char", "words") and t.text[0] == mark

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise TeXError("end of text in an argument or group")
        t = self.spread()
        self.at += 1
        return t

    def take_one(self, n: int = 1) -> Token:
        """The next token, or the first n characters of a run, whose rest stays."""
        t = self.take()
        if t.kind == "char" and len(t.text) > n:
            self.at -= 1
            self.tokens[self.at] = t._replace(text=t.text[n:])
            return t._replace(text=t.text[:n])
        return t

    def white(self) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at].cat == SPACE:
            self.at += 1

    def nodes(self, stop=lambda t: False) -> list[Node]:
        """Nodes up to a token that stops; letters, other characters and spaces never do."""
        out: list[Node] = []
        tokens, at = self.tokens, self.at
        while at < len(tokens):
            t = tokens[at]
            cat = t[2]
            if cat == SPACE:
                at += 1
                out.append(WHITE)
            elif t[0] == "words" and (at + 1 == len(tokens) or tokens[at + 1][2] not in (LETTER, OTHER)):
                at += 1
                out.append(_worded(t[1]))
            elif cat == LETTER or cat == OTHER:
                self.at = at
                out.append(self.node())
                at = self.at
            elif t[0] == "cs" and t[1] in MARKED and not t[3]:
                at += 1
                out.append(Node("plain", t[1]))
            else:
                self.at = at
                if stop(t):
                    break
                out.append(self.node())
                at = self.at
        self.at = at
        return out

    def node(self) -> Node:
        t = self.take()
        if t.kind == "cs":
            return self.command(t)
        if t.cat in (LETTER, OTHER):
            text, tokens = t.text, self.tokens
            while self.at < len(tokens) and tokens[self.at].cat in (LETTER, OTHER):
                text += self.spread().text
                self.at += 1
            return Node("plain", text)
        if t.cat == SPACE:
            return WHITE
        if t.cat == ALIGN:
            return Node("align")
        if t.cat == BEGIN:
            body = self.nodes(lambda x: x.cat == END)
            self.take()
            return Node("group", "", body=body)
        if t.cat == MATH:
            wide = (u := self.peek()) is not None and u.cat == MATH
            if wide:
                self.take()
            body = self.nodes(lambda x: x.cat == MATH)
            for _ in range(1 + wide):
                if self.take().cat != MATH:
                    raise TeXError("mathematics isn't closed")
            return Node("math", "display" if wide else "inline", body=body)
        if t.cat in (SUP, SUB):
            self.white()
            inner = self.node() if (u := self.peek()) is None or u.kind != "char" or u.cat == BEGIN else Node("plain", self.take_one().text)
            return Node("sup" if t.cat == SUP else "sub", body=inner.body if inner.kind == "group" and not inner.text else [inner])
        raise TeXError(f"unexpected {t.show()!r}")

    def bracketed(self) -> list[Node] | None:
        mark = self.at
        self.white()
        if not self.next_is("["):
            self.at = mark
            return None
        if found := _BRACKETED.fullmatch(self.tokens[self.at][1]):
            self.at += 1
            return [Node("plain", found[1])]
        self.take_one()
        out, depth = [], 0
        while True:
            t = self.peek()
            if t is None:
                raise TeXError("optional argument isn't closed")
            if t.kind == "char" and t.cat in (LETTER, OTHER):
                # a run up to and with its first bracket
                at = _BRACKET.search(t.text)
                t = self.take_one(1 if at and at.start() == 0 else at.start() if at else len(t.text))
                depth += (t.text == "[") - (t.text == "]")
                if depth < 0:
                    return out
                if out and out[-1].kind == "plain":
                    out[-1].text += t.text
                else:
                    out.append(Node("plain", t.text))
            else:
                out.append(self.node())

    def mandatory(self) -> list[Node]:
        tokens, at = self.tokens, self.at
        if at + 2 < len(tokens) and tokens[at][2] == BEGIN and tokens[at + 1][0] == "words" and tokens[at + 2][2] == END:
            self.at += 3
            return [_worded(tokens[at + 1][1])]
        self.white()
        t = self.peek()
        if t is not None and t.kind == "char" and t.cat in (LETTER, OTHER):
            return [Node("plain", self.take_one().text)]
        n = self.node()
        return n.body if n.kind == "group" and not n.text else [n]

    def star(self) -> bool:
        mark = self.at
        self.white()
        if self.next_is("*"):
            self.take_one()
            return True
        self.at = mark
        return False

    def arguments(self, spec: str | None) -> list:
        out = []
        if spec is None:  # unknown: a star, all brackets, all braces
            if self.star():
                out.append(("star", []))
            while (o := self.bracketed()) is not None:
                out.append(("o", o))
            while (t := self.peek()) is not None and t.cat == BEGIN:
                out.append(("m", self.mandatory()))
            return out
        for k in spec:
            if k == "s" and self.star():
                out.append(("star", []))
            elif k == "o" and (o := self.bracketed()) is not None:
                out.append(("o", o))
            elif k == "m":
                out.append(("m", self.mandatory()))
        return out

    def command(self, t: Token) -> Node:
        if t.active:
            if t.text == "~":
                return Node("plain", " ")
            raise TeXError(f"active character {t.text!r} has no meaning")
        if t.text == "par":
            return Node("par")
        if t.text in (" ", "\n", "\t"):
            return WHITE
        if t.text == "\\":
            self.star()
            self.bracketed()
            return Node("newline")
        if t.text in LITERALS:
            return Node("plain", t.text)
        if t.text == "/":
            return Node("plain", "‌")
        if t.text == "begin":
            name = literal(self.mandatory())
            args = self.arguments(ENVIRONMENTS.get(name, None if name not in ENVIRONMENTS else ""))
            body = self.nodes(lambda x: x.kind == "cs" and x.text == "end" and not x.active)
            self.take()
            if (found := literal(self.mandatory())) != name:
                raise TeXError(f"end of {found} where {name} is open")
            return Node("group", name, args, body)
        if t.text == "end":
            raise TeXError("end of an environment that isn't open")
        if t.text in ACCENTS or t.text in TIES:
            return Node("command", t.text, self.arguments("m"))
        if symbol(t.text) is not None:
            return Node("command", t.text)
        return Node("command", t.text, self.arguments(SPECS.get(t.text)))


def symbol(name: str) -> str | None:
    return SYMBOLS.get(name, name if name in FUNCTIONS else None)


def literal(nodes: list[Node]) -> str:
    """Text as it stands: groups opened, scripts and alignment by their characters."""
    out = ""
    for n in nodes:
        out += {"plain": n.text, "words": n.text, "white": " ", "align": "&", "sup": "^", "sub": "_"}.get(n.kind, "")
        out += literal(n.body)
    return out


def accent(nodes: list[Node], mark: str) -> list[Node]:
    """The mark after the first character and its own marks, wherever it is nested."""
    for n in nodes:
        if n.kind in ("plain", "words") and n.text:
            i = 1
            while i < len(n.text) and unicodedata.combining(n.text[i]):
                i += 1
            n.text = n.text[:i] + mark + n.text[i:]
            return nodes
        if n.body:
            accent(n.body, mark)
            return nodes
    return [Node("plain", " " + mark)]


def expanded(nodes) -> list[Node]:
    """Words as plain and white nodes."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "words":
            for w in n.text.split(" "):
                out += (Node("plain", w), WHITE)
            out.pop()
        else:
            out.append(n)
    return out


def _worded(text: str) -> Node:
    return Node("words" if " " in text else "plain", text)


def _joined(out: list[Node], x: Node) -> None:
    """Appends plain text or words; what meets without white between becomes one plain node."""
    if not out or out[-1].kind not in ("plain", "words"):
        out.append(x)
        return
    if out[-1].kind == "words":
        head, _, tail = out.pop().text.rpartition(" ")
        out += (_worded(head), WHITE, Node("plain", tail))
    if x.kind == "plain":
        out[-1].text += x.text
    else:
        head, _, tail = x.text.partition(" ")
        out[-1].text += head
        out += (WHITE, _worded(tail))


def rewritten(nodes: list[Node]) -> list[Node]:
    """Symbols, accents and ligatures resolved; white space in normal form at each level."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "white":
            if not (out and out[-1].kind in ("white", "par", "newline")):
                out.append(n)
            continue
        if n.kind in ("plain", "words"):
            if PERHAPS.search(n.text):
                n.text = _LIGATURE.sub(lambda m: LIGATURES[m[0]], n.text)
            _joined(out, n)
            continue
        n.body = rewritten(n.body)
        n.args = [(k, rewritten(a)) for k, a in n.args]
        if n.kind == "command" and n.text in ACCENTS:
            new = accent(n.arg("m"), ACCENTS[n.text])
        elif n.kind == "command" and n.text in TIES:
            new = accent(n.arg("m"), TIES[n.text])  # between the two characters that it ties
        elif n.kind == "command" and n.text == "discretionary":
            new = n.arg("m", 2)
        elif n.kind == "command" and (s := symbol(n.text)) is not None:
            new = [Node("plain", s)]
        else:
            new = [n]
        for x in new:
            if x.kind in ("plain", "words"):
                _joined(out, x)
            elif x.kind == "white" and out and out[-1].kind in ("white", "par", "newline"):
                continue
            elif x.kind == "par" and out and out[-1].kind == "par":
                continue
            else:
                if x.kind in ("par", "newline") and out and out[-1].kind == "white":
                    out.pop()
                out.append(x)
    return out


def parse(tokens: list[Token]) -> list[Node]:
    return rewritten(Parser(tokens).nodes())


def rows(nodes: list[Node], runs: bool = False, named: re.Pattern | None = None, whole: re.Pattern | None = None) -> list[tuple]:
    """Preorder rows: node_id, last_id, parent_id, depth, ord, kind, name, text (* of starred commands), arg_kind, arg_ord.

    runs: words stay one row, of the ids that their plain and white nodes would have. named: only nodes at the top, commands and environments of these
    names, and all below those that are also whole, have rows, with the ids that they have among all.
    """
    out: list[tuple] = []

    def walk(ns: list[Node], parent: int, depth: int, arg: str | None, place: int, me: int, every: bool) -> int:
        i, shown = 0, every or not depth
        for n in expanded(ns) if shown and not runs else ns:
            at, took = n.kind, 1
            if at == "plain" or at == "white":
                if shown:
                    out.append((me, me, parent, depth, i, at, "", n.text, arg, place))
            elif at == "words":
                took += 2 * n.text.count(" ")
                if shown:
                    out.append((me, me + took - 1, parent, depth, i, at, "", n.text, arg, place))
            else:
                here, after = len(out), me + 1
                mine = shown or at in ("command", "group") and named.fullmatch(n.text)
                if mine:
                    out.append(())
                below = every or at in ("command", "group") and whole.fullmatch(n.text) is not None
                for k, (kind, a) in enumerate(n.args):
                    after = walk(a, me, depth + 1, kind, k, after, below)
                after = walk(n.body, me, depth + 1, None, 0, after, below)
                if mine:
                    out[here] = (me, after - 1, parent, depth, i, at, n.text if at in ("command", "group", "math") else "", "*" if n.starred else "", arg, place)
                me, i = after, i + 1
                continue
            me, i = me + took, i + took
        return me

    walk(nodes, -1, 0, None, 0, 0, named is None)
    return out
