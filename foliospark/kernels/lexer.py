"""TeX text to tokens: category codes, groups, macros, conditionals. Sequential by nature, so one text is one unit of work."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import NamedTuple

ESCAPE, BEGIN, END, MATH, ALIGN, EOL, PARAM, SUP, SUB, IGNORED, SPACE, LETTER, OTHER, ACTIVE, COMMENT, INVALID = range(16)
#: The category codes that plain TeX starts with.
DEFAULTS = {"\\": ESCAPE, "{": BEGIN, "}": END, "$": MATH, "&": ALIGN, "\n": EOL, "#": PARAM, "^": SUP, "_": SUB, "\0": IGNORED, " ": SPACE, "\t": SPACE, "~": ACTIVE, "%": COMMENT, "\x7f": INVALID}
_NAME = re.compile("[A-Za-z]+")
_PLAIN = "[^" + re.escape("".join(DEFAULTS)) + "]+"
#: Runs of characters that stand for themselves while nothing has changed the categories, with single spaces between, escaped marks, and all others one by one.
_RUN = re.compile(f"{_PLAIN}(?: {_PLAIN})*" + r"|\\[%&$#_{}]|[\s\S]")
WHOLE, _BARE = re.compile(f"{_PLAIN}(?: {_PLAIN})*"), re.compile(_PLAIN)
#: Expansions without a character of the text or of an included file taken after which a text counts as looping.
FUEL = 100_000


class TeXError(ValueError):
    """A text that can't be read; corpus runs turn it into an error row."""


class Token(NamedTuple):
    kind: str  # char, cs, param; of lex_runs() also words, runs of letters and others with single spaces between
    text: str
    cat: int = -1
    active: bool = False
    level: int = 0

    def show(self) -> str:
        return ("#" * self.level + self.text) if self.kind == "param" else self.text if self.kind == "char" or self.active else "\\" + self.text


@dataclass
class Macro:
    args: list[tuple]  # (kind, ...) in xparse's letters
    body: list[Token]
    end: list[Token] | None = None  # of environments
    primitive: str | None = None
    char: Token | None = None
    undefined: bool = False  # named by \\let when nothing had that name


PAR, SPACE_TOKEN = Token("cs", "par"), Token("char", " ", SPACE)
OPEN, CLOSE = Token("char", "{", BEGIN), Token("char", "}", END)
#: Tokens of escaped marks, which mean themselves unless a text defines them.
MARKS = {"\\" + c: Token("cs", c) for c in "%&$#_{}"}
NO_VALUE, YES, NO = Token("cs", "NoValue"), Token("cs", "BooleanTrue"), Token("cs", "BooleanFalse")
PRIMITIVES = frozenset(
    "def let newcommand renewcommand providecommand DeclareRobustCommand NewDocumentCommand RenewDocumentCommand ProvideDocumentCommand DeclareDocumentCommand "
    "newenvironment renewenvironment NewDocumentEnvironment RenewDocumentEnvironment ProvideDocumentEnvironment DeclareDocumentEnvironment iftrue iffalse else fi "
    "IfBooleanTF IfNoValueTF char number catcode meaning begingroup endgroup bgroup egroup begin end input include year month day time ( ) [ ]".split()
)


class Scoped(dict):
    """Values in force; each open scope keeps what its own values have replaced."""

    def __init__(self, values: dict):
        super().__init__(values)
        self.scopes: list[dict] = []

    def __setitem__(self, key: str, value) -> None:
        if self.scopes:
            self.scopes[-1].setdefault(key, self.get(key))
        super().__setitem__(key, value)

    def close(self) -> bool:
        """Ends the innermost scope; whether it had values of its own."""
        replaced = self.scopes.pop()
        for key, value in replaced.items():
            if value is None:
                del self[key]
            else:
                super().__setitem__(key, value)
        return bool(replaced)

    def everywhere(self, key: str, value) -> None:
        for scope in self.scopes:
            scope.pop(key, None)
        super().__setitem__(key, value)


class Lexer:
    """resolver maps a file name to its text (None: includes are read as empty, dates as nothing); now is a datetime for date words.

    runs: neighbouring letters and other characters of the text, and single spaces between, are one token (of category LETTER) wherever they are read for
    themselves; the input then holds strings of several characters, which are cut into characters when anything else reads them.
    """

    def __init__(self, text: str, resolver: Callable[[str], str | None] | Mapping[str, str] | None = None, now=None, runs: bool = False):
        self.runs = runs
        self.input: list = _RUN.findall(text)[::-1] if runs else list(reversed(text))
        self.cats, self.macros, self.envs = Scoped(DEFAULTS), Scoped({}), Scoped({})
        self.groups: list[str] = []
        self.fuel, self.started, self.now = FUEL, False, now
        self.files: list[str] = []  # that are being read
        self.known: dict[str, int] = {}  # categories of characters met
        self.plain: dict[str, Token] = {}  # tokens of those that stand for themselves
        self.resolver = resolver.get if isinstance(resolver, Mapping) else resolver

    # ---- characters and raw tokens

    def cat(self, c: str) -> int:
        k = self.known.get(c)
        if k is None:
            k = self.known[c] = self.cats.get(c, LETTER if c.isalpha() else OTHER)
        return k

    def recategorised(self) -> None:
        """Forgets what is known of characters; whenever categories change."""
        self.known.clear(), self.plain.clear()
        if self.runs:
            self.runs = False
            self.input[:] = [c for x in self.input for c in (reversed(x) if isinstance(x, str) else (x,))]

    def cut(self) -> None:
        """Cuts a run that comes next into its characters."""
        if self.input and isinstance(c := self.input[-1], str) and len(c) > 1:
            self.input.pop()
            self.input.extend(reversed(c))

    def push(self, items: list) -> None:
        self.input.extend(reversed(items))

    def _blank(self) -> Token | None:
        """A run of blanks and comments from here on: a space, a paragraph if a line in it is empty, or nothing at its start."""
        lines, seen, fresh = 0, False, False
        while self.input:
            c = self.input[-1]
            if isinstance(c, Token):
                break
            k = self.cat(c[0])
            if k == COMMENT:
                while self.input and not (isinstance(self.input[-1], str) and self.cat(self.input[-1][0]) == EOL):
                    self.input.pop()
                if self.input:
                    self.input.pop()
                fresh = True
            elif k == EOL:
                self.input.pop()
                lines, seen = lines + 1 + fresh, True
                fresh = False
            elif k == SPACE:
                self.input.pop()
                seen = seen or not fresh
            else:
                break
        return PAR if lines > 1 else SPACE_TOKEN if seen else None

    def raw(self) -> Token | None:
        """The next token, unexpanded; None at the end."""
        while self.input:
            c = self.input.pop()
            if c.__class__ is str and len(c) > 1:
                self.input.extend(reversed(c))
                c = self.input.pop()
            if isinstance(c, Token):
                if c.kind == "file":
                    self.files.pop()
                    continue
                self.started = True
                return c
            self.fuel = FUEL
            k = self.cat(c)
            if k in (EOL, SPACE, COMMENT):
                self.input.append(c)
                t = self._blank()
                if t and (self.started or t is PAR and self.started):
                    return t
                continue
            self.started = True
            if k == ESCAPE:
                name = ""
                if self.runs and self.input and (c := self.input[-1]).__class__ is str and (m := _NAME.match(c)):
                    name = self.input.pop()[: m.end()]
                    if c.startswith(" ", m.end()):
                        self.input += (c[m.end() + 1 :], " ")
                    elif len(c) > m.end():
                        self.input.append(c[m.end() :])
                    elif self.input and self.input[-1] in ("{", "\\"):
                        return Token("cs", name)
                self.cut()
                while self.input and isinstance(self.input[-1], str) and self.cat(self.input[-1]) == LETTER:
                    name += self.input.pop()
                if name:
                    if (t := self._blank()) is PAR:
                        self.input.append(PAR)
                    return Token("cs", name)
                if not self.input:
                    raise TeXError("escape character at the end of the text")
                c = self.input.pop()
                return Token("cs", c if isinstance(c, str) else c.text)
            if k == PARAM:
                n = 1
                while self.input and isinstance(self.input[-1], str) and self.cat(self.input[-1][0]) == PARAM:
                    self.input.pop()
                    n += 1
                self.cut()
                d = self.input.pop() if self.input else ""
                if not (isinstance(d, str) and d.isdigit()):
                    raise TeXError("parameter character without a digit")
                return Token("param", d, level=n)
            if k == ACTIVE:
                return Token("cs", c, active=True)
            if k in (IGNORED, INVALID):
                raise TeXError(f"unexpected character {c!r}")
            t = Token("char", c, k)
            if k in (LETTER, OTHER):
                self.plain[c] = t
            return t
        return None

    def need(self, what: str) -> Token:
        if (t := self.raw()) is None:
            raise TeXError(f"end of text where {what} was expected")
        return t

    def skip_blanks(self) -> None:
        while (t := self.raw()) is not None:
            if t.cat != SPACE:
                self.push([t])
                return

    def balanced(self, open_: Callable[[Token], bool], close: Callable[[Token], bool]) -> list[Token]:
        """Tokens up to the matching close, which is consumed; braces are kept whole."""
        out, depth, braces = [], 0, 0
        while True:
            t = self.need("a closing delimiter")
            if braces == 0 and close(t):
                if depth == 0:
                    return out
                depth -= 1
            elif braces == 0 and open_(t):
                depth += 1
            elif t.cat == BEGIN:
                braces += 1
            elif t.cat == END:
                braces -= 1
            out.append(t)

    def group(self) -> list[Token]:
        """The tokens of a braced argument, or the single next token."""
        self.skip_blanks()
        t = self.need("an argument")
        if t.cat == BEGIN:
            return self.balanced(lambda x: x.cat == BEGIN, lambda x: x.cat == END)
        return [t]

    def text(self) -> str:
        text = self.input
        if self.runs and len(text) > 2 and text[-1] == "{" and text[-3] == "}" and (c := text[-2]).__class__ is str and c[0] not in DEFAULTS:
            del text[-3:]
            self.fuel, self.started = FUEL, True
            return c.strip()
        return "".join(t.show() for t in self.group()).strip()

    def optional(self, open_: str = "[", close: str = "]") -> list[Token] | None:
        self.skip_blanks()
        t = self.raw()
        if t is not None and t.kind == "char" and t.text == open_ and t.cat != BEGIN:
            return self.balanced(lambda x: open_ != close and x.kind == "char" and x.text == open_, lambda x: x.kind == "char" and x.text == close)
        if t is not None:
            self.push([t])
        return None

    def star(self, mark: str = "*") -> bool:
        self.skip_blanks()
        t = self.raw()
        if t is not None and t.kind == "char" and t.text == mark:
            return True
        if t is not None:
            self.push([t])
        return False

    def named(self, env: str) -> list[Token]:
        """The name of an environment in braces."""
        run = self.runs and _BARE.fullmatch(env)
        return [OPEN, *([Token("words", env, LETTER)] if run else [Token("char", c, LETTER if c.isalpha() else OTHER) for c in env]), CLOSE]

    # ---- scopes

    def open(self, name: str) -> None:
        self.groups.append(name)
        for table in (self.cats, self.macros, self.envs):
            table.scopes.append({})

    def close(self, name: str) -> None:
        if not self.groups or self.groups[-1] != name:
            raise TeXError(f"end of {name} where {self.groups[-1] if self.groups else 'no group'} is open")
        self.groups.pop()
        if self.cats.close():
            self.recategorised()
        self.macros.close()
        self.envs.close()

    # ---- macros

    def xparse(self, spec: list[Token]) -> list[tuple]:
        """An argument specification in xparse's letters."""
        sub, out = Lexer(""), []
        sub.input = list(reversed(spec))
        while (t := sub.raw()) is not None:
            k = t.text
            if t.cat == SPACE or k == "+":
                continue
            if k in ("m", "o", "g", "s"):
                out.append((k,))
            elif k in ("O", "G"):
                out.append((k, sub.group()))
            elif k == "t":
                out.append((k, sub.need("a token").text))
            elif k in ("r", "d"):
                out.append((k, sub.need("a token").text, sub.need("a token").text))
            elif k in ("R", "D"):
                out.append((k, sub.need("a token").text, sub.need("a token").text, sub.group()))
            elif k == "l":
                out.append((k,))
            elif k == "u":
                out.append((k, sub.group()))
            else:
                raise TeXError(f"argument type {k} is not supported")
        return out

    def until(self, stop: list[Token]) -> list[Token]:
        out, braces = [], 0
        while True:
            out.append(t := self.need("the end of an argument"))
            braces += (t.cat == BEGIN) - (t.cat == END)
            if braces == 0 and out[-len(stop) :] == stop:
                out = out[: -len(stop)]
                return out[1:-1] if len(out) > 1 and out[0].cat == BEGIN and out[-1].cat == END else out

    def capture(self, args: list[tuple]) -> list[list[Token]]:
        out = []
        for a in args:
            k = a[0]
            if k == "m":
                out.append(self.group())
            elif k in ("o", "O"):
                v = self.optional()
                out.append(v if v is not None else [NO_VALUE] if k == "o" else list(a[1]))
            elif k in ("d", "D", "r", "R"):
                v = self.optional(a[1], a[2])
                if v is None and k in ("r",):
                    raise TeXError(f"{a[1]} expected")
                out.append(v if v is not None else list(a[3]) if len(a) > 3 else [NO_VALUE])
            elif k in ("g", "G"):
                self.skip_blanks()
                t = self.raw()
                if t is not None:
                    self.push([t])
                out.append(self.group() if t is not None and t.cat == BEGIN else list(a[1]) if k == "G" else [NO_VALUE])
            elif k in ("s", "t"):
                out.append([YES if self.star("*" if k == "s" else a[1]) else NO])
            elif k == "u":
                out.append(self.until(a[1]))
            elif k == "l":
                took = []
                while (t := self.need("a group")).cat != BEGIN:
                    took.append(t)
                self.push([t])
                out.append(took)
            elif k == "literal":
                if (t := self.need(a[1].text)) != a[1]:
                    raise TeXError(f"{a[1].show()} expected, {t.show()} found")
        return out

    @staticmethod
    def substitute(body: list[Token], args: list[list[Token]]) -> list[Token]:
        out = []
        for t in body:
            if t.kind == "param":
                if t.level > 1:
                    out.append(t._replace(level=t.level - 1))
                elif int(t.text) <= len(args):
                    out += args[int(t.text) - 1]
            else:
                out.append(t)
        return out

    def spend(self) -> None:
        self.fuel -= 1
        if self.fuel < 0:
            raise TeXError("too many expansions")

    # ---- execution

    def number(self) -> int:
        self.skip_blanks()
        t = self.need("a number")
        if t.text == "`":
            return ord(self.need("a character").text[0])
        if t.kind == "cs" and t.text == "catcode":
            return self.cat(chr(self.number()))
        base = {'"': 16, "'": 8}.get(t.text, 10)
        digits = "" if base != 10 else t.text
        allowed = "0123456789ABCDEFabcdef"[: base if base < 11 else 22]
        while self.input:
            # one blank ends the number; what follows it must not be read yet, as its category may be about to change
            if isinstance(self.input[-1], str) and self.cat(self.input[-1][0]) in (SPACE, EOL):
                self.input.pop()
                break
            u = self.raw()
            if u is None:
                break
            if u.kind != "char" or u.text not in allowed:
                self.push([u])
                break
            digits += u.text
        try:
            return int(digits, base)
        except ValueError:
            raise TeXError(f"{digits!r} is not a number") from None

    def branch(self) -> tuple[list[Token], list[Token]]:
        """Both branches of a conditional up to its end, unexpanded."""
        parts: list[list[Token]] = [[], []]
        depth, side = 0, 0
        while True:
            t = self.need("the end of a conditional")
            name = self.meaning_of(t)
            if name in ("iftrue", "iffalse"):
                depth += 1
            elif name == "fi":
                if not depth:
                    return parts[0], parts[1]
                depth -= 1
            elif name == "else" and not depth:
                side = 1
                continue
            parts[side].append(t)

    def meaning_of(self, t: Token) -> str | None:
        """The primitive that a token stands for, also by another name."""
        if t.kind != "cs":
            return None
        m = self.macros.get(t.show())
        return m.primitive if m else t.text if t.text in PRIMITIVES and not t.active else None

    def describe(self, t: Token) -> str:
        m = self.macros.get(t.show()) if t.kind == "cs" else None
        if t.kind == "char":
            names = {LETTER: "the letter", OTHER: "the character", BEGIN: "begin-group character", END: "end-group character", MATH: "math shift character", SPACE: "blank space"}
            return f"{names.get(t.cat, 'the character')} {t.text}"
        if m and m.primitive or not m and t.text in PRIMITIVES:
            return f"primitive:{m.primitive if m else t.text}"
        if m and m.undefined:
            return "undefined"
        if m and m.char:
            return self.describe(m.char)
        if m:
            return f"macro:{''.join('#' + str(i + 1) for i in range(len(m.args)))}->{''.join(x.show() for x in m.body)}"
        return "undefined"

    def execute(self, name: str) -> list[Token]:
        """Runs a primitive; what it returns goes to the output."""
        if name == "def":
            t = self.need("a control sequence")
            spec = []
            while (u := self.need("a macro body")).cat != BEGIN:
                spec.append(u)
            body = self.balanced(lambda x: x.cat == BEGIN, lambda x: x.cat == END)
            args, i = [], 0
            while i < len(spec) and spec[i].kind != "param":
                args.append(("literal", spec[i]))
                i += 1
            while i < len(spec):
                stop = []
                i += 1
                while i < len(spec) and spec[i].kind != "param":
                    stop.append(spec[i])
                    i += 1
                args.append(("u", stop) if stop else ("m",))
            self.macros[t.show()] = Macro(args, body)
        elif name == "let":
            t = self.need("a control sequence")
            self.star("=")
            u = self.need("a token")
            if u.kind == "char":
                self.macros[t.show()] = Macro([], [], char=u)
            elif (m := self.macros.get(u.show())) is not None:
                self.macros[t.show()] = m
            elif u.text in PRIMITIVES:
                self.macros[t.show()] = Macro([], [], primitive=u.text)
            else:
                self.macros[t.show()] = Macro([], [], undefined=True)
        elif name in ("newcommand", "renewcommand", "providecommand", "DeclareRobustCommand"):
            self.star()
            t = self.group()[-1]
            args = self._counted()
            self._global(self.macros, t.show(), Macro(args, self.group()), name == "providecommand")
        elif name.endswith("DocumentCommand"):
            t = self.group()[-1]
            args = self.xparse(self.group())
            self._global(self.macros, t.show(), Macro(args, self.group()), name.startswith("Provide"))
        elif name in ("newenvironment", "renewenvironment"):
            self.star()
            env, args = self.text(), self._counted()
            self._global(self.envs, env, Macro(args, self.group(), self.group()), False)
        elif name.endswith("DocumentEnvironment"):
            env, args = self.text(), self.xparse(self.group())
            self._global(self.envs, env, Macro(args, self.group(), self.group()), name.startswith("Provide"))
        elif name in ("iftrue", "iffalse"):
            yes, no = self.branch()
            self.push(yes if name == "iftrue" else no)
        elif name in ("else", "fi"):
            raise TeXError(f"\\{name} without a conditional")
        elif name in ("IfBooleanTF", "IfNoValueTF"):
            test, yes, no = self.group(), self.group(), self.group()
            self.push(yes if test == [YES if name == "IfBooleanTF" else NO_VALUE] else no)
        elif name == "char":
            return [Token("char", chr(self.number()), OTHER)]
        elif name == "number":
            return [Token("char", c, OTHER) for c in str(self.number())]
        elif name == "catcode":
            c = chr(self.number())
            self.star("=")
            if (k := self.number()) > 15:
                raise TeXError(f"no category {k}")
            self.cats[c] = k
            self.recategorised()
        elif name == "meaning":
            return [Token("char", c, SPACE if c == " " else LETTER if c.isalpha() else OTHER) for c in self.describe(self.need("a token"))]
        elif name in ("begingroup", "bgroup"):
            self.open(name)
            return [Token("char", "{", BEGIN)]
        elif name in ("endgroup", "egroup"):
            self.close("begingroup" if name == "endgroup" else "bgroup")
            return [Token("char", "}", END)]
        elif name == "begin":
            env = self.text()
            self.open(f"environment {env}")
            if (m := self.envs.get(env)) is not None:
                self.spend()
                args = self.capture(m.args)
                self.groups[-1] = f"defined environment {env}"
                self.macros[f"end of {env}"] = Macro([], self.substitute(m.end or [], args))
                self.push(self.substitute(m.body, args))
                return []
            return [Token("cs", "begin"), *self.named(env)]
        elif name == "end":
            env = self.text()
            if self.groups and self.groups[-1] == f"defined environment {env}":
                self.groups[-1] = f"ending environment {env}"
                m = self.macros[f"end of {env}"]
                self.push([*m.body, Token("cs", "end"), Token("char", "{", BEGIN), *(Token("char", c, LETTER) for c in env), Token("char", "}", END)])
                return []
            if self.groups and self.groups[-1] == f"ending environment {env}":
                self.close(f"ending environment {env}")
                return []
            self.close(f"environment {env}")
            return [Token("cs", "end"), *self.named(env)]
        elif name in ("input", "include"):
            self.skip_blanks()
            t = self.need("a file name")
            if t.cat == BEGIN:
                file = "".join(x.show() for x in self.balanced(lambda x: x.cat == BEGIN, lambda x: x.cat == END)).strip()
            else:
                file = t.text
                while (u := self.raw()) is not None and u.kind == "char" and u.cat not in (SPACE, BEGIN, END):
                    file += u.text
                if u is not None and u.cat != SPACE:
                    self.push([u])
            if self.resolver is not None:
                found = self.resolver(file)
                found = found if found is not None else self.resolver(file + ".tex")
                if found is None:
                    raise TeXError(f"file {file} can't be read")
                if file in self.files:
                    raise TeXError(f"file {file} includes itself")
                self.files.append(file)
                self.push([*found, Token("file", file)])
        elif name in ("year", "month", "day", "time"):
            value = "" if self.now is None else str(self.now.hour * 60 + self.now.minute) if name == "time" else str(getattr(self.now, name))
            return [Token("char", c, LETTER) for c in value]
        elif name in ("(", ")"):
            return [Token("char", "$", MATH)]
        elif name in ("[", "]"):
            return [Token("char", "$", MATH)] * 2
        return []

    def _counted(self) -> list[tuple]:
        """[n][default] of LaTeX's own definitions."""
        n = self.optional()
        default = self.optional() if n is not None else None
        count = int("".join(t.text for t in n)) if n else 0
        return [("O", default), *[("m",)] * (count - 1)] if default is not None and count else [("m",)] * count

    @staticmethod
    def _global(table: Scoped, key: str, value: Macro, keep: bool) -> None:
        if not (keep and key in table):
            table.everywhere(key, value)

    def tokens(self) -> list[Token]:
        """All tokens, with macros expanded and primitives run."""
        out: list[Token] = []
        text, plain, macros = self.input, self.plain, self.macros
        while True:
            while self.runs and text and (c := text[-1]).__class__ is str:  # runs of the text, single spaces between two, escaped marks and braces
                if c[0] not in DEFAULTS:
                    out.append(Token("words", text.pop(), LETTER))
                    self.fuel, self.started = FUEL, True
                elif c in MARKS and c not in macros:
                    text.pop()
                    out.append(MARKS[c])
                    self.fuel, self.started = FUEL, True
                elif c == "{":
                    text.pop()
                    self.open("group")
                    out.append(OPEN)
                    self.fuel, self.started = FUEL, True
                elif c == "}":
                    text.pop()
                    self.close("group")
                    out.append(CLOSE)
                    self.fuel, self.started = FUEL, True
                elif c == "\n" and self.started and len(text) > 1 and text[-2] == "\n" and "\\par" not in macros:
                    n = 2
                    while len(text) > n and text[-1 - n] == "\n":
                        n += 1
                    if len(text) == n or text[-1 - n].__class__ is not str or text[-1 - n][0] in " \t%":
                        break
                    del text[-n:]
                    out.append(PAR)
                    self.fuel = FUEL
                elif c in " \n" and self.started and len(text) > 1 and (d := text[-2]).__class__ is str and d[0] not in " \t\n%":
                    text.pop()
                    out.append(SPACE_TOKEN)
                    self.fuel = FUEL
                else:
                    break
            while text and (t := plain.get(text[-1])) is not None:  # runs of letters and the like
                text.pop()
                out.append(t)
                self.fuel = FUEL
            if (t := self.raw()) is None:
                break
            if t.kind == "cs":
                m = macros.get(t.show())
                if m is None and t.text not in PRIMITIVES:
                    pass
                elif m is not None and m.char is not None:
                    t = m.char
                elif m is not None and m.undefined:
                    pass
                elif m is not None and m.primitive is None:
                    self.spend()
                    self.push(self.substitute(m.body, self.capture(m.args)))
                    continue
                elif (name := self.meaning_of(t)) is not None:
                    self.spend()
                    out += self.execute(name)
                    continue
            if t.cat == BEGIN:
                self.open("group")
            elif t.cat == END:
                self.close("group")
            out.append(t)
        if self.groups:
            raise TeXError(f"end of text in {self.groups[-1]}")
        return out


def lex(text: str, resolver=None, now=None) -> list[Token]:
    return Lexer(text, resolver, now).tokens()


def lex_runs(text: str, resolver=None, now=None) -> list[Token]:
    """lex() with runs of letters and other characters as one token each, as the parser reads them."""
    return Lexer(text, resolver, now, runs=True).tokens()
