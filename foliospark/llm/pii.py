"""Personal data: base patterns, and candidates judged by boosted trees; DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks; they always stay. Generators of high
recall propose further spans (numbers written in groups, spelled-out e-mail addresses, long mixed tokens and dotted chains of them, whatever is assigned to
a word for a secret, bank account numbers, addresses with colons), which may overlap. Each is described by its form and by the words around
it; gradient-boosted trees, compiled to SQL, give it a score. On held-out examples each kind's scores are calibrated to probabilities by a logistic
curve, and the kind's threshold is the least probability whose precision there is PRECISION or more. Of overlapping accepted spans the base one
stays, then the better scored.

The trees are fitted on the driver to EXAMPLES generated examples of documented formats and look-alikes (dates, versions, ISBNs, order numbers,
checksums): a bounded sample that doesn't depend on the corpus. Features of examples and of documents come from the same SQL.

Positions. A pattern's matches and the stretches between them (split by the same pattern) alternate, so running lengths give
positions in code points. Quantifiers are possessive and starts are held to run beginnings or the last match's end, which changes
no match and keeps time linear on very long runs.

Defined results: null and empty texts have no spans; rows are independent, so repeated rows get equal results; a null doc_id is kept;
a text of any length is whole and is handled in the time that its length takes; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed patterns of the base kinds, in their order; the first two are written so that they start at a run's beginning.
BASE = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)",
    "card": r"[0-9](?:[\\x20-]?[0-9])++",
    "phone": r"\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for the kind to be looked for at all.
NEEDS = {"email": "contains(t, '@')", "ip": "t RLIKE '[0-9]\\\\.[0-9]+\\\\.[0-9]+\\\\.[0-9]'", "card": "t RLIKE '[0-9](?:[ -]?[0-9]){15}'", "phone": "contains(t, '+')"}
#: Generators: a pattern, and what must be there for it to run.
GENERATORS = {
    "groups": (r"(?<![0-9A-Za-z.+])(?=(?:[ .()-]{0,2}[0-9]){4})(?=[(]|[0-9]++[ .-][0-9]|[0-9]{7})(?:\\([0-9]++\\)[ ]?+)?+[0-9]++(?:[ .-][0-9]++)*+(?![0-9A-Za-z])", "t RLIKE '[0-9][ .)-]+[0-9]|[0-9]{7}'"),
    "spelled": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?: ?[\\[(] ?at ?[\\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\\[(] ?dot ?[\\])] ?| dot )[A-Za-z]{2,}+)+", "t RLIKE '[ (\\\\[]at[ )\\\\]]' AND contains(t, 'dot')"),
    "token": (r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{14,}+(?:\\.[A-Za-z0-9+/_-]{14,}+)*={0,2}(?![A-Za-z0-9+/_-])", "t RLIKE '[A-Za-z+/_-][0-9]|[0-9][A-Za-z+/_-]|[A-Za-z]{14}'"),
    "named": (r"(?<=[\"\\x27=: ])(?<=(?i:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|credential)(?:[\"\\x27 ]{0,2}[=:] {0,2}[\"\\x27]?| [\"\\x27]))[^\\s\"\\x27]++", "t RLIKE '(?i:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|credential)[ :=\"\\\\x27]'"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t RLIKE '[A-Z]{2}[0-9]{2}'"),
    "colons": (r"(?<![0-9A-Za-z:])(?=:*+[0-9a-fA-F])(?:(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*+)?+::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*+)?+)(?![0-9A-Za-z:])", "t RLIKE '[0-9a-fA-F]:[0-9a-fA-F]|::'"),
}
#: Kinds that candidates may become, in the order of the spans column: the base kinds first.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "id")
EXAMPLES, SEED, PRECISION = 5000, 11, 0.97
SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"


def _spans(t: str, pattern: str, needs: str) -> str:
    """SQL for the array of SPAN of a pattern's matches in the column t."""
    found = f"named_struct('m', regexp_extract_all({t}, '{pattern}', 0), 's', split({t}, '{pattern}', -1))"
    joined = "zip_with(zip_with(v.m, slice(v.s, 1, size(v.m)), (m, s) -> named_struct('m', m, 's', s)), slice(v.s, 2, size(v.m)), (p, n) -> named_struct('m', p.m, 's', p.s, 'n', n))"
    step = "named_struct('start', a.at + length(x.s), 'end', a.at + length(x.s) + length(x.m), 'text', x.m, 'before', right(x.s, 48), 'after', left(x.n, 16))"
    body = f"aggregate({joined}, named_struct('at', 0, 'out', cast(array() AS array<{SPAN}>)), (a, x) -> named_struct('at', a.at + length(x.s) + length(x.m), 'out', concat(a.out, array({step}))), a -> a.out)"
    return f"CASE WHEN {needs} THEN transform(array({found}), v -> {body})[0] ELSE cast(array() AS array<{SPAN}>) END"


_DIGITS = "regexp_replace(x.text, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether the digit string passes the Luhn check."""
    digit = "int(substring(d, i, 1))"
    return f"transform(array(reverse({digits})), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + IF(i % 2 = 1, {digit}, int(2 * {digit} / 10) + 2 * {digit} % 10)))[0] % 10 = 0"


CHECKS = {
    "email": "true",
    "ip": "forall(split(x.text, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}

_WORDS = {
    "w_phone": "phone|tel|call|fax|mobile|cell|whatsapp|dial",
    "w_card": "card|visa|amex|credit|debit|pay",
    "w_person": "ssn|social security|passport|tax id|national id|licen[cs]e no|personal id",
    "w_secret": "password|passwd|pwd|secret|token|api|key|bearer|credential|auth",
    "w_bank": "iban|acc(ount|t)|bank|transfer|bic|swift",
    "w_net": "ip|host|server|address|mac|node|gateway",
    "w_mail": "mail|contact|write|reach|address",
    "w_other": "isbn|version|invoice|order|part no|model|sha|md5|commit|build|page|chapter|figure|doi|issn|serial|checksum|score|from|between",
}
#: Features of a candidate x (text, before, after, g): SQL giving doubles.
FEATURES = {
    **{f"g_{g}": f"IF(x.g = '{g}', 1D, 0D)" for g in GENERATORS},
    "chars": "double(length(x.text))",
    "digits": f"double(length({_DIGITS}))",
    "upper": "double(length(regexp_replace(x.text, '[^A-Z]', '')))",
    "lower": "double(length(regexp_replace(x.text, '[^a-z]', '')))",
    "hex": "IF(x.text RLIKE '^[0-9a-fA-F]+$', 1D, 0D)",
    "changes": "double(size(split(x.text, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])')))",
    "distinct": "double(size(array_distinct(split(x.text, ''))))",
    "groups": "double(size(split(x.text, '[ .:-]+')))",
    "first": "double(length(split(x.text, '[ .:-]+')[0]))",
    "last": "double(length(element_at(split(x.text, '[ .:-]+'), -1)))",
    "parentheses": "IF(contains(x.text, '('), 1D, 0D)",
    "dots": "double(length(x.text) - length(replace(x.text, '.', '')))",
    "dashes": "double(length(x.text) - length(replace(x.text, '-', '')))",
    "luhn": f"IF(length({_DIGITS}) > 11 AND {_luhn(_DIGITS)}, 1D, 0D)",
    "year": "IF(x.text RLIKE '(^|[ .-])(19|20)[0-9]{2}([ .-]|$)', 1D, 0D)",
    "assigned": "IF(x.before RLIKE '[A-Za-z_]+ ?[=:] ?[\"\\']?$', 1D, 0D)",
    "known": "IF(x.text RLIKE '^(AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[abp]-|eyJ|AIza)', 1D, 0D)",
    "symbols": "double(length(regexp_replace(x.text, '[A-Za-z0-9]', '')))",
    "runs": "double(size(split(x.text, '[^A-Za-z0-9]+')))",
    "stand_in": "IF(x.text RLIKE '(?i)^[<{*$%]|^x+$|your|example|required|changed?|enter|none|null|true|false|environ|[*]{3}|[(]', 1D, 0D)",
    "money": "IF(x.before RLIKE '[$€£#]$' OR x.after RLIKE '^ ?([%€$]|USD|EUR)', 1D, 0D)",
    **{k: f"IF(lower(x.before) RLIKE '(^|[^a-z])({w})[^a-z]{{0,4}}([a-z]{{0,12}}[^a-z]{{1,4}}){{0,2}}$', 1D, 0D)" for k, w in _WORDS.items()},
}
#: Which kind an accepted candidate becomes.
BECOMES = (
    "CASE x.g WHEN 'spelled' THEN 'email' WHEN 'colons' THEN 'ip' WHEN 'account' THEN 'account' WHEN 'token' THEN 'secret' WHEN 'named' THEN 'secret' ELSE "
    f"CASE WHEN length({_DIGITS}) > 19 THEN 'account' WHEN length({_DIGITS}) >= 13 AND {FEATURES['w_phone']} = 0 THEN 'card' WHEN x.text RLIKE '^[0-9]{{3}}[ -][0-9]{{2}}[ -][0-9]{{4}}$' THEN 'id' ELSE 'phone' END END"
)


# ---- generated examples -------------------------------------------------------------------------------------------------------


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else c for c in shape)


def _word(r: random.Random) -> str:
    return "".join(r.choice(["th", "an", "er", "in", "on", "es", "ver", "de", "la", "qu", "ie", "ous", "ment"]) for _ in range(r.randint(1, 4)))


def _with_check(body: str) -> str:
    total = sum(d if i % 2 else d // 5 + 2 * d % 10 for i, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Texts that hold one candidate each, and whether it is personal data."""
    r, out = random.Random(seed), []
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def mixed(k: int, of: str = chars) -> str:
        return "".join(r.choice(of) for _ in range(k))

    while len(out) < n:
        yes, kind, lead = r.random() < 0.5, r.randrange(8), ""
        if r.random() < 0.2:  # long words of running text are by far the most frequent candidates
            yes, text = False, "".join(_word(r) for _ in range(12))[: r.randint(14, 26)]
            lead, text = r.choice(["", "", "the ", f"{_word(r)}, ", "a "]), r.choice([text, text, text.capitalize(), text.upper(), text.upper() + "!!", text + "-" + _word(r), _word(r) + "/" + text])
        elif yes:
            if kind == 0:
                lead, text = r.choice(["call ", "Tel: ", "phone ", "fax ", "mobile no. ", "dial ", ""]), _digits(r, r.choice(["(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999999", "09 99 99 99 99", "999 999 9999", "0999999999", "09999999999", "9 99 99 99 99", "09 99 99 99 99 99 99", "9 999 999 9999", "99 9 9999 9999"]))
            elif kind == 1:
                lead, text = r.choice(["SSN ", "social security no. ", "ssn: ", "tax id ", "passport "]), _digits(r, "999-99-9999")
            elif kind == 2:
                lead, text = r.choice(["card ", "visa ", "credit card: ", "pay with ", ""]), "{}-{}-{}-{}".format(*(lambda c: (c[:4], c[4:8], c[8:12], c[12:]))(_with_check("4" + _digits(r, "9" * 14)))).replace("-", r.choice(["-", " "])) if r.random() < 0.75 else _with_check("37" + _digits(r, "9" * 12))
            elif kind == 3:
                lead = r.choice(["password=", "token = \"", "api_key: ", "secret: ", "Bearer ", "passwd: ", "key=", ""])
                if r.random() < 0.2:
                    lead = r.choice(["token = \"", "secret=\"", "auth token: ", "api_key = "])
                text = "AKIA" + mixed(16, chars[:26] + chars[-10:]) if not lead or r.random() < 0.3 else mixed(r.randint(16, 44), r.choice([chars, "0123456789abcdef"]))
            elif kind == 4:
                lead, text = r.choice(["IBAN ", "account ", "bank transfer to ", ""]), r.choice(["DE", "FR", "ES", "GB", "NL"]) + _digits(r, r.choice(["99 9999 9999 9999 9999 99", "99999999999999999999", "99 9999 9999 9999 9999 9999"]))
            elif kind == 7:
                lead, text = r.choice([
                    lambda: (r.choice(["acct ", "account no. ", "account: ", "bank account "]), mixed(r.randint(10, 26), "0123456789")),
                    lambda: (r.choice(["password: ", "pwd=", "passwd: ", "secret="]), mixed(r.randint(2, 4), "abcdefghijkmnpqrstuvwxyz") + mixed(r.randint(2, 4), "23456789")),
                    lambda: (r.choice(["server ", "host ", "ip ", "ping ", ""]), ":".join(mixed(r.randint(1, 4), "0123456789abcdef") for _ in range(r.randint(1, 3))) + "::" + ":".join(mixed(4, "0123456789abcdef") for _ in range(r.randint(1, 4)))),
                    lambda: (r.choice(["mail ", "write to ", ""]), f"{mixed(1, chars[26:52])} [at] {_word(r)[:1]} [dot] com"),
                    lambda: (r.choice(["card no ", "card "]), " ".join(_digits(r, "9999") for _ in range(4)) + " " + _digits(r, "9" * r.randint(1, 3))),
                ])()
            elif kind == 5:
                lead = r.choice(["password: ", "password=", "secret \"", "passwd = ", "pwd: ", "passphrase: ", "token: ", "my password: "])
                text = r.choice([lambda: "".join(_word(r) for _ in range(r.randint(2, 5))) + "es", lambda: mixed(r.randint(8, 30), chars + "!@#&%^*-_"), lambda: _word(r) + r.choice("!@#&$") + _digits(r, "999") + _word(r) + "er", lambda: ".".join(mixed(r.randint(18, 90), chars + "-_") for _ in range(3))])()
            else:
                lead, text = r.choice(["mail ", "contact ", "write to ", "reach me: ", ""]), f"{_word(r)}.{_word(r)}{r.choice([' at ', ' (at) ', ' [at] '])}{_word(r)}{r.choice([' dot ', ' (dot) ', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
                if r.random() < 0.3:
                    lead, text = r.choice(["server ", "host ", "ip "]), ":".join(mixed(4, "0123456789abcdef") for _ in range(8))
        elif kind == 0:
            lead, text = r.choice(["", "on ", "since ", "from "]), _digits(r, r.choice(["2019-99-99", "99-99-2021", "99.99.1998", "1914-1918", "1999 2001"]))
        elif kind == 1:
            lead, text = r.choice(["version ", "build ", "chapter ", "page ", "score ", "figure "]), _digits(r, r.choice(["99.99.99", "99-99", "99.999", "99.99", "999-999"]))
        elif kind == 2:
            lead, text = r.choice(["ISBN ", "isbn: ", "ISSN ", "order ", "invoice ", "part no. ", "serial "]), _digits(r, r.choice(["978-9-99-999999-9", "9999-9999", "99999-9999", "999 999 999"]))
        elif kind == 3:
            lead, text = r.choice(["", "the ", "see ", "commit ", "sha ", "md5 ", "checksum "]), r.choice([lambda: "-".join(_word(r) for _ in range(4)), lambda: "_".join(_word(r) for _ in range(4)) + str(r.randint(1, 9)), lambda: mixed(40, "0123456789abcdef"), lambda: mixed(32, "0123456789abcdef"), lambda: f"section-{r.randint(1, 9)}/{_word(r)}{_word(r)}{_word(r)}"])()
            if text[0].isalpha() and lead in ("", "the ", "see ") and len(text) in (32, 40):
                lead = "sha "
        elif kind == 4:
            lead, text = r.choice(["$", "about ", "", "some ", "no. ", "order "]), _digits(r, r.choice(["999 999 999", "99 999", "999.999.999", "99 999 999", "9" * r.randint(14, 24)]))
        elif kind == 5:
            lead = r.choice(["password: ", "secret: ", "token: ", "the token ", "pwd=", "api_key="])
            text = r.choice(["required", "<password>", "your_password_here", "********", "changed", "(optional)", "${PASSWORD}", "os.environ[KEY]", "None,", "example", "xxxxxxxx", "<your-token>", "true,", "enter-your-secret-here"])
            if lead == "the token ":
                text = f"{_word(r)}-{_word(r)}-{_word(r)}ment-{_word(r)}er"
        elif kind == 7:
            lead, text = r.choice([
                lambda: (r.choice(["password: ", "secret: ", "token: ", "the password: ", "credential: "]), _word(r)[:5]),
                lambda: (r.choice(["about ", "of ", "", "nearly "]), _digits(r, r.choice(["9 999", "9.9999", "99 9 99", "9 9 9 9", "9-9-9-9", "9.9.99.9", "1 2 3 4 5 6"]))),
                lambda: (r.choice(["", "scores ", "row "]), " ".join(str(r.randint(0, r.choice([9, 99, 999]))) for _ in range(r.randint(8, 80)))),
                lambda: (r.choice(["call ", "", "use "]), r.choice(["a::b", "c::d", "f::e", "ab::cd", "::a"])),
            ])()
        else:
            lead, text = r.choice(["", "between ", "at "]), r.choice([_digits(r, "12:99:99:99"), f"{_word(r)} at {_word(r)} dot matrix", _digits(r, "99-99-99")])
        out.append((f"{_word(r)} {_word(r)} {lead}{text}{r.choice([' ', '. ', ', ', chr(34) + ' '])}{_word(r)} {_word(r)}", int(yes)))
    return out


# ---- boosted trees ------------------------------------------------------------------------------------------------------------


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray):
    """(feature, cut, low, high) or a leaf's value."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) > 20:
        for j, c in enumerate(cuts):
            for v in c:
                low = x[rows, j] < v
                gl, hl = grad[rows][low].sum(), hess[rows][low].sum()
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (j, float(v)))
    if best[1] is None:
        return float(-g / (h + 1))
    j, v = best[1]
    low = x[rows, j] < v
    return (j, v, _tree(x, grad, hess, cuts, depth - 1, rows[low]), _tree(x, grad, hess, cuts, depth - 1, rows[~low]))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] < tree[1], _value(tree[2], x), _value(tree[3], x))


def _sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    return f"IF(x.{names[tree[0]]} < {tree[1]!r}D, {_sql(tree[2], names)}, {_sql(tree[3], names)})"


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.4) -> list:
    """Newton boosting of the logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.05, 0.95, 9)).round(3)) if len(np.unique(c)) > 10 else (np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
    f, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        t = _tree(x, p - y, p * (1 - p), cuts, depth, np.arange(len(y)))
        out.append(t)
        f += rate * _value(t, x)
    return [rate, out]


def calibrated(score: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope (positive) and shift of the logistic curve from scores to probabilities, by Newton steps with a small ridge."""
    x, w = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * (w - [1.0, 0.0]))
        w[0] = max(w[0], 0.05)
    return float(w[0]), float(w[1])


# ---- expressions --------------------------------------------------------------------------------------------------------------


def _generated() -> str:
    """SQL for the candidates of all generators: SPAN and the generator g."""
    parts = [f"transform({_spans('t', p, n)}, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'before', x.before, 'after', x.after, 'g', '{g}'))" for g, (p, n) in GENERATORS.items()]
    return f"concat({', '.join(parts)})"


def _described(candidates: str) -> str:
    """SQL for the same candidates with their kinds and features in place of their texts."""
    names = ", ".join(f"'{k}', {v}" for k, v in FEATURES.items())
    return f"transform({candidates}, x -> named_struct('start', x.start, 'end', x.end, 'kind', {BECOMES}, {names}))"


_fits: dict[str, tuple[str, str]] = {}


def _fitted(spark: SparkSession) -> tuple[str, str]:
    """SQL of the score (log odds) of a candidate x with features, and of its kind's threshold."""
    key = spark.sparkContext.applicationId
    if key not in _fits:
        made = examples()
        values = ", ".join("({}, '{}')".format(i, t.replace("\\", "\\\\").replace("'", "\\'")) for i, (t, _) in enumerate(made))
        frame = spark.sql(f"SELECT i, t FROM VALUES {values} AS v(i, t)")
        names = list(FEATURES)
        found = frame.withColumn("raw", F.expr(_generated())).selectExpr("i", f"inline({_described('raw')})").collect()
        missed = {i for i, (_, yes) in enumerate(made) if yes} - {r["i"] for r in found}
        assert not missed, [made[i][0] for i in sorted(missed)[:5]]
        x = np.array([[r[k] for k in names] for r in found])
        y = np.array([made[r["i"]][1] for r in found], dtype=float)
        held = np.array([r["i"] % 4 == 0 for r in found])
        rate, trees = boosted(x[~held], y[~held])
        score = rate * sum(_value(t, x) for t in trees)
        kinds = np.array([r["kind"] for r in found])
        bounds = {}
        for k in KINDS:
            mine = held & (kinds == k)
            slope, shift = calibrated(score[mine], y[mine])
            chance = 1 / (1 + np.exp(-(slope * score[mine] + shift)))
            tries = [p for p in np.arange(0.5, 0.96, 0.05) if (chance >= p).any() and y[mine][chance >= p].mean() >= PRECISION]
            least = tries[0] if tries else 0.95
            bounds[k] = float((np.log(least / (1 - least)) - shift) / slope)
        _fits[key] = (f"{rate}D * (" + " + ".join(_sql(t, names) for t in trees) + ")", "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {b:.6f}D" for k, b in bounds.items()) + " ELSE 3D END")
    return _fits[key]


def _order(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " ELSE 99 END"


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (and what is to be kept), t, base and spans: arrays of (place of the kind, start, kind, end), sorted."""
    spark = docs.sparkSession
    score, bound = _fitted(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), *(F.col(k) for k in keep if k != "doc_id"))
    kind = "array<struct<place:int,start:int,kind:string,end:int>>"
    parts = [f"transform(filter({_spans('t', BASE[k], NEEDS[k])}, x -> {CHECKS[k]}), x -> named_struct('place', {i}, 'start', x.start, 'kind', '{k}', 'end', x.end))" for i, k in enumerate(BASE)]
    rows = rows.withColumn("base", F.expr(f"cast(concat({', '.join(parts)}) AS {kind})"))
    described = _described(f"filter({_generated()}, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))")
    scored = f"transform({described}, x -> named_struct('gain', {score} - ({bound}), 'start', x.start, 'end', x.end, 'kind', x.kind))"
    best = "array_sort(filter(scored, x -> x.gain >= 0), (l, r) -> CASE WHEN l.gain > r.gain THEN -1 WHEN l.gain < r.gain THEN 1 WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE r.end - l.end END)"
    rows = rows.withColumn("scored", F.expr(scored))
    chosen = f"aggregate({best}, cast(array() AS {kind}), (a, x) -> IF(exists(a, b -> b.start < x.end AND x.start < b.end), a, concat(a, array(named_struct('place', {_order('x.kind')}, 'start', x.start, 'kind', x.kind, 'end', x.end)))))"
    rows = rows.withColumn("spans", F.expr(f"array_sort(cast(concat(base, {chosen}) AS {kind}))"))
    return rows.select("doc_id", "t", *(k for k in keep if k != "doc_id"), "base", "spans")


def _written(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; n_chars, if there, follows. Null texts stay null."""
    names = docs.columns
    rows = found(docs.withColumn("_row", F.struct(*names)), "_row")
    # spans by start; what overlaps the last one is swallowed by it
    sorted_ = "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', upper(x.kind))))"
    merge = "(a, x) -> IF(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), named_struct('at', x.end, 'out', concat(a.out, array(substring(t, a.at + 1, x.start - a.at), concat('[', x.kind, ']')))))"
    text = f"CASE WHEN size(spans) = 0 THEN t ELSE aggregate({sorted_}, named_struct('at', 0, 'out', cast(array() AS array<string>)), {merge}, a -> concat(array_join(a.out, ''), substring(t, a.at + 1))) END"
    rows = rows.withColumn("_text", F.expr(f"IF(_row.text IS NULL, NULL, {text})"))
    kinds = dict(docs.dtypes)
    return rows.select(*(F.col("_text").alias(c) if c == "text" else F.coalesce(F.length("_text"), F.col("_row.n_chars")).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"_row.{c}").alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(common.documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
