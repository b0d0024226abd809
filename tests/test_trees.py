"""Trees, scopes and splices against plain stacks and recursion, on inputs that are odd in every way."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.functions import sql
from foliospark.operators import includes, scopes, trees
from foliospark.sources import markup


def tree_of(tags):
    """node_id, last_id, parent_id, depth, name by a stack; tags: role, name."""
    stack, rows = [], []

    def close(upto):
        while len(stack) > upto:
            rows[stack.pop()[0] - 1][1] = len(rows)

    for role, name in tags:
        if role == "close":
            at = [i for i, (_, n) in enumerate(stack) if n == name]
            if at:
                close(at[-1])
            continue
        rows.append([len(rows) + 1, len(rows) + 1, stack[-1][0] if stack else 0, len(stack), name])
        if role == "open":
            stack.append((len(rows), name))
    close(0)
    return [tuple(r) for r in rows]


def random_documents(seed, n=60):
    r = random.Random(seed)
    return {d: [(r.choice(("open", "open", "close", "close", "leaf")), r.choice("abc"[: 1 + d % 3])) for _ in range(r.randint(0, 40))] for d in range(n)}


@pytest.fixture(scope="module")
def documents():
    fixed = [[("open", "a"), ("open", "b"), ("close", "a"), ("close", "b")], [("open", "b"), ("open", "a"), ("open", "b"), ("close", "a"), ("close", "b"), ("leaf", "x")], [("close", "a")] * 3, [("open", "a")] * 30]
    return random_documents(1) | {100 + i: d for i, d in enumerate(fixed)}


@pytest.fixture(scope="module")
def made(spark, documents):
    rows = [(d, i, role, name, f"{name}{i}") for d, tags in documents.items() for i, (role, name) in enumerate(tags)]
    return trees.checkpointed(trees.nodes(spark.createDataFrame(rows, "doc_id bigint, seq int, role string, name string, text string")))


def test_nodes_equal_a_stack(made, documents):
    want = Counter((d, *x) for d, tags in documents.items() for x in tree_of(tags))
    assert Counter((r["doc_id"], r["node_id"], r["last_id"], r["parent_id"], r["depth"], r["name"]) for r in made.collect()) == want


def test_ancestors_meet_without_pairs_of_a_document(made, documents):
    want = set()
    for d, tags in documents.items():
        rows = tree_of(tags)
        want |= {(d, a[0], x[0], x[3] - a[3]) for a in rows for x in rows if a[0] < x[0] <= a[1]}
    out = trees.ancestors(made)
    assert Counter((r["doc_id"], r["ancestor_id"], r["node_id"], r["distance"]) for r in out.collect()) == Counter(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_intervals_hold_points(spark):
    r = random.Random(3)
    spans = [(k, a, a + r.randint(-1, 70), i) for i in range(200) for k in (r.randint(0, 2),) for a in (r.randint(0, 100),)]
    points = [(k, x) for k in range(4) for x in range(0, 180, 3)]
    got = trees.contained(spark.createDataFrame(spans, "doc_id int, low int, high int, n int"), spark.createDataFrame(points, "doc_id int, at int")).collect()
    assert Counter((x["n"], x["at"]) for x in got) == Counter((n, x) for k, a, b, n in spans for j, x in points if j == k and a <= x <= b)


def test_unwrapping_equals_recursion(made, documents):
    for gone in ({"a"}, {"b", "c"}, {"a", "b", "c", "x"}, set()):
        want = []
        for d, tags in documents.items():
            rows = {x[0]: x for x in tree_of(tags)}
            kept = [i for i, x in rows.items() if x[4] not in gone]
            number = {i: n + 1 for n, i in enumerate(kept)}
            for i in kept:
                ups, p = [], rows[i][2]
                while p:
                    ups.append(p)
                    p = rows[p][2]
                ups = [p for p in ups if p in number]
                want.append((d, number[i], number[i] + sum(i < j <= rows[i][1] for j in kept), number[ups[0]] if ups else 0, len(ups), rows[i][4]))
        out = trees.unwrapped(made, F.col("name").isin(*gone) if gone else F.lit(False))
        assert Counter(tuple(r[c] for c in ("doc_id", "node_id", "last_id", "parent_id", "depth", "name")) for r in out.collect()) == Counter(want)


def test_texts_and_fragments_of_subtrees(made, documents):
    texts = {(r["doc_id"], r["node_id"]): r["text"] for r in trees.subtree_texts(made, F.when(F.col("name") != "c", F.concat("name", F.lit("é·")))).collect()}
    written = {r["doc_id"]: r["text"] for r in trees.serialised(made, F.concat(F.lit("("), "name"), F.lit(")")).collect()}
    for d, tags in documents.items():
        rows = tree_of(tags)
        for i, last, *_ in rows:
            assert texts[d, i] == "".join(f"{x[4]}é·" for x in rows[i - 1 : last] if x[4] != "c")

        def show(i):
            return "".join(f"({x[4]}{show(x[0])})" for x in rows if x[2] == i)

        assert written.get(d, "") == show(0)


def test_items_between_separators(made, documents):
    want = set()
    for d, tags in documents.items():
        rows = tree_of(tags)
        for p in {x[2] for x in rows if x[4] == "b"}:
            items, now = [], []
            for x in (x for x in rows if x[2] == p):
                if x[4] == "b":
                    items, now = [*items, now], []
                else:
                    now.append(x)
            items += [now] if now else []
            want |= {(d, p, k + 1, i[0][0] if i else None, i[-1][1] if i else None, len(i)) for k, i in enumerate(items)}
    assert Counter(tuple(r) for r in trees.lists(made, F.col("name") == "b").collect()) == Counter(want) and any(x[5] == 0 for x in want)


def test_tokens_of_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "a < b & c"), (4, '<P CLASS="x>y">é<br/><IMG src=\'<>\'></p>'), (5, "<script>if (a</b>) '<p>'</script><style>x"), (6, "<!-- <p> --><!DOCTYPE x><?y?>"), (7, "<p " + 'a="1" ' * 3000 + ">" + "z" * 100_000)]
    rows = markup.tokens(spark.createDataFrame(pages, "page_id int, html string")).collect()
    shown = {d: [(r["role"], r["kind"], r["name"]) for r in rows if r["doc_id"] == d] for d in range(1, 8)}
    assert shown[1] == shown[2] == [] and [k for _, k, _ in shown[3]] == ["text"] * 3
    assert shown[4] == [("open", "element", "p"), ("leaf", "text", ""), ("leaf", "element", "br"), ("leaf", "element", "img"), ("close", "element", "p")]
    assert shown[5] == [("leaf", "raw", "script"), ("open", "element", "style"), ("leaf", "text", "")]
    assert [k for _, k, _ in shown[6]] == ["other"] * 3 and [r for r, *_ in shown[7]] == ["open", "leaf"]
    assert all("".join(r["text"] for r in rows if r["doc_id"] == d) == (t or "") for d, t in pages)


def test_no_pages(spark):
    empty = markup.tokens(spark.createDataFrame([], "page_id int, html string"))
    tree = trees.nodes(empty)
    assert not tree.collect() and not trees.ancestors(tree).collect() and not trees.unwrapped(tree, F.lit(True)).collect() and not trees.lists(tree, F.lit(True)).collect()


def test_scopes_equal_a_stack(spark):
    r, rows, want = random.Random(4), [], []
    for d in range(40):
        stack = [{}]
        for i in range(r.randint(0, 80)):
            kind, name = r.choice(("open", "close", "def", "provide", "use", "use")), r.choice("xy")
            rows.append((d, i, kind, name, f"v{i}"))
            seen = next((s[name] for s in reversed(stack) if name in s), None)
            if kind == "open":
                stack.append({})
            elif kind == "close":
                stack = stack[:-1] or [{}] if len(stack) > 1 else stack
            elif kind == "def" or (kind == "provide" and seen is None):
                stack[-1][name] = i
            elif kind == "use":
                want.append((d, i, name, None if seen is None else f"v{seen}", seen))
    out = scopes.looked_up(spark.createDataFrame(rows, "doc_id int, seq int, kind string, name string, value string"))
    assert Counter(tuple(x) for x in out.collect()) == Counter(want) and len({x[4] for x in want}) > 20
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_splices_equal_recursion(spark):
    r = random.Random(5)
    files = {f"f{i}.tex" if i % 2 else f"f{i}": [(p, *((None, f"f{r.randint(0, 9)}" + r.choice(("", ".tex"))) if r.random() < 0.35 else (f"t{i}.{p}", None))) for p in range(r.randint(0, 4))] for i in range(9)}

    def walk(file, opened):
        for _, text, include in files[file]:
            target = next((n for n in (include, f"{include}.tex") if n in files), None)
            if include is None:
                yield file, text, len(opened), None
            elif target is None or target in opened:
                yield file, None, len(opened), "missing" if target is None else "cycle"
            else:
                yield from walk(target, [*opened, target])

    want = [(f, i + 1, *x) for f in files for i, x in enumerate(walk(f, [f]))]
    lines = spark.createDataFrame([(f, *x) for f, xs in files.items() for x in xs], "file string, pos int, text string, include string")
    listing = spark.createDataFrame([(f,) for f in files], "file string")
    out = includes.spliced(includes.resolved(lines, listing), listing)
    assert Counter((x["root"], x["line"], x["file"], x["text"], x["depth"], x["error"]) for x in out.collect()) == Counter(want) and {x[5] for x in want} == {None, "missing", "cycle"}


def test_functions_in_sql(spark):
    sql.register(spark)
    shown = spark.sql("SELECT fmt_extra_year(n) AS x FROM VALUES (-1L), (0L), (25L), (26L), (701L), (702L) v(n)").collect()
    assert [r["x"] for r in shown] == ["", "a", "z", "aa", "zz", "aaa"]
    row = spark.sql("SELECT tex_ligatures('?`a''') AS a, fmt_sep_by('', 'b', '-') AS b, fmt_end_with_dot('c.') AS c, anchor_id('main', array(0L, 0L)) AS d, xml_escape(NULL) AS e").first()
    assert tuple(row) == ("¿a’", "b", "c.", "sec-", None)
    plan = spark.range(3).selectExpr("fmt_wrap(CAST(id AS STRING), '(', ')') AS x")._jdf.queryExecution().optimizedPlan().toString()
    assert "fmt_wrap" not in plan and "concat" in plan
