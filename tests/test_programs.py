"""The front end for C: odd sources, flow graphs, patterns and rewrites."""

import pytest

from pathloom.operators.terms import pattern
from pathloom.plans.rewrites import expanded
from pathloom.sources import csource

SOURCE = """#include <a.h>
int g;
/* c */ static int f(int a, char *b) {
  int x = 1, *y; struct s *p = get(a);
  if (a > 1 && !x) { free(p); return 1; } else x = 2;
  while (x < 5) { if (x == 3) break; x++; continue; }
  for (x = 0; x < 3; x++) use(p->q[x], "s;{");
  do { x -= 1; } while (x);
  switch (a) { case 1: x = 1; break; case 2: x = 2; default: y = 0; }
  if (!p) goto out;
  out: free(p);
  return x ? a : 0;
}
int bad(int a) { a + ; }
void h() { foo(); }
"""


def test_elements():
    found = list(csource.elements(SOURCE))
    assert [(k, n) for k, n, _, _ in found] == [("other", "int g"), ("function", "f"), ("opaque", "bad"), ("function", "h")]
    assert [x.kind for x in found[3][3].nodes] == ["top", "header", "open", "expr", "close", "exit"]


def test_every_node_has_a_successor_and_is_reached():
    for _, _, _, b in csource.elements(SOURCE):
        if b:
            sources, targets = {a for a, _, _ in b.edges}, {c for _, c, _ in b.edges}
            assert all(n.id in sources for n in b.nodes)
            # What follows a jump is dead: the brace after a return, a loop's way on after a continue.
            assert {n.kind for n in b.nodes if n.id not in targets} <= {"top", "close", "after"}


def test_breaks_leave_their_loop():
    b = next(b for k, n, _, b in csource.elements(SOURCE) if n == "f")
    by = {n.id: n for n in b.nodes}
    for n in b.nodes:
        if n.kind == "break":
            assert {by[c].kind for a, c, _ in b.edges if a == n.id} == {"after"}
            assert n.labels[: len(n.outer)] == n.outer


@pytest.mark.parametrize("text", ["a +", "f(a", ")", "a b"])
def test_bad_patterns(text):
    with pytest.raises((csource.SyntaxProblem, IndexError)):
        pattern(text)


def test_rewrites_are_applied_once_in_order():
    assert [t.text for t in expanded(pattern("!p"))] == ["!p", "p == NULL", "NULL == p"]
    assert [t.text for t in expanded(pattern("a + b"), only=["commute sum"])] == ["a + b", "b + a"]
    assert {t.text for t in expanded(pattern("i++"), only=["increment"])} == {"i++", "++i", "i += 1", "i = i + 1"}
    assert [t.text for t in expanded(pattern("a < b"), only=["commute sum"])] == ["a < b"]


def test_odd_files(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "}}} ((("), ("d", "int f() { return 1; ")], "path string, text string")
    rows = csource.parsed(files).collect()
    assert {r.kind for r in rows if r.path == "d"} == {"opaque"} and not [r for r in rows if r.path in "ab"]


A = """int f(int a, struct s *p) {
  int x = 3;
  p = alloc(a);
  if (!p)
    return 0;
  while (x < 10) {
    use(p, x);
    x = x + 1;
  }
  free(p);
  return x;
}
"""
CHANGE = """@@ expression E, X; @@
  E = alloc(X);
- if (!E)
-   return 0;
+ check(E);
  ...
- free(E);
+ release(E);
+ E = 0;
"""


def test_patch_edits_what_it_matches(spark):
    from pathloom.operators.relation import cut
    from pathloom.plans import patches, rules

    files = spark.createDataFrame([("A", A), ("B", A.replace("free(p)", "free(q)")), ("C", "")], "path string, text string")
    texts = files.withColumnRenamed("path", "file")
    found = patches.matches(csource.program(cut(csource.parsed(files))), CHANGE, exists=True)
    assert [tuple(r) for r in found.bindings().collect()] == [("A#0", 4, "p", "a")]
    after = {r.file: r.text for r in rules.applied(texts, found.edits(texts)).collect()}
    assert after["A"] == A.replace("  if (!p)\n    return 0;", "    check(p);").replace("free(p);", "release(p);\n  p = 0;")
    assert after["B"] == A.replace("free(p)", "free(q)") and after["C"] == ""


@pytest.mark.parametrize("text", ["@@ expression E; @@\n- f(E\n+ g(E);", "@@ thing E; @@\nf(E);", "@@ expression E; @@\nif (E\n- )\n  f(E);", "@@ @@\n+ f();", "@@ @@\n... when never\nf();"])
def test_bad_patches(text):
    from pathloom.plans import patches

    with pytest.raises((csource.SyntaxProblem, IndexError)):
        patches.read(text)


def test_until_goes_on_where_the_guard_brings_variables(spark):
    from pyspark.sql import functions as F

    from pathloom.operators import paths as P
    from pathloom.operators import triples as T
    from pathloom.operators.relation import Graph

    nodes = spark.createDataFrame([("g", n, "c" if n == 3 else "a", "x" if n == 1 else "y") for n in range(4)], "graph_id string, node_id int, label string, v string")
    edges = spark.createDataFrame([("g", n, min(n + 1, 3), "Direct") for n in range(4)], "graph_id string, src int, dst int, edge_kind string")
    g = Graph(nodes, edges)
    guard = T.complement(g.states(), T.label_scan(g, F.lit(True), {"w": F.when(F.col("label") == "a", "k").otherwise("m")}))
    found = P.eu(g, guard, T.label_scan(g, F.col("label") == "c"))
    assert sorted({r.state for r in found.df.collect()}) == [0, 1, 2, 3]


def test_functions_alike_but_for_their_names_are_looked_at_once(spark):
    from pathloom.operators.relation import cut
    from pathloom.plans.patches import matches

    texts = {"A": A, "B": "int g;\n\n/* { */ " + A.replace("f(", "longer("), "C": A.replace("int f", "\n  int  h") + "int last;\n", "D": A.replace("use", "take")}
    files = spark.createDataFrame(list(texts.items()), "path string, text string").coalesce(1)
    rows = cut(csource.parsed(files))
    assert rows.where("kind = 'function'").count() == 4 and rows.where("nodes is not null").count() == 2
    p = csource.program(rows)
    assert p.once.graph.nodes.select("graph_id").distinct().count() == 2
    places = {(r.graph_id.split("#")[0], r.node_id): r for r in p.graph.nodes.collect()}
    terms = p.terms.where("start is not null").collect()
    for path, text in texts.items():
        b = next(b for _, _, _, b in csource.elements(text) if b)
        for n in b.nodes:
            r = places[path, n.id]
            assert (r.kind, r.line, r.text, r.start, r.stop) == (n.kind, n.line, n.text, n.start, n.stop)
        own = [t for t in terms if t.graph_id.startswith(path)]
        assert own and all(text[t.start : t.stop] == t.text for t in own if t.kind == "ident")
    found = {r.graph_id[0]: r.node_id for r in matches(p, "@@ expression E; @@\nuse(E, x);").bindings().collect()}
    assert set(found) == {"A", "B", "C"}
    heads = {r.graph_id[0] for r in matches(p, "@@ expression E; @@\nint h(...) { ... use(E, x); ... }", exists=True).bindings().collect()}
    assert heads == {"C"}


def test_files_alike_but_for_names_are_parsed_once(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    heads = ["int {n}(int a, struct s *p) {b}", "static struct s *{n}(void)\n{b}", "int x; long {n}(int if_) {b}", "  int {n}(int a) {b}", "/* é\nint {n}(int a) { */ int g;", 'char *s = "\nint {n}(a) {";', "int {n}(int a) { if; }", "void {n}( {{ if; }}", "éint {n}(int a) {b}", "int {n}(int a /* ( */) {b}", "int g_{n};"]
    bodies = ["{ return a; }", "{\n  free(p);\n}", "{\nelse_(x);\nelse if (a) { b(); }\n}", "{\nint inner(a) { return 1; }\n}", "{\nreturn call(a) {\n}"]
    names = ["f", "longer_name", "x9", "whiles"]
    texts = {f"t{i}": "#include <a>\n" + "\n".join(rnd.choice(heads).replace("{n}", rnd.choice(names)).replace("{b}", rnd.choice(bodies)) for _ in range(rnd.randint(0, 4))) for i in range(300)} | {"none": None}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    p = csource.read(files)
    found: dict = {}
    for r in p.elements.collect():
        found.setdefault(r.path, []).append((r.element, r.kind, r.name, r.line))
    for path, text in texts.items():
        assert sorted(found.get(path, [])) == [(i, k, n, line) for i, (k, n, line, _) in enumerate(csource.elements(text or ""))]
    direct = csource.program(csource.parsed(files))
    for a, b in ((p.graph.nodes, direct.graph.nodes), (p.graph.edges, direct.graph.edges), (p.terms, direct.terms)):
        ours, theirs = (sorted(map(str, df.select(*a.columns).collect())) for df in (a, b))
        assert ours == theirs and ours
    given = []
    monkeypatch.setattr(csource, "_all_rows", lambda files, outlines, f=csource._all_rows: given.append(files) or f(files, outlines))
    alike = spark.range(500).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("int g;\nint f"), "id", F.lit("(int a) { return a; }\n")).alias("text"))
    assert csource.read(alike).graph.nodes.where("kind = 'return'").count() == 500
    assert [g.count() for g in given] == [1]


def test_a_return_without_value_fits_the_last_brace_where_it_is_absent(spark):
    from pathloom.operators.relation import cut
    from pathloom.plans import patches, rules

    bodies = {
        "falls": "  foo();",
        "empty": "",
        "some ways": "  if (a)\n    return;\n  foo();",
        "no way": "  if (a) { return; } else { return; }",
        "value": "  return 1;",
        "nested": "  { foo(); }",
        "nested return": "  { { return 1; } }",
        "branch": "  if (a) { foo(); }",
        "loop": "  do { return 1; } while (a);",
        "cases": "  switch (a) { case 1: return 1; break; default: foo(); }",
        "dead": "  return 1;\n  foo();",
        "back": "  again: foo();\n  goto again;",
    }
    texts = {k: f"void f(int a) {{\n{b}\n}}\n" for k, b in bodies.items()}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    program = csource.program(cut(csource.parsed(files)))
    nodes = {(r.graph_id, r.node_id): r.kind for r in program.graph.nodes.collect()}

    def found(text, **how):
        out = {}
        for r in patches.matches(program, text, **how).bindings().collect():
            out.setdefault(r.graph_id.split("#")[0], []).append(nodes[r.graph_id, r.node_id])
        return {k: sorted(v) for k, v in out.items()}

    ends = {"falls": ["close"], "empty": ["close"], "some ways": ["close", "return"], "no way": ["return"] * 2, "nested": ["close"] * 2, "branch": ["close"], "cases": ["close"], "dead": ["close"]}
    assert found("@@ @@\nreturn;") == ends
    assert set(found("@@ @@\nreturn 1;")) == {"value", "nested return", "loop", "cases", "dead"}
    before = {k: found(f"@@ @@\nfoo();\n{line}return;").keys() for k, line in {"next": "", "gap": "...\n"}.items()}
    assert before == {"next": {"falls", "nested", "some ways", "dead"}, "gap": {"falls", "nested", "some ways", "branch", "cases", "dead"}}

    def edited(text):
        t = files.withColumnRenamed("path", "file")
        return {r.file: r.text for r in rules.applied(t, patches.matches(program, text).edits(t)).collect()}

    after = edited("@@ @@\n- return;\n+ bar();")
    assert after["falls"] == "void f(int a) {\n  foo();\nbar();\n}\n"
    assert after["some ways"] == "void f(int a) {\n  if (a)\n    bar();\n  foo();\nbar();\n}\n"
    assert all(after[k] == texts[k] for k in texts if k not in ends)
    assert edited("@@ @@\n+ bar();\nreturn;")["falls"] == edited("@@ @@\nreturn;\n+ bar();")["falls"] == after["falls"]
    removed = edited("@@ @@\n- return;")
    assert removed["falls"] == texts["falls"] and removed["some ways"] == "void f(int a) {\n  if (a)\n  foo();\n}\n"
    marked = patches.matches(program, "@@ @@\n* return;").marked().collect()
    assert {(r.graph_id.split("#")[0], r.line) for r in marked} >= {("falls", 3), ("some ways", 3), ("some ways", 5)}


def test_q_return_finds_functions_whose_return_is_absent(spark, monkeypatch):
    from pathloom.queries import programs

    bodies = ["foo();", "return 0;", "return x;", "if (x) return; foo();", "if (x) return 0; foo();", "return; foo();", "if (x) { return 1; } else { return 2; }"]
    files = spark.createDataFrame([(str(k), f"int f{k}(int x) {{\n  {b}\n}}\n") for k, b in enumerate(bodies)], "path string, text string")
    monkeypatch.setattr(programs, "_files", lambda spark, d: files)
    assert sorted(r.k for r in programs.QUERIES["q_return"](spark, "").collect()) == [0, 1, 3, 4, 5]
