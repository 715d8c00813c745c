"""Queries of the pattern language over traces and conversations, and their SQL."""

from __future__ import annotations

from ..plans.formula import Evaluator, Pred
from ..plans.patterns import compiled
from ..sources import graphs as G
from .algebra import EVENTS, TREE, out

QUERIES: dict = {}
SQL: dict[str, str] = {}

CHATS = """WITH ev AS (SELECT conv_id AS g, turn AS s, role AS label, turn AS pos, text, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS nxt FROM conversations)"""
#: One b after a, with nothing of `not_between` in between.
_GAP = """ SELECT g AS graph_id, s AS state FROM ev a WHERE {a} AND EXISTS (SELECT 1 FROM ev b WHERE b.g = a.g AND b.pos > a.pos AND {b} AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.g = a.g AND c.pos > a.pos AND c.pos < b.pos AND {c}))"""


def gap(a: str, b: str, c: str) -> str:
    return EVENTS + _GAP.format(a=a.replace("L", "a.label"), b=b.replace("L", "b.label"), c=c.replace("L", "c.label"))


def pattern(name: str, text: str, sql: str, graph=G.events, exists: bool = False, stop: Pred | None = None) -> None:
    def run(spark, d):
        return out(Evaluator(graph(spark, d)).run(compiled(text, exists, stop)))

    QUERIES[name], SQL[name] = run, sql


_NEXT = EVENTS + " SELECT a.g AS graph_id, a.s AS state{more} FROM ev a JOIN ev b ON a.g = b.g AND a.nxt = b.s WHERE {w}"
pattern("q_seq", "error; view", _NEXT.format(more="", w="a.label = 'error' AND b.label = 'view'"))
pattern("q_seq_bindings", "error{x=k}; view{y=k}", _NEXT.format(more=", a.k AS x, b.k AS y", w="a.label = 'error' AND b.label = 'view' AND a.k IS NOT NULL AND b.k IS NOT NULL"))
pattern("q_dots", "error ... purchase", gap("L = 'error'", "L = 'purchase'", "L IN ('error', 'purchase')"))
pattern("q_when_not", "error ... when != signup purchase", gap("L = 'error'", "L = 'purchase'", "L IN ('error', 'purchase', 'signup')"))
pattern("q_when_eq", "error ... when == [value > 20] purchase", gap("L = 'error'", "L = 'purchase'", "(L IN ('error', 'purchase') OR NOT coalesce(value > 20, false))"))
pattern("q_when_any", "error ... when any purchase", gap("L = 'error'", "L = 'purchase'", "false"))
pattern("q_when_strict", "view ... when strict purchase", gap("L = 'view'", "L = 'purchase'", "L IN ('view', 'purchase')"), stop=Pred("label = 'error'"))
pattern("q_when_exists", "error ... when exists purchase", gap("L = 'error'", "L = 'purchase'", "L IN ('error', 'purchase')"))
pattern("q_when_forall", "[label = 'customer'] ... when forall [flag = 'R']", TREE + """, low AS (SELECT src, bool_and(coalesce(flag = 'R', false)) AS h FROM te JOIN tn ON te.dst = tn.s WHERE src LIKE 'O%' GROUP BY src)
  SELECT DISTINCT o.g AS graph_id, o.parent AS state FROM tn o JOIN low ON o.s = low.src WHERE h""", graph=G.hierarchy, exists=True)
pattern("q_stop_early", "view ... purchase", gap("L = 'view'", "L IN ('purchase', 'error')", "L IN ('view', 'purchase', 'error')"), stop=Pred("label = 'error'"))
pattern("q_nest0", "signup <... view ...> when != click purchase", gap("L = 'signup'", "L = 'purchase'", "L NOT IN ('error', 'view')").replace("c.label NOT IN ('error', 'view')", "c.label IN ('click', 'purchase', 'signup')"))
pattern("q_nest1", "signup <+... view ...+> when != click purchase", EVENTS + """ SELECT g AS graph_id, s AS state FROM ev a WHERE label = 'signup' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.g = a.g AND b.pos > a.pos AND b.label = 'purchase' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.g = a.g AND c.pos > a.pos AND c.pos < b.pos AND c.label IN ('click', 'purchase', 'signup'))
    AND EXISTS (SELECT 1 FROM ev c WHERE c.g = a.g AND c.pos > a.pos AND c.pos < b.pos AND c.label = 'view'))""")
pattern("q_disj", "(error | click); (view | purchase)", _NEXT.format(more="", w="a.label IN ('error', 'click') AND b.label IN ('view', 'purchase')"))
pattern("q_conj", "(error & [value > 50]); view", _NEXT.format(more="", w="a.label = 'error' AND a.value > 50 AND b.label = 'view'"))
pattern("q_opt", "error; ?view; purchase", EVENTS + """ SELECT a.g AS graph_id, a.s AS state FROM ev a JOIN ev b ON a.g = b.g AND a.nxt = b.s JOIN ev c ON c.g = b.g AND b.nxt = c.s
  WHERE a.label = 'error' AND (b.label = 'purchase' OR (b.label = 'view' AND c.label = 'purchase'))""")
pattern("q_exists_rule", "[label = 'order']; [flag = 'R']", TREE + " SELECT DISTINCT te.g AS graph_id, src AS state FROM te JOIN tn ON te.dst = tn.s WHERE flag = 'R' AND src LIKE 'O%'", graph=G.hierarchy, exists=True)
pattern("q_forall_rule", "[label = 'order']; [flag = 'R']", TREE + " SELECT te.g AS graph_id, src AS state FROM te JOIN tn ON te.dst = tn.s WHERE src LIKE 'O%' GROUP BY te.g, src HAVING bool_and(coalesce(flag = 'R', false))", graph=G.hierarchy)
pattern("q_expr", "[text like '%the%']; [role_is = 'assistant']".replace("role_is", "label"), CHATS + " SELECT a.g AS graph_id, a.s AS state FROM ev a JOIN ev b ON a.g = b.g AND a.nxt = b.s WHERE a.text LIKE '%the%' AND b.label = 'assistant'", graph=G.conversations)
pattern("q_member", "[label = 'signup' and value > 95] ... [label = 'purchase' and value > 90]", EVENTS + """ SELECT g AS graph_id, s AS state FROM ev a WHERE label = 'signup' AND value > 95 AND EXISTS (
  SELECT 1 FROM ev b WHERE b.g = a.g AND b.pos > a.pos AND b.label = 'purchase' AND b.value > 90 AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.g = a.g AND c.pos > a.pos AND c.pos < b.pos AND ((c.label = 'signup' AND c.value > 95) OR (c.label = 'purchase' AND c.value > 90))))""")
