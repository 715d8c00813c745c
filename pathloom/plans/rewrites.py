"""Rewrites of expression patterns into equivalent forms: each rule is applied once, in order, to what is there so far."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from ..operators.terms import pattern
from ..sources.csource import Term


@dataclass(frozen=True)
class Rule:
    """forms: equivalent patterns over the variables X and Y (any term), N (a constant)."""

    name: str
    forms: tuple[str, ...]


#: The equivalences that patterns are read under.
STANDARD = (
    Rule("not null", ("!X", "X == NULL", "NULL == X")),
    Rule("is not null", ("X", "X != NULL")),
    Rule("commute equality", ("X == N", "N == X")),
    Rule("commute sum", ("X + Y", "Y + X")),
    Rule("commute product", ("X * Y", "Y * X")),
    Rule("flip order", ("X < Y", "Y > X")),
    Rule("flip order or equal", ("X <= Y", "Y >= X")),
    Rule("increment", ("X++", "++X", "X += 1", "X = X + 1")),
    Rule("parentheses", ("X", "(X)")),
)


def _same(a: Term, b: Term) -> bool:
    return a.text == b.text and a.kind == b.kind


def _fit(form: Term, term: Term, found: dict[str, Term]) -> dict[str, Term] | None:
    if form.kind == "ident" and form.text in ("X", "Y", "N"):
        if form.text == "N" and term.kind != "constant":
            return None
        if form.text in found:
            return found if _same(found[form.text], term) else None
        return found | {form.text: term}
    if form.kind != term.kind or form.op != term.op or len(form.parts) != len(term.parts) or not form.parts and form.text != term.text:
        return None
    for x, y in zip(form.parts, term.parts):
        got = _fit(x, y, found)
        if got is None:
            return None
        found = got
    return found


def _fill(form: Term, found: dict[str, Term]) -> str:
    if form.kind == "ident" and form.text in found:
        return found[form.text].text
    parts = [_fill(p, found) for p in form.parts]
    if form.kind in ("binary", "assignment"):
        return f"{parts[0]} {form.op} {parts[1]}"
    if form.kind == "unary":
        return form.op + parts[0]
    if form.kind == "postfix":
        return parts[0] + form.op
    if form.kind == "paren":
        return f"({parts[0]})"
    return form.text


def expanded(what: Term, rules: Sequence[Rule] = STANDARD, only: Sequence[str] = ()) -> list[Term]:
    """The pattern and its equivalents at the root, without repeats."""
    out = [what]
    for rule in rules:
        if only and rule.name not in only:
            continue
        forms = [pattern(f) for f in rule.forms]
        for t in list(out):
            for f in forms:
                got = None if f.kind == "ident" else _fit(f, t, {})
                if got is not None:
                    out += [pattern(_fill(g, got)) for g in forms if g is not f]
                    break
    seen: dict[str, Term] = {}
    for t in out:
        seen.setdefault(t.text, replace(t))
    return list(seen.values())
