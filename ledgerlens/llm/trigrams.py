"""Boolean trigram queries of regular expressions.

A query is True (nothing mandatory), a trigram, or ("and" | "or", [queries]). It is derived from the
parsed expression by tracking the set of strings that the part read so far can spell exactly; when that
set grows too large or stops being exact, its trigrams become a condition and only the last two
characters go on. Letters are folded to lower case, as in the index.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

MAX_EXACT = 64
MAX_CLASS = 6


def both(kind: str, parts: list):
    """Simplified conjunction or disjunction."""
    neutral, flat = kind == "and", []
    for p in parts:
        if p is True:
            if not neutral:
                return True
            continue
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q not in flat:
                flat.append(q)
    if not flat:
        return True
    if not neutral:  # a alone already covers a and b
        sets = [set(q[1]) if isinstance(q, tuple) and q[0] == "and" and all(isinstance(x, str) for x in q[1]) else {q} if isinstance(q, str) else None for q in flat]
        flat = [q for q, s in zip(flat, sets) if s is None or not any(t is not None and t < s for t in sets)]
    return flat[0] if len(flat) == 1 else (kind, flat)


def of_strings(strings) -> object:
    """What a text must hold if it holds one of the strings."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def _exact(items) -> set[str] | None:
    """All strings the parsed items can match, if they are few."""
    out = {""}
    for kind, arg in items:
        if kind is op.LITERAL:
            part = {chr(arg).lower()}
        elif kind is op.IN:
            part = set()
            for k, a in arg:
                if k is op.LITERAL:
                    part.add(chr(a).lower())
                elif k is op.RANGE and a[1] - a[0] < 4 * MAX_CLASS:
                    part |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            if len(part) > MAX_CLASS:
                return None
        elif kind is op.SUBPATTERN:
            part = _exact(arg[-1])
        elif kind is op.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 8:
            once = _exact(arg[2])
            if once is None:
                return None
            part, grown = set(), {""}
            for n in range(arg[1] + 1):
                if n >= arg[0]:
                    part |= grown
                grown = {a + b for a in grown for b in once}
                if len(grown) > MAX_EXACT:
                    return None
        else:
            return None
        if part is None or len(out) * len(part) > MAX_EXACT:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(items):
    found, run = [], {""}
    for item in items:
        part = _exact([item])
        if part is not None and len(run) * len(part) <= MAX_EXACT:
            run = {a + b for a in run for b in part}
            continue
        found.append(of_strings(run))
        run = {""}
        if part is not None:
            run = part
            continue
        kind, arg = item
        if kind is op.SUBPATTERN:
            found.append(_query(arg[-1]))
        elif kind is op.BRANCH:
            found.append(both("or", [_query(x) for x in arg[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            once = _exact(list(arg[2]))
            many = once is not None and len({a * arg[0] for a in once}) <= MAX_EXACT and len(once) == 1
            found.append(of_strings({next(iter(once)) * min(arg[0], 32)}) if many else _query(arg[2]))
    found.append(of_strings(run))
    return both("and", found)


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern; True if it has no mandatory trigram."""
    return _query(list(_parser.parse(pattern)))


def vocabulary(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(vocabulary(q) for q in query[1]))


def holds(query, text: str) -> bool:
    """The query on one text, for tests."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

