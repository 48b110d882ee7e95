"""Boolean trigram queries derived from regexes.

A query is True (no condition), a trigram, ("and", parts) or ("or", parts). It holds for every text
that the regex can match, once A-Z in the text is lower-cased; the reverse need not be so.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

Query = bool | str | tuple


def _join(op: str, parts: list[Query]) -> Query:
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat: list[Query] = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == op else (p,):
            if q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _grams(run: str) -> list[Query]:
    return [run[i : i + 3] for i in range(len(run) - 2)]


#: How many exact strings are followed at once; beyond that a run is closed and a new one begins.
ALTERNATIVES = 64


def _times(a: set[str], b: set[str] | None) -> set[str] | None:
    return {x + y for x in a for y in b} if b is not None and len(a) * len(b) <= ALTERNATIVES else None


def _exact(item: tuple) -> set[str] | None:
    """The strings (A-Z lower-cased) that a node matches, if they are few and of ASCII, else None."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        return {chr(a).lower() for _, a in arg} if all(o is sre.LITERAL and a < 128 for o, a in arg) else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.ATOMIC_GROUP:
        return _sequence(arg)
    if op is sre.BRANCH:
        found = [_sequence(b) for b in arg[1]]
        return set().union(*found) if None not in found and sum(map(len, found)) <= ALTERNATIVES else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        inner = _sequence(body)
        if inner is None or most > 4:
            return None
        out, power = set(), {""}
        for n in range(most + 1):
            out |= power if n >= least else set()
            if n < most and (power := _times(power, inner)) is None:
                return None
        return out if len(out) <= ALTERNATIVES else None
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # they take no character
        return {""}
    return None


def _sequence(items) -> set[str] | None:
    out: set[str] | None = {""}
    for item in items:
        if (out := _times(out, _exact(item))) is None:
            return None
    return out


def _of(items) -> Query:
    parts: list[Query] = []
    runs = {""}

    def close() -> None:
        nonlocal runs
        parts.append(_join("or", [_join("and", _grams(r)) for r in sorted(runs)]))
        runs = {""}

    for item in items:
        op, arg = item
        if (found := _exact(item)) is not None:
            if (longer := _times(runs, found)) is None:
                close()
                longer = found
            runs = longer
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, _, body = arg
            inner = _sequence(body)
            for _ in range(min(least, 4) if inner else 0):
                if (longer := _times(runs, inner)) is None:
                    break
                runs = longer
            close()
            if least and inner is None:
                parts.append(_of(list(body)))
        else:
            close()
            if op is sre.SUBPATTERN:
                parts.append(_of(list(arg[-1])))
            elif op is sre.ATOMIC_GROUP:
                parts.append(_of(list(arg)))
            elif op is sre.BRANCH:
                parts.append(_join("or", [_of(b) for b in arg[1]]))
    close()
    return _join("and", parts)


def conjunctions(q: Query, most: int = ALTERNATIVES) -> list[frozenset[str]] | None:
    """The query as a union of intersections of postings; None for no condition. Where there would be more than `most`, a part is left out,
    so that the union holds for more texts, never for fewer."""
    if q is True:
        return None
    if isinstance(q, str):
        return [frozenset([q])]
    found = [conjunctions(p, most) for p in q[1]]
    if q[0] == "or":
        out = None if None in found else [c for f in found for c in f]
    else:
        out = [frozenset()]
        for f in sorted((f for f in found if f is not None), key=len):
            if len(out) * len(f) <= most:
                out = [a | b for a in out for b in f]
    if out is None or frozenset() in out:
        return None
    # what holds a larger intersection holds the smaller one
    out = [c for c in dict.fromkeys(out) if not any(o < c for o in out)]
    return sorted(out, key=sorted) if len(out) <= most else None


def query(regex: str) -> Query:
    """The query of a regex (of the syntax that Java and Python share)."""
    return _of(list(_parser.parse(regex)))


def slim(union: list[frozenset[str]] | None, postings: int = 4) -> list[frozenset[str]] | None:
    """At most so many postings of each intersection, those with fewest letters first, as these are rare in prose. It holds for more texts, never for fewer."""
    if union is None:
        return None
    few = [frozenset(sorted(c, key=lambda g: (sum(map(str.isalpha, g)), g))[:postings]) for c in union]
    return sorted((c for c in dict.fromkeys(few) if not any(o < c for o in few)), key=sorted)


def vocabulary(*unions: list[frozenset[str]] | None) -> list[str]:
    """All trigrams that some intersection names, sorted."""
    return sorted({g for union in unions for c in union or () for g in c})
