"""DuckDB SQL that checks greedy structure searches: a recursive query that walks from graph to graph over scored families.

A graph is a list of bit masks, the parents of each variable. All families are scored from the joint counts; a graph has no cycle
if some order of the variables puts every parent before its children.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import prod

from .views import SIZES, view_sql


def _family_sql(names: list[str], c: int, mask: int, ess: float | None) -> str:
    """Log marginal likelihood of one family; ess: rows of a BDeu prior, None for a pseudo-count of 1 in each cell."""
    ps = [n for i, n in enumerate(names) if mask >> i & 1]
    r, q = SIZES[names[c]], prod(SIZES[p] for p in ps)
    a = 1.0 if ess is None else ess / (r * q)
    cells = f"(SELECT sum(n) AS n FROM joint GROUP BY {', '.join([*ps, names[c]])})"
    groups = f"(SELECT sum(n) AS n FROM joint{' GROUP BY ' + ', '.join(ps) if ps else ''})"
    return f"SELECT {c} AS c, {mask} AS m, (SELECT sum(lgamma({a} + n) - lgamma({a})) FROM {cells}) + (SELECT sum(lgamma({r * a}) - lgamma({r * a} + n)) FROM {groups}) AS s"


def _masks(n: int, c: int) -> list[int]:
    others = [i for i in range(n) if i != c]
    return sorted(sum(1 << i for i in ps) for k in range(n) for ps in combinations(others, k))


def _orders(n: int) -> str:
    """Of each order of the variables the masks of those before each."""
    rows = []
    for order in permutations(range(n)):
        before = [sum(1 << x for x in order[: order.index(i)]) for i in range(n)]
        rows.append(f"[{', '.join(map(str, before))}]")
    return f"[{', '.join(rows)}]"


def _changed(n: int, *changes: tuple[int, str]) -> str:
    new = dict(changes)
    return "[" + ", ".join(new.get(i, f"ms[{i + 1}]") for i in range(n)) + "]"


def _moves(n: int, most: int, flips: bool, capped: bool, phased: bool) -> str:
    """Rows (walker, step, phase, old, ms, k) of all single changes of each graph in `graphs`; k: their order. Cycles aren't ruled out yet."""
    out = []
    kind = lambda p: f" AND phase = {p}" if phased else ""
    for c in range(n):
        for p in range(n):
            if p == c:
                continue
            k, mine, less = 2 * (c * n + p), f"ms[{c + 1}]", f"(ms[{c + 1}] & {~(1 << p) & (1 << n) - 1})"
            held, room = f"(({mine} >> {p}) & 1)", lambda i: f"bit_count(ms[{i + 1}]) < {most}"
            row = "SELECT walker, step, phase, ms AS old, {} AS ms, {} AS k FROM graphs WHERE {}"
            out.append(row.format(_changed(n, (c, f"({mine} | {1 << p})")), k, f"{held} = 0 AND {room(c)}{kind(0)}"))
            out.append(row.format(_changed(n, (c, less)), k, f"{held} = 1{kind(1)}"))
            if flips:
                new = _changed(n, (c, less), (p, f"(ms[{p + 1}] | {1 << c})"))
                out.append(row.format(new, k + 1, f"{held} = 1{' AND ' + room(p) if capped else ''}"))
    if phased:  # when nothing gains any more
        out.append(f"SELECT walker, step, phase + 1 AS phase, ms AS old, ms, {2 * n * n} AS k FROM graphs WHERE phase = 0")
    return " UNION ALL ".join(out)


def _walk(name: str, start: str, n: int, most: int, flips: bool, capped: bool, phased: bool) -> str:
    """A recursive table: each walker takes the move that gains most, the first of equals, until none gains."""
    total = lambda ms: " + ".join(f"s[{i + 1}][{ms}[{i + 1}] + 1]" for i in range(n))
    fits = " AND ".join(f"(m.ms[{i + 1}] & b[{i + 1}]) = m.ms[{i + 1}]" for i in range(n))
    return f"""{name} AS ({start} UNION ALL
 SELECT walker, step, phase, ms FROM (
  SELECT *, row_number() OVER (PARTITION BY walker ORDER BY round(gain, 6) DESC, k) AS place FROM (
   SELECT m.walker, m.step + 1 AS step, m.phase, m.ms, m.k, ({total('m.ms')}) - ({total('m.old')}) AS gain
   FROM (WITH graphs AS (SELECT * FROM {name}) {_moves(n, most, flips, capped, phased)}) m, known
   WHERE len(list_filter(orders, lambda b: {fits})) > 0)
  WHERE gain > 1e-7 OR k = {2 * n * n}) WHERE place = 1)"""


def greedy_sql(of: str, names: list[str], *, most: int = 3, ess: float | None = None, flips: bool = True, capped: bool = False, phased: bool = False, scan: bool = False) -> str:
    """parent, child of the graph that a greedy search finds over a view's columns. phased: additions first, then removals.
    scan: from the graph found, every legal edge is added in turn and climbed from; the best end that beats it is taken."""
    n = len(names)
    families = " UNION ALL ".join(_family_sql(names, c, m, ess) for c in range(n) for m in _masks(n, c))
    grid = f"SELECT c, list(s ORDER BY m) AS s FROM (SELECT c.range AS c, m.range AS m, f.s FROM range({n}) c, range({1 << n}) m LEFT JOIN fam f ON f.c = c.range AND f.m = m.range) GROUP BY c"
    rule = (n, most, flips, capped)
    empty = f"SELECT 0 AS walker, 0 AS step, 0 AS phase, [{', '.join(['0'] * n)}] AS ms"
    parts = [
        f"joint AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM {view_sql(of)} GROUP BY ALL)",
        f"fam AS MATERIALIZED ({families})",
        f"known AS MATERIALIZED (SELECT (SELECT list(s ORDER BY c) FROM ({grid})) AS s, {_orders(n)} AS orders)",
        _walk("walk", empty, *rule, phased),
        "ended AS MATERIALIZED (SELECT walker, ms FROM walk ORDER BY step DESC LIMIT 1)",
    ]
    if scan:
        fits = " AND ".join(f"(ms[{i + 1}] & b[{i + 1}]) = ms[{i + 1}]" for i in range(n))
        total = " + ".join(f"s[{i + 1}][ms[{i + 1}] + 1]" for i in range(n))
        added = f"(WITH graphs AS (SELECT walker, 0 AS step, 0 AS phase, ms FROM ended) {_moves(n, most, False, capped, True)})"
        parts += [
            f"begun AS MATERIALIZED (SELECT k AS walker, 0 AS step, 0 AS phase, ms FROM {added}, known WHERE k < {2 * n * n} AND len(list_filter(orders, lambda b: {fits})) > 0)",
            _walk("again", "SELECT * FROM begun", *rule, False),
            "ends AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY walker ORDER BY step DESC) = 1 UNION ALL SELECT -1, 0, 0, ms FROM ended)",
            f"best AS (SELECT ms FROM ends, known ORDER BY round({total}, 6) DESC, walker LIMIT 1)",
        ]
    edges = " UNION ALL ".join(
        f"SELECT '{names[p]}' AS parent, '{names[c]}' AS child FROM {'best' if scan else 'ended'} WHERE ((ms[{c + 1}] >> {p}) & 1) = 1" for c in range(n) for p in range(n) if p != c
    )
    return f"WITH RECURSIVE {', '.join(parts)} {edges}"
