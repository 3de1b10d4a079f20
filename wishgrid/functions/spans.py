"""SQL expressions for matches in text: spans, arbitration, gaps, numbers.

A rule pack is data; one expression text is made from it and handed to Spark as a whole, which
keeps plans with a hundred patterns quick to build. Offsets are 0-based and half-open. A match is
``struct<rule, s, e, hit, g>`` with ``g`` the captured groups (NULL where a group took no part).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

MATCHES = "array<struct<rule:string,s:int,e:int,hit:string,g:array<string>>>"
SPANS = "array<struct<s:int,e:int>>"
NO_SPANS = f"cast(array() as {SPANS})"
NO_TEXTS = "cast(array() as array<string>)"


MARK = "\x01"


def unmarked(text: str) -> str:
    """The text with the mark replaced by a space: same length, same offsets."""
    return f"translate({text}, '{MARK}', ' ')"


@dataclass(frozen=True)
class Rule:
    """One pattern of a pack: a name, a Java regular expression, its number of groups."""

    name: str
    pattern: str
    groups: int = 0


def lit(pattern: str) -> str:
    """A regular expression as a raw SQL literal, with Unicode classes switched on."""
    return f"r'(?U){pattern}'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once under ``name``; plain text inside a lambda would be re-evaluated."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _needles(parsed) -> list[set[str]]:
    """Sets of literals, of each of which a match of the parsed pattern holds at least one."""
    found, run = [], ""
    for op, arg in parsed:
        if str(op) == "LITERAL":
            run += chr(arg)
            continue
        found, run = found + ([{run}] if run else []), ""
        inner: list[set[str]] = []
        if str(op) == "SUBPATTERN":
            inner = _needles(arg[3])
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _needles(arg[2])
        elif str(op) == "BRANCH":
            best = [max(_needles(b), key=lambda n: min(map(len, n)), default=None) for b in arg[1]]
            inner = [set().union(*best)] if all(best) else []
        elif str(op) == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            inner = [{chr(a) for _, a in arg}]
        found += inner
    return found + ([{run}] if run else [])


@cache
def needles(pattern: str) -> tuple[tuple[str, ...], ...]:
    """At most two sets of literals that a match must hold one of each of, the longest literals first.

    Empty where the pattern ignores case or has none.
    """
    if re.search(r"\(\?[a-zA-Z]", pattern):
        return ()
    sets = {tuple(sorted(n)) for n in _needles(re._parser.parse(pattern))}
    plain = [n for n in sets if not any("'" in x or "\\" in x for x in n)]
    return tuple(sorted(plain, key=lambda n: (-min(map(len, n)), len(n), n))[:2])


def occurs(text: str, pattern: str) -> str:
    """Whether the pattern matches anywhere; texts without its literals are not searched."""
    return " and ".join([*_held(text, pattern), f"rlike({text}, {lit(pattern)})"])


def _held(text: str, pattern: str) -> list[str]:
    return ["(" + " or ".join(f"contains({text}, '{x}')" for x in n) + ")" for n in needles(pattern)]


def match_spans(text: str, rule: Rule) -> str:
    """Every match of one rule, left to right.

    Only texts that hold the literals of the pattern are searched, and once: every match is replaced by itself and its
    groups between marks, so the pieces between marks are, in turns, the text before a match, the match and its groups;
    their lengths give the offsets. The text must not contain the mark (see ``unmarked``).
    """
    step = rule.groups + 2
    kept = MARK.join(f"${g}" for g in range(rule.groups + 1))
    marked = f"split(regexp_replace({text}, {lit(rule.pattern)}, '{MARK}{kept}{MARK}'), '{MARK}', -1)"
    groups = ", ".join(f"nullif(get(mp, i + {g + 1}), '')" for g in range(rule.groups)) or "cast(null as string)"
    start, end = "acc.pos + length(get(mp, i - 1))", "acc.pos + length(get(mp, i - 1)) + length(get(mp, i))"
    item = f"named_struct('rule', '{rule.name}', 's', {start}, 'e', {end}, 'hit', get(mp, i), 'g', array({groups}))"
    every = (
        f"aggregate(sequence(1, size(mp) - {step}, {step}), named_struct('pos', 0, 'out', cast(array() as {MATCHES})),"
        f" (acc, i) -> named_struct('pos', {end}, 'out', array_append(acc.out, {item})), acc -> acc.out)"
    )
    none = f"cast(array() as {MATCHES})"
    found = let(marked, "mp", f"case when size(mp) > {step} then {every} else {none} end")
    held = " and ".join([f"{text} is not null", *_held(text, rule.pattern)])
    return f"case when {held} then {found} else {none} end"


def scan(text: str, rules: list[Rule]) -> str:
    """All matches of a pack: in rule order, then left to right."""
    return f"flatten(array({', '.join(match_spans(text, r) for r in rules)}))"


def arbitrate(matches: str, blocked: str = NO_SPANS) -> str:
    """Keep a match only if it overlaps neither a kept one nor a ``blocked`` span.

    ``matches`` is any array of structs with ``s`` and ``e``, already in priority order.
    """
    return let(
        matches,
        "am",
        f"aggregate(am, named_struct('taken', {blocked}, 'kept', filter(am, z -> false)),"
        " (acc, m) -> case when exists(acc.taken, t -> t.s < m.e and m.s < t.e) then acc else"
        " named_struct('taken', array_append(acc.taken, named_struct('s', m.s, 'e', m.e)),"
        " 'kept', array_append(acc.kept, m)) end, acc -> acc.kept)",
    )


def spans_of(matches: str) -> str:
    return f"transform({matches}, sp -> named_struct('s', sp.s, 'e', sp.e))"


def overlaps_any(start: str, end: str, spans: str) -> str:
    return f"exists({spans}, ov -> ov.s < {end} and {start} < ov.e)"


def cut(text: str, start: str, end: str) -> str:
    return f"substring({text}, {start} + 1, {end} - {start})"


def blank_spans(text: str, spans: str) -> str:
    """Replace every span by spaces of the same length."""
    return (
        f"aggregate({spans}, {text}, (bt, bs) -> concat(substring(bt, 1, bs.s),"
        " repeat(' ', bs.e - bs.s), substring(bt, bs.e + 1, length(bt))))"
    )


def merge_spans(spans: str) -> str:
    """Sorted union; touching spans are joined."""
    last = "element_at(acc, -1)"
    return (
        f"aggregate(array_sort({spans}), {NO_SPANS}, (acc, x) -> case when size(acc) = 0 then array_append(acc, x)"
        f" when x.s <= {last}.e then array_append(slice(acc, 1, size(acc) - 1),"
        f" named_struct('s', {last}.s, 'e', greatest({last}.e, x.e))) else array_append(acc, x) end)"
    )


def gaps_of(text: str, merged: str) -> str:
    """Spans that a sorted, merged span list leaves uncovered."""
    return let(
        merged,
        "mg",
        f"filter(transform(sequence(0, size(mg)), gi -> named_struct('s', case when gi = 0 then 0 else mg[gi - 1].e end,"
        f" 'e', case when gi = size(mg) then length({text}) else mg[gi].s end)), gp -> gp.e > gp.s)",
    )


# --- E2: numbers ------------------------------------------------------------------------------

WALK_METRES_PER_MINUTE = 80  # fixed value


def number(raw: str) -> str:
    """``15 000 000`` or ``1,5`` as DOUBLE."""
    return f"try_cast(translate(regexp_replace({raw}, r'(?U)[\\s\\xa0\\u202f]', ''), ',', '.') as double)"


def rounded(value: str) -> str:
    """Half-even rounding to a whole number."""
    return f"cast(bround({value}, 0) as bigint)"


def distance_m(raw: str, unit: str) -> str:
    """Metres from a value, or the upper bound of a range, in km, m or walking minutes."""
    upper = f"trim(element_at(split({raw}, '[-–—]'), -1))"
    factor = (
        f"case when startswith({unit}, 'км') or startswith({unit}, 'километр') then 1000"
        f" when startswith({unit}, 'минут') then {WALK_METRES_PER_MINUTE} else 1 end"
    )
    return f"cast(bround({number(upper)} * {factor}, 0) as int)"
