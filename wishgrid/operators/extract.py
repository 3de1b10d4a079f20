"""Text to criteria: one function per family (E3-E20, E22, E23), each a few columns more.

Every function takes a table with ``norm`` (normalised text) and ``text`` and adds its values and
``<family>_spans``, the spans it understood. All work happens inside the row; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.functions.spans import (
    NO_SPANS,
    Rule,
    arbitrate,
    cut,
    distance_m,
    gaps_of,
    let,
    lit,
    match_spans,
    merge_spans,
    number,
    occurs,
    overlaps_any,
    rounded,
    scan,
    spans_of,
)
from wishgrid.packs import russian as ru


def add(df: DataFrame, **columns: str) -> DataFrame:
    return df.selectExpr("*", *[f"{expr} as {name}" for name, expr in columns.items()])


def texts(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


# --- E3 rooms ---------------------------------------------------------------------------------

ROOM_OF_DIGIT = "case {0} when 1 then 'one' when 2 then 'two' when 0 then null else 'three_plus' end"


def _from_digit(d: str) -> str:
    """Room classes of "d and more"."""
    return (
        f"case when {d} <= 1 then array('one', 'two', 'three_plus') when {d} = 2 then array('two', 'three_plus')"
        f" when {d} = 3 then array('three_plus') else cast(array() as array<string>) end"
    )


def rooms(df: DataFrame) -> DataFrame:
    digits = "transform(regexp_extract_all(m.g[0], r'\\d', 0), d -> cast(d as int))"
    classes = f"array_compact(transform({digits}, d -> {ROOM_OF_DIGIT.format('d')}))"
    stems = {"одн": 1, "дв": 2, "тр": 3, "четыр": 4, "пят": 5}
    of_word = "case " + " ".join(f"when startswith(w, '{s}') then {d}" for s, d in stems.items()) + " else 1 end"
    first = (
        "case when startswith(m.g[0], 'одн') then 1 when m.g[0] = 'двух' then 2 when m.g[0] = 'трех' then 3 else 4 end"
    )
    value = f"""case m.rule
      when 'negated' then cast(array() as array<string>)
      when 'from_word' then {_from_digit(first)}
      when 'cardinal' then array_compact(transform(regexp_extract_all(m.g[0], {lit(ru.CARDINAL)}, 0),
        w -> {ROOM_OF_DIGIT.format(of_word)}))
      when 'digits' then concat({classes}, case when contains(m.hit, '+')
        then {_from_digit(f'element_at({digits}, -1)')} else cast(array() as array<string>) end)
      when 'plus' then {_from_digit('cast(m.g[0] as int)')}
      else array(m.rule) end"""
    valued = (
        f"transform({scan('norm', ru.ROOM_RULES)}, m -> named_struct('rule', m.rule, 's', m.s, 'e', m.e, 'v', {value}))"
    )
    valid = f"filter({valued}, m -> size(m.v) > 0 or m.rule in ('negated', 'from_word'))"
    df = add(df, _kept=arbitrate(valid))
    in_order = "array_sort(_kept, (a, b) -> case when a.s < b.s then -1 when a.s > b.s then 1 else 0 end)"
    df = add(df, rooms=f"array_distinct(flatten(transform({in_order}, m -> m.v)))")
    return add(
        df, rooms_spans=f"case when size(rooms) > 0 then {spans_of('_kept')} else {NO_SPANS} end"
    ).drop("_kept")


# --- E4 price ---------------------------------------------------------------------------------


def _multiplier(unit: str) -> str:
    u = f"regexp_replace({unit}, r'\\.+$', '')"
    return (
        f"case when {unit} is null then null when {u} = 'м' or startswith({u}, 'млн') or startswith({u}, 'миллион')"
        f" or startswith({u}, 'лям') then 1000000 when {u} = 'к' or startswith({u}, 'тыс') then 1000 else 1 end"
    )


def price(df: DataFrame) -> DataFrame:
    n = {i: number(f"m.g[{i}]") for i in range(4)}
    big = ru.RUBLE_THRESHOLD

    def times(num: str, unit: str) -> str:
        return rounded(f"{num} * {unit}")

    u1, u3 = _multiplier("m.g[1]"), _multiplier("m.g[3]")
    u2, u0 = _multiplier("m.g[2]"), _multiplier("m.g[0]")
    budget_unit = (
        f"case when m.g[2] is not null then {u2} when {n[1]} < 1000 then 1000000 else 1 end"
    )
    low = f"""case m.rule
      when 'range' then {times(n[0], f'coalesce({u1}, {u3}, 1)')}
      when 'budget' then case when m.g[0] = 'от' then {times(n[1], budget_unit)} end
      when 'min' then {times(n[0], u1)}
      when 'suffix' then case when m.g[0] = 'от' then {times(n[1], u2)} end
      when 'plain_min' then {rounded(n[0])} end"""
    high = f"""case m.rule
      when 'range' then {times(n[2], f'coalesce({u3}, {u1}, 1)')}
      when 'budget' then case when coalesce(m.g[0], '') <> 'от' then {times(n[1], budget_unit)} end
      when 'unit_first' then {times(n[1], u0)}
      when 'suffix' then case when m.g[0] <> 'от' then {times(n[1], u2)} end
      when 'plain_max' then {rounded(n[0])}
      when 'max' then {times(n[0], u1)}
      when 'for' then {times(n[0], u1)}
      when 'standalone' then {times(n[0], u1)} end"""
    valid = f"""case m.rule
      when 'range' then m.g[1] is not null or m.g[3] is not null or ({n[0]} >= {big} and {n[2]} >= {big})
      when 'budget' then case when m.g[2] is null then not rlike(m.g[1], r'^\\d{{1,2}}[.,]\\d{{2}}$')
          and ({n[1]} < 1000 or {n[1]} >= {big}) else not (m.g[2] = 'к' and {n[1]} < 100) end
      when 'suffix' then not (m.g[2] = 'к' and {n[1]} < 100)
      when 'plain_min' then {n[0]} >= {big}
      when 'plain_max' then {n[0]} >= {big}
      else true end"""
    matches = f"filter({scan('norm', ru.PRICE_RULES)}, m -> {valid})"
    valued = f"transform({matches}, m -> named_struct('s', m.s, 'e', m.e, 'lo', {low}, 'hi', {high}))"
    df = add(df, _kept=arbitrate(valued))
    return add(
        df,
        price_min="array_min(transform(_kept, m -> m.lo))",
        price_max="array_max(transform(_kept, m -> m.hi))",
        price_spans=spans_of("_kept"),
    ).drop("_kept")


# --- E5 area ----------------------------------------------------------------------------------


def area(df: DataFrame) -> DataFrame:
    n = [number(f"m.g[{i}]") for i in range(5)]
    low = f"""case m.rule when 'kitchen' then coalesce({n[0]}, {n[2]}, {n[4]}) when 'keyword' then coalesce({n[0]}, {n[2]}, {n[4]})
      when 'max' then null else coalesce({n[0]}, case when m.rule = 'squares' then {n[1]} end) end"""
    high = f"""case m.rule when 'kitchen' then coalesce({n[1]}, {n[3]}) when 'keyword' then coalesce({n[1]}, {n[3]})
      when 'range' then {n[1]} when 'max' then {n[0]} end"""
    valued = (
        f"transform({scan('norm', ru.AREA_RULES)}, m -> named_struct('s', m.s, 'e', m.e, 'kitchen', m.rule = 'kitchen',"
        f" 'lo', {low}, 'hi', {high}, 'hit', trim(m.hit)))"
    )
    valid = f"filter({valued}, m -> m.lo is not null or m.hi is not null)"
    df = add(df, _kept=arbitrate(valid))

    def first(side: str, kitchen: bool) -> str:
        cond = "m.kitchen" if kitchen else "not m.kitchen"
        return f"get(transform(filter(_kept, m -> {cond} and m.{side} is not null), m -> m.{side}), 0)"

    # The first value wins; a match that says something else is reported.
    df = add(
        df,
        area_min=first("lo", False), area_max=first("hi", False),
        area_kitchen_min=first("lo", True), area_kitchen_max=first("hi", True),
        area_spans=spans_of("_kept"),
    )
    differs = (
        "coalesce(m.lo <> case when m.kitchen then area_kitchen_min else area_min end, false)"
        " or coalesce(m.hi <> case when m.kitchen then area_kitchen_max else area_max end, false)"
    )
    return add(df, area_dropped=f"transform(filter(_kept, m -> {differs}), m -> m.hit)").drop("_kept")


# --- E16 time to transit ------------------------------------------------------------------------


def transit_time(df: DataFrame) -> DataFrame:
    words = ", ".join(f"'{w}', {v}" for w, v in ru.MINUTE_WORDS.items())
    minutes = f"coalesce(try_cast(m.g[0] as int), map({words})[m.g[0]])"
    left = f"regexp_extract(substring(norm, greatest(m.s - {ru.CUE_WINDOW}, 0) + 1, least(m.s, {ru.CUE_WINDOW})), '[^,;.!?()]*$', 0)"
    right = f"regexp_extract(substring(norm, m.e + 1, {ru.CUE_WINDOW}), '^[^,;.!?()]*', 0)"
    window = f"concat({left}, ' ', {right})"
    about_place = let(window, "w", f"not rlike(w, '{ru.METRO_CUE}') and rlike(w, {lit(ru.POI_CUE)})")
    matches = f"filter({scan('norm', ru.TRANSIT_RULES)}, m -> m.rule <> 'foot_free' or not {about_place})"
    valued = f"transform({matches}, m -> named_struct('s', m.s, 'e', m.e, 'foot', m.rule <> 'transport', 'v', {minutes}))"
    df = add(df, _kept=arbitrate(valued))
    return add(
        df,
        time_on_foot="get(transform(filter(_kept, m -> m.foot), m -> m.v), 0)",
        time_on_transport="get(transform(filter(_kept, m -> not m.foot), m -> m.v), 0)",
        time_spans=spans_of("_kept"),
    ).drop("_kept")


# --- E6 floor -----------------------------------------------------------------------------------


def floor(df: DataFrame, blocked: str = NO_SPANS) -> DataFrame:
    """``blocked`` names a column with the spans of the families before."""
    limit = ru.FLOOR_LIMIT
    a = f"coalesce(try_cast(m.g[0] as int), {limit + 1})"
    b = f"coalesce(try_cast(m.g[1] as int), {limit + 1})"
    # One state per text: bounds so far, flags, spans taken (own and foreign) and own spans.
    use = """case m.rule
      when 'range' then m.a <= {0} and m.b <= {0}
      when 'max' then acc.hi is null
      when 'min' then acc.lo is null
      when 'first' then acc.lo is null and acc.hi is null and not acc.nf
      else true end""".format(limit)
    lo = """case when m.rule in ('range', 'min') then coalesce(acc.lo, m.a) when m.rule = 'first' then 1 else acc.lo end"""
    hi = """case when m.rule = 'range' then coalesce(acc.hi, m.b) when m.rule = 'max' then coalesce(acc.hi, m.a)
      when m.rule = 'first' then 1 else acc.hi end"""
    span = "named_struct('s', m.s, 'e', m.e)"
    state = (
        f"named_struct('lo', {lo}, 'hi', {hi}, 'nf', acc.nf or m.rule = 'not_first', 'la', acc.la or m.rule = 'last',"
        f" 'nl', acc.nl or m.rule = 'not_last', 'taken', array_append(acc.taken, {span}), 'own', array_append(acc.own, {span}))"
    )
    free = f"not {overlaps_any('m.s', 'm.e', 'acc.taken')}"
    valued = (
        f"transform({scan('norm', ru.FLOOR_RULES)}, m -> named_struct('rule', m.rule, 's', m.s, 'e', m.e,"
        f" 'a', {a}, 'b', case when m.rule = 'range' then {b} end))"
    )
    init = (
        "named_struct('lo', cast(null as int), 'hi', cast(null as int), 'nf', false, 'la', false, 'nl', false,"
        f" 'taken', {blocked}, 'own', {NO_SPANS})"
    )
    df = add(df, _f=f"aggregate({valued}, {init}, (acc, m) -> case when {free} and {use} then {state} else acc end)")
    return add(
        df,
        floor_min="_f.lo", floor_max="_f.hi", not_first_floor="_f.nf", last_floor="_f.la",
        not_last_floor="_f.nl", floor_spans="_f.own",
    ).drop("_f")


# --- E7, E8 finish and readiness -----------------------------------------------------------------


def finish(df: DataFrame) -> DataFrame:
    hits = let(
        scan("norm", ru.FINISH_RULES),
        "fm",
        "filter(fm, m -> m.rule <> '1' or not exists(fm, c -> c.rule in ('0', '3') and c.s <= m.s and c.e >= m.e))",
    )
    short = f"transform({hits}, m -> named_struct('s', m.s, 'len', m.e - m.s, 'e', m.e, 'v', cast(m.rule as int)))"
    last = "element_at(acc, -1)"
    # A span inside the one before is dropped; one that contains it replaces it.
    nested = (
        f"aggregate(array_sort({short}), filter({short}, z -> false), (acc, c) -> case"
        f" when size(acc) = 0 then array_append(acc, c) when {last}.s <= c.s and {last}.e >= c.e then acc"
        f" when c.s <= {last}.s and c.e >= {last}.e then array_append(slice(acc, 1, size(acc) - 1), c)"
        " else array_append(acc, c) end)"
    )
    df = add(df, _kept=nested)
    mixed = "exists(_kept, m -> m.v = 0) and exists(_kept, m -> m.v <> 0)"
    side = "filter(_kept, m -> (m.v = 0) = (element_at(_kept, -1).v = 0))"
    return add(
        df,
        finish=f"array_distinct(transform(case when {mixed} then {side} else _kept end, m -> m.v))",
        finish_spans=spans_of("_kept"),
        ready=f"case when {occurs('norm', ru.READY.pattern)} then true end",
        ready_spans=spans_of(match_spans("norm", ru.READY)),
    ).drop("_kept")


# --- E9-E15 small families ------------------------------------------------------------------------


def settlement(df: DataFrame, as_of_year: int) -> DataFrame:
    """The first matching form decides; "this year" is the year of ``as_of_year``."""
    df = add(df, _m=f"get({scan('norm', ru.SETTLEMENT_RULES)}, 0)")
    a, b = "cast(_m.g[0] as int)", "cast(_m.g[1] as int)"
    return add(
        df,
        settlement_year_from=f"case _m.rule when 'range' then {a} when 'min' then {a} when 'exact' then {a} when 'this_year' then {as_of_year} end",
        settlement_year_to=f"case _m.rule when 'range' then {b} when 'max' then {a} when 'exact' then {a} when 'this_year' then {as_of_year} end",
        settlement_spans=f"case when _m is not null then array(named_struct('s', _m.s, 'e', _m.e)) else {NO_SPANS} end",
    ).drop("_m")


def sort_order(df: DataFrame) -> DataFrame:
    """The first pattern of the list that occurs."""
    df = add(df, _m=f"get({scan('norm', ru.SORT_RULES)}, 0)")
    return add(
        df,
        sort="_m.rule",
        sort_spans=f"case when _m is not null then array(named_struct('s', _m.s, 'e', _m.e)) else {NO_SPANS} end",
    ).drop("_m")


def required_tags(df: DataFrame) -> DataFrame:
    """E11."""
    df = add(df, _kept=arbitrate(scan("norm", ru.TAG_RULES)))
    return add(
        df, required_tags="array_distinct(transform(_kept, m -> m.rule))", tags_spans=spans_of("_kept")
    ).drop("_kept")


def flags(df: DataFrame) -> DataFrame:
    """E12 and E14."""
    inside, beyond = match_spans("norm", ru.INSIDE_RING), match_spans("norm", ru.BEYOND_RING)
    hit = {r.name: occurs("norm", r.pattern) for r in (ru.FLATS_ONLY, ru.ONLY_AVAILABLE, ru.INSIDE_RING, ru.BEYOND_RING)}
    return add(
        df,
        housing_type=f"case when {hit['flats_only']} then 'flats_only' end",
        housing_spans=spans_of(match_spans("norm", ru.FLATS_ONLY)),
        only_available=hit["only_available"],
        available_spans=spans_of(match_spans("norm", ru.ONLY_AVAILABLE)),
        within_ring=f"case when {hit['inside']} then true when {hit['beyond']} then false end",
        ring_spans=f"case when {hit['inside']} then {spans_of(inside)} else {spans_of(beyond)} end",
    )


def unsupported(df: DataFrame) -> DataFrame:
    """``array<struct<fragment, reason>>`` in text order."""
    items = (
        f"array_sort(transform({scan('norm', ru.UNSUPPORTED_RULES)}, m -> named_struct('s', m.s, 'e', m.e,"
        f" 'fragment', {cut('text', 'm.s', 'm.e')}, 'reason', m.rule)))"
    )
    df = add(df, _u=items)
    return add(
        df,
        unsupported="transform(_u, u -> named_struct('fragment', u.fragment, 'reason', u.reason))",
        unsupported_spans=spans_of("_u"),
    ).drop("_u")


def named_stations(df: DataFrame) -> DataFrame:
    """``station_mentions array<struct<s, e, name>>`` of "near metro X"."""
    hits = match_spans("norm", ru.NAMED_STATION)
    return add(
        df, station_mentions=f"transform({hits}, m -> named_struct('s', m.s, 'e', m.e, 'name', m.g[0]))"
    )


def unmatched_stations(mentions: str, consumed: str) -> str:
    """Names of mentions that no understood span covers."""
    free = f"filter({mentions}, m -> not {overlaps_any('m.s', 'm.e', 'cs')})"
    return let(consumed, "cs", f"transform({free}, m -> m.name)")


def superlative_cue(norm: str = "norm") -> str:
    """E19."""
    return occurs(norm, ru.SUPERLATIVE_CUE)


# --- E17 places of interest -----------------------------------------------------------------------


def poi_requirements(df: DataFrame, blocked: str = NO_SPANS) -> DataFrame:
    """Categories with "new" flag and distance; ``blocked`` are the spans of the families before."""
    hits = arbitrate(scan("norm", [ru.CENTRE, *ru.POI_RULES]))
    df = add(df, _hits=hits)
    tail = let(
        "substring(norm, m.e + 1)",
        "t",
        f"named_struct('seg', regexp_extract(t, {lit(ru.TRAILING_DISTANCE)}, 0),"
        f" 'raw', regexp_extract(t, {lit(ru.TRAILING_DISTANCE)}, 1), 'unit', regexp_extract(t, {lit(ru.TRAILING_DISTANCE)}, 2))",
    )
    item = (
        "named_struct('s', m.s, 'e', m.e, 'seq', i, 'category', m.rule, 'only_new', m.g[0] is not null,"
        f" 'own_m', case when m.g[1] is not null then {distance_m('m.g[1]', 'm.g[2]')} end, 'tail', {tail})"
    )
    # Ordered by position; ``seq`` remembers the order of recognition.
    df = add(
        df,
        center_requested="exists(_hits, m -> m.rule = 'centre')",
        _p=f"array_sort(transform(filter(_hits, m -> m.rule <> 'centre'), (m, i) -> {item}))",
    )
    joined = f"rlike({cut('norm', '_p[i - 1].e', '_p[i].s')}, {lit(ru.ENUMERATION)})"
    # Index of the first member of the enumeration every requirement belongs to.
    df = add(
        df,
        _head=f"aggregate(sequence(0, size(_p)), cast(array() as array<int>), (acc, i) -> case when i >= size(_p) then acc"
        f" when i > 0 and {joined} then array_append(acc, element_at(acc, -1)) else array_append(acc, i) end)",
        _by_seq="array_sort(transform(_p, (m, i) -> named_struct('seq', m.seq, 'pos', i)))",
    )
    tail_m = distance_m("_p[o.pos].tail.raw", "_p[o.pos].tail.unit")
    usable = (
        "acc.d[o.pos] is null and _p[o.pos].tail.seg <> '' and not contains(_p[o.pos].tail.seg, 'метро')"
        " and not contains(_p[o.pos].tail.seg, 'станц')"
    )
    # A trailing distance is shared backwards over the enumeration that ends here.
    spread = f"transform(acc.d, (x, i) -> case when x is null and i <= o.pos and i >= hd[o.pos] then {tail_m} else x end)"
    tail_span = "named_struct('s', _p[o.pos].e, 'e', _p[o.pos].e + length(_p[o.pos].tail.seg))"
    fold = (
        "aggregate(_by_seq, named_struct('d', transform(_p, m -> m.own_m), 'spans', transform(_hits, h -> named_struct('s', h.s, 'e', h.e))),"
        f" (acc, o) -> case when {usable} then named_struct('d', {spread}, 'spans', array_append(acc.spans, {tail_span})) else acc end)"
    )
    df = add(df, _t=let("_head", "hd", fold))
    # A distance in front counts for the first requirement still without one, then for all of them.
    df = add(df, _open="get(filter(sequence(0, size(_p)), i -> i < size(_p) and _t.d[i] is null), 0)")
    head = "substring(norm, 1, _p[_open].s)"
    df = add(
        df,
        _lead=f"case when _open is not null then regexp_extract({head}, {lit(ru.LEADING_DISTANCE)}, 0) end",
        _lead_raw=f"case when _open is not null then regexp_extract({head}, {lit(ru.LEADING_DISTANCE)}, 1) end",
        _lead_unit=f"case when _open is not null then regexp_extract({head}, {lit(ru.LEADING_DISTANCE)}, 2) end",
    )
    start = "_p[_open].s - length(_lead)"
    df = add(
        df,
        _lead_ok="coalesce(_lead <> '' and not contains(_lead, 'метро') and not contains(_lead, 'станц')"
        f" and not {overlaps_any(start, '_p[_open].s', '_t.spans')} and not {overlaps_any(start, '_p[_open].s', blocked)}, false)",
    )
    final = f"case when _lead_ok then transform(_t.d, x -> coalesce(x, {distance_m('_lead_raw', '_lead_unit')})) else _t.d end"
    df = add(df, _d=final)
    rows = let(
        "_d",
        "dv",
        "transform(_by_seq, o -> named_struct('category', _p[o.pos].category, 'only_new', _p[o.pos].only_new,"
        f" 'max_distance_m', dv[o.pos], 'raw_phrase', {cut('text', '_p[o.pos].s', '_p[o.pos].e')}))",
    )
    df = add(df, _rows=rows)
    # One requirement per (category, new), the least distance, the first phrase.
    same = "x.category = r.category and x.only_new = r.only_new"
    deduped = (
        f"transform(filter(_rows, (r, i) -> not exists(slice(_rows, 1, i), x -> {same})), r -> named_struct("
        "'category', r.category, 'only_new', r.only_new, 'max_distance_m',"
        f" array_min(transform(filter(_rows, x -> {same}), x -> x.max_distance_m)), 'raw_phrase', r.raw_phrase))"
    )
    return add(
        df,
        poi_requirements=deduped,
        poi_spans=f"concat(_t.spans, case when _lead_ok then array(named_struct('s', {start}, 'e', _p[_open].s)) else {NO_SPANS} end)",
    ).drop("_hits", "_p", "_head", "_by_seq", "_t", "_open", "_lead", "_lead_raw", "_lead_unit", "_lead_ok", "_d", "_rows")


# --- E20 classes of stations ------------------------------------------------------------------------


def line_stems(lines: list[str]) -> list[tuple[str, str]]:
    """Pattern stems of official line names: adjectives on -ая, without the diameter and rings."""
    out = []
    for line in sorted(set(lines)):
        key = " ".join(line.lower().replace("ё", "е").split())
        words = key.split()
        if key in ru.LINES_WITHOUT_STEM or key.startswith("мцд") or not all(w.endswith("ая") for w in words):
            continue
        out.append((r"[-\s]+".join(w[:-2] for w in words), line))
    return out


def _carrier(stem: str) -> str:
    return rf"(?:\b{stem}\w*\s+{ru.CARRIER}\b|\b{ru.CARRIER}\s+{stem}\w*\b){ru.DISTANCE_AFTER}"


def station_classes(df: DataFrame, lines: list[str]) -> DataFrame:
    """Requirements for any station of a class; ``lines`` are the line names of the catalogue."""
    named: list[tuple[str, list[str]]] = [(_carrier(s), v) for s, v in ru.COMPOUND_COLOURS.items()]
    named += [(_carrier(s), [line]) for s, line in line_stems(lines)]
    named += [(_carrier(s), v) for s, v in ru.COLOURS.items()]
    named += [(_carrier(s), v) for s, v in ru.ORDINALS.items()]
    named += [(p + ru.DISTANCE_AFTER, v) for p, v in ru.NICKNAMES]
    rules = [ru.LINE_BEFORE, ru.LINE_EXPLICIT, *ru.ANY_STATION_RULES]
    rules += [Rule("|".join(v), p, 2) for p, v in named]
    explicit = "m.rule in ('before', 'explicit')"
    plain = "m.rule in ('before', 'explicit', 'any')"
    token = "case m.rule when 'before' then m.g[2] else m.g[0] end"
    value = f"case when m.rule = 'any' then array('{ru.ANY_LINE}') when {explicit} then array(upper({token})) else split(m.rule, '[|]') end"
    raw = "case m.rule when 'explicit' then m.g[1] else m.g[0] end"
    unit = "case m.rule when 'explicit' then m.g[2] else m.g[1] end"
    w = ru.ROAD_WINDOW
    road = (
        f"rlike(substring(norm, greatest(m.s - {w}, 0) + 1, least(m.s, {w})), {lit(ru.ROAD_CONTEXT)})"
        f" or rlike(substring(norm, m.e + 1, {w}), {lit(ru.ROAD_CONTEXT)})"
    )
    matches = f"filter({scan('norm', rules)}, m -> {plain} or not ({road}))"
    valued = (
        f"transform({matches}, m -> named_struct('s', m.s, 'e', m.e, 'lines', {value},"
        f" 'd', case when {raw} is not null then {distance_m(raw, unit)} end))"
    )
    df = add(df, _kept=arbitrate(valued))
    between = (
        "trim(substring(norm, least(m.e, x.e) + 1, greatest(m.s, x.s) - least(m.e, x.e))) = ''"
    )
    anyline = f"m.lines[0] = '{ru.ANY_LINE}'"
    absorbed = f"{anyline} and exists(_kept, x -> x.lines[0] <> '{ru.ANY_LINE}' and {between})"
    reqs = (
        f"array_distinct(flatten(transform(filter(_kept, m -> not ({absorbed})), m -> transform(m.lines, l ->"
        " named_struct('line_prefix', l, 'max_distance_m', m.d)))))"
    )
    return add(df, station_class_requirements=reqs, class_spans=spans_of("_kept")).drop("_kept")


# --- E18 landmark windows -------------------------------------------------------------------------


def landmark_windows(df: DataFrame) -> DataFrame:
    """One row per (text, proximity marker, window of up to three words).

    Columns: ``query_id, marker_s, marker_e, marker, words, window, window_e``.
    """
    hits = match_spans("norm", Rule("m", ru.NEAR_MARKER))
    marked = df.selectExpr("query_id", "norm", f"explode({hits}) as m")
    tail = "substring(norm, m.e + 1, length(norm))"
    worded = marked.selectExpr(
        "query_id", "norm", "m", f"slice({match_spans(tail, Rule('w', ru.LANDMARK_WORD))}, 1, {ru.LANDMARK_WINDOW}) as w"
    )
    windows = worded.where("size(w) > 0").selectExpr(
        "query_id", "norm", "m", "w", "explode(sequence(1, size(w))) as words"
    )
    return windows.selectExpr(
        "query_id", "m.s as marker_s", "m.e as marker_e", "m.hit as marker", "words",
        "substring(norm, m.e + w[0].s + 1, w[words - 1].e - w[0].s) as window",
        "m.e + w[words - 1].e as window_e",
    )


# --- E22, E23, P10 residuals -----------------------------------------------------------------------


def chunk_words(chunk: str) -> str:
    """Words of a normalised chunk."""
    return f"regexp_extract_all({chunk}, {lit(ru.CHUNK_WORD)}, 0)"


def residual_class(words: str) -> str:
    """P10 on an array of words: lost, noise or unknown."""
    stems = " or ".join(f"startswith(w, '{s}')" for s in ru.PARAM_STEMS)
    units = texts(ru.UNIT_WORDS)
    fused = "regexp_replace(w, '^[0-9]+', '')"
    return let(
        words,
        "ws",
        f"case when size(ws) = 0 then 'unknown'"
        f" when exists(ws, w -> array_contains({texts(ru.PARAM_WORDS)}, w) or {stems})"
        f" or exists(transform(ws, (w, i) -> rlike(w, '^[0-9]') and (array_contains({units}, {fused})"
        f" or coalesce(array_contains({units}, get(ws, i + 1)), false))), h -> h) then 'lost'"
        f" when forall(ws, w -> array_contains({texts(ru.GREETING_WORDS + ru.STOP_WORDS)}, w)) then 'noise'"
        " else 'unknown' end",
    )


def looks_like_option(words: str) -> str:
    """E23 on an array of words: one to four significant words, not only proximity words."""
    stop = texts(ru.STOP_WORDS)
    near = texts(ru.PROXIMITY_WORDS)
    return let(
        words,
        "ws",
        let(
            f"filter(ws, w -> not array_contains({stop}, w))",
            "sig",
            f"not forall(ws, w -> array_contains({stop}, w) or array_contains({near}, w) or startswith(w, 'ближайш'))"
            f" and size(sig) between 1 and {ru.MAX_OPTION_WORDS} and exists(sig, w -> rlike(w, '[а-яёa-z]'))",
        ),
    )


def residuals(df: DataFrame, consumed: str, split_at: str = ru.CHUNK_SPLIT) -> DataFrame:
    """``residuals array<struct<text, class, option>>`` of what no family understood.

    ``consumed`` names a column of spans. Pieces without a significant word are left out.
    """
    df = add(df, _gaps=gaps_of("text", merge_spans(consumed)))
    pieces = f"flatten(transform(_gaps, x -> split({cut('text', 'x.s', 'x.e')}, {lit(split_at)}, -1)))"
    cleaned = f"transform({pieces}, x -> trim(both ' ,.-:;!?' from x))"
    df = add(df, _c=cleaned)
    folded = "translate(lower(x), 'ёabcehkmoptxy', 'еавсенкмортху')"
    words = f"transform(_c, x -> named_struct('text', x, 'w', {chunk_words(folded)}))"
    df = add(df, _w=f"filter({words}, x -> x.text <> '' and exists(x.w, w -> not array_contains({texts(ru.STOP_WORDS)}, w)))")
    out = (
        f"transform(_w, x -> named_struct('text', x.text, 'class', {residual_class('x.w')}, 'option', {looks_like_option('x.w')}))"
    )
    return add(df, residuals=out).drop("_gaps", "_c", "_w")


def explode_residuals(df: DataFrame) -> DataFrame:
    """``(query_id, seq, phrase, class, option)``.

    The outer form of explode: the inner one would infer a filter on the array and push it, with
    every expression it is made of, below each family.
    """
    rows = df.select("query_id", F.posexplode_outer("residuals").alias("seq", "r")).where("r is not null")
    return rows.selectExpr("query_id", "seq", "r.text as phrase", "r.class as class", "r.option as option")
