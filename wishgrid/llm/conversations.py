"""Conversation repair: the cheapest edits to a legal order of roles, by an automaton that shares suffixes."""

from __future__ import annotations

import hashlib
import itertools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wishgrid.llm.common import send_package, written

#: White space that does not make a text.
BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits; a truncated row that is not deleted costs KEPT_TRUNCATED more.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 1, 2, 5, 5
#: Turns of one slice, in which repeats are looked for together.
SLICE = 1024
#: Rows of one segment of a signature, and the suffixes up to this length that keep their whole audit.
SEGMENT, KEPT_AUDIT = 65_536, 64

#: Grammar of the initials: state -> initial -> next state. Empty, or an s and then pairs of u and a.
GRAMMAR = {"start": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "assistant"}, "assistant": {"u": "user"}}
FINAL = ("start", "assistant")
STATES = list(GRAMMAR)
#: The state after an inserted row or one with a new role; its name is that role.
_GIVEN = {state: next(n for i, n in moves.items() if i in "ua") for state, moves in GRAMMAR.items()}

Costs = tuple[int, ...]


def damage(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> with damaged role and text, and how often the row stands (0 to 2).

    The crc32 of ``conv_id:turn`` mod 20 decides: 0 drops the row, 1 empties its text, 2 takes away its ``.!?``, 3
    repeats it, 4 makes it a user's. Nulls count as one space in the key, the role and the text.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def marked_rows(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> distinct rows without their text, with faults.

    ``copies`` counts equal rows together; ``seen``: an earlier turn of the conversation has this role and text. Rows
    that do not stand (copies 0) become one row per conversation. However often one text repeats in a conversation, a
    window holds at most ``SLICE`` rows or one row per slice.
    """
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    stands = F.col("copies") > 0
    light = rows.select(
        "conv_id",
        F.when(stands, F.col("turn")).alias("turn"),
        F.when(stands, F.col("role")).otherwise("").alias("role"),
        F.when(stands, _digest(F.col("text"))).otherwise(F.lit(b"")).alias("digest"),
        (kept == "").alias("blank"),
        (~F.substring(kept, -1, 1).isin(*".!?")).alias("open"),
        "copies",
    )
    # a digest has one blank and one open; rows that do not stand may differ in them
    once = light.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open")
    )
    key, turn = ["conv_id", "role", "digest"], F.col("turn").asc_nulls_first()
    once = once.withColumn("slice", F.floor(F.col("turn") / SLICE))
    in_slice = once.withColumn("in_slice", F.row_number().over(Window.partitionBy(*key, "slice").orderBy(turn)))
    rest = in_slice.withColumn("rest", F.when(F.col("in_slice") > 1, F.col("slice")))
    first = F.row_number().over(Window.partitionBy(*key, "rest").orderBy(turn)) == 1
    return rest.withColumn("seen", ~((F.col("in_slice") == 1) & first)).drop("slice", "in_slice", "rest")


_SEGMENT = (
    "conv_id {0}, first struct<turn:{1},role:string,digest:binary>, last_turn {1}, low {1}, high {1}, turns long, "
    "head string, tail string, blank long, duplicate long, truncated long, illegal long, symbols string"
)
_LEGAL = ("su", "ua", "au")


def signatures(marked: DataFrame) -> DataFrame:
    """marked_rows -> per conversation its counts of faults and its signature.

    A signature has a sign per row, in order of turn (nulls first), role and digest of the text: ``d`` for a row that
    must go, else the initial s, u or a, or o for another; a capital if truncated. Rows are sorted over all
    conversations and dealt by range, so a conversation of any length lies in as many tasks as it needs; each tells its
    segments, and only those meet.
    """
    send_package(marked.sparkSession)
    types = [marked.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    order = ["conv_id", "turn", "role", "digest"]
    sorted_ = marked.select(*order, "blank", "open", "seen", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = marked.sparkSession.createDataFrame([], _SEGMENT.format(*types)).schema
    arrow = _arrow(schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in itertools.groupby(_rows(batches), operator.itemgetter(0)):
            for rows in _segments(group):
                out.append((conv_id, *_segment(rows)))
                if len(out) > 1000:
                    yield _batch(out, arrow)
                    out = []
        yield _batch(out, arrow)

    parts = sorted_.mapInArrow(told, schema).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*schema.names[1:]))).alias("p"))
    summed = {c: _sum_of("p", c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")}
    pairs = F.greatest(F.size("p") - 1, F.lit(0))
    meeting = F.zip_with(
        F.slice("p", F.lit(1), pairs),
        F.slice("p", F.lit(2), pairs),
        lambda a, b: F.struct(
            (~F.concat(a["tail"], b["head"]).isin(*_LEGAL)).cast("long").alias("illegal"),
            F.coalesce((a["last_turn"] == b["first"]["turn"]).cast("long"), F.lit(0).cast("long")).alias("turns"),
        ),
    )
    met = {c: _sum_of("m", c) for c in ("illegal", "turns")}
    low, high = F.array_min(F.transform("p", lambda x: x["low"])), F.array_max(F.transform("p", lambda x: x["high"]))
    # rows that do not stand give a segment without rows: it takes no part in what meets
    standing = F.filter("p", lambda x: x["symbols"] != "")
    return (
        parts.withColumn("p", standing)
        .withColumn("m", meeting)
        .select(
            "conv_id",
            F.coalesce(high - low + 1 - (summed["turns"] - met["turns"]), F.lit(0)).cast("long").alias("gaps"),
            summed["blank"].alias("blank"),
            summed["duplicate"].alias("duplicate"),
            summed["truncated"].alias("truncated"),
            (summed["illegal"] + met["illegal"]).alias("illegal"),
            F.array_join(F.transform("p", lambda x: x["symbols"]), "").alias("symbols"),
        )
    )


def _sum_of(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: total + x[field])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _segments(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows that stand, in parts of about SEGMENT rows; one empty part where no row stands."""
    part, size, any_ = [], 0, False
    for row in rows:
        if row[-1]:
            part.append(row)
            size, any_ = size + row[-1], True
        if size >= SEGMENT:
            yield part
            part, size = [], 0
    if part or not any_:
        yield part


def _segment(rows: list[tuple]) -> tuple:
    if not rows:
        return {"turn": None, "role": "", "digest": b""}, None, None, None, 0, "", "", 0, 0, 0, 0, ""
    symbols, blank_n, seen_n, open_n, illegal, turns, last, before = [], 0, 0, 0, 0, 0, None, None
    for _, turn, role, _, blank, open_, seen, copies in rows:
        initial = role[:1]
        if before is not None and before + initial not in _LEGAL:
            illegal += 1
        if initial + initial not in _LEGAL:
            illegal += copies - 1
        before = initial
        turns += turn is not None and turn != last
        last = turn
        sign = initial if initial and initial in "sua" else "o"
        if blank:
            blank_n += copies
            symbols.append("d" * copies)
        else:
            seen_n += copies - (not seen)
            open_n += open_ and not seen
            symbols.append("d" * copies if seen else (sign.upper() if open_ else sign) + "d" * (copies - 1))
    own = [r[1] for r in rows if r[1] is not None]
    first = dict(zip(("turn", "role", "digest"), rows[0][1:4], strict=True))
    return (
        first, last, min(own, default=None), max(own, default=None), turns, rows[0][2][:1], before,
        blank_n, seen_n, open_n, illegal, "".join(symbols),
    )


#: Cost to go from each state when no row is left, before any insertion.
_UNENDED = tuple(0 if s in FINAL else 10**9 for s in STATES)
_AT = {s: k for k, s in enumerate(STATES)}


def _closed(costs: Costs) -> Costs:
    """With insertions in front: one, or from the first states two."""
    once = [min(c, INSERT + costs[_AT[_GIVEN[s]]]) for s, c in zip(STATES, costs, strict=True)]
    return tuple(min(c, INSERT + once[_AT[_GIVEN[s]]]) for s, c in zip(STATES, once, strict=True))


def _steps(symbol: str, state: str) -> dict[str, tuple[int, str]]:
    """Edits of a row with this sign in a state: letter of the edit -> cost, next state."""
    steps = {"D": (DELETE, state)}
    if symbol != "d":
        extra = KEPT_TRUNCATED if symbol.isupper() else 0
        kept = GRAMMAR[state].get(symbol.lower())
        if kept:
            steps["K"] = (extra, kept)
        steps["R"] = (REROLE + extra, _GIVEN[state])
    return steps


class Automaton:
    """The suffixes of signatures that come sorted by their reverse.

    A node is a suffix; the nodes of the signature before lie on a stack, and of the next signature only those suffixes
    are new that it does not share, so each is worked out once. Nodes of equal cost to go (up to a constant) are
    one class: from the class of the shorter suffix and the sign in front of it follow the costs, and per state the edit of
    least cost, in ties the least letter. Short suffixes keep their best audit per state, longer ones the next edit.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[Costs, str], tuple[Costs, int, tuple]] = {}
        self.reverse = ""
        end = _closed(_UNENDED)
        audit = tuple("I" * (c // INSERT) for c in end)
        self.nodes: list[tuple[Costs, int, tuple, tuple | None]] = [(end, 0, (), audit)]

    def _before(self, costs: Costs, symbol: str) -> tuple[Costs, int, tuple]:
        plain = []
        for state in STATES:
            plain.append(min(c + costs[_AT[n]] for c, n in _steps(symbol, state).values()))
        own = _closed(tuple(plain))
        moves = []
        for state in STATES:
            letters = ""
            while True:
                at, left = _AT[state], own[_AT[state]]
                choices = {e: n for e, (c, n) in _steps(symbol, state).items() if c + costs[_AT[n]] == left}
                if INSERT + own[_AT[_GIVEN[state]]] == left:
                    choices["I"] = _GIVEN[state]
                letter = min(choices)
                letters, state = letters + letter, choices[letter]
                if letter != "I":
                    break
            moves.append((letters, _AT[state]))
        least = min(own)
        return tuple(c - least for c in own), least, tuple(moves)

    def repair(self, reverse: str) -> tuple[int, str]:
        """Least cost and best audit of the signature that is the reverse of ``reverse``."""
        shared = 0
        for a, b in zip(reverse, self.reverse, strict=False):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for depth in range(shared, len(reverse)):
            costs, base, _, audits = self.nodes[-1]
            key = (costs, reverse[depth])
            if key not in self.known:
                self.known[key] = self._before(*key)
            own, more, moves = self.known[key]
            whole = tuple(letters + audits[n] for letters, n in moves) if depth < KEPT_AUDIT else None
            self.nodes.append((own, base + more, moves, whole))
        self.reverse = reverse
        state, letters = 0, []
        for depth in range(len(reverse), -1, -1):
            costs, base, moves, audits = self.nodes[depth]
            if depth == len(reverse):
                cost = base + costs[0]
            if audits is not None:
                letters.append(audits[state])
                break
            more, state = moves[state]
            letters.append(more)
        return cost, "".join(letters)


def cheapest(told: DataFrame) -> DataFrame:
    """signatures -> with cost and audit; ``symbols`` goes.

    Signatures are dealt by range of their reverse, so those that share suffixes meet, and of a signature that very many
    conversations have each task works out the suffixes once.
    """
    send_package(told.sparkSession)
    kept = [f for f in told.schema.fields if f.name != "symbols"]
    schema = StructType([*kept, StructField("cost", LongType()), StructField("audit", StringType())])
    arrow, order = _arrow(schema), ["reverse", "conv_id"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            *rest, reverse = batch.columns
            found = [automaton.repair(r) for r in reverse.to_pylist()]
            new = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(rest, arrow, strict=False)), *new], schema=arrow)

    own = told.withColumn("reverse", F.reverse("symbols")).select(*(f.name for f in kept), "reverse")
    return own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(solved, schema)


def edited_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies), audits(conv_id, audit) -> conv_id, place, edit, role, text.

    Repaired rows in order, from place 1 on; before them each conversation has a row of place 0 with neither role nor
    text. The rows of a conversation stream through one task in order, behind its audit; nothing is gathered.
    """
    send_package(rows.sparkSession)
    header = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", "copies")
    order = ["conv_id", "kind", "turn", "role", "digest"]
    sorted_ = header.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "copies")
    schema = StructType(
        [rows.schema["conv_id"], StructField("place", LongType()), *(StructField(n, StringType()) for n in ("edit", "role", "text"))]
    )
    arrow = _arrow(schema)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, room = [], 0
        for conv_id, group in itertools.groupby(_rows(batches), operator.itemgetter(0)):
            edits = _edits(group)
            for place, row in enumerate(edits):
                out.append((conv_id, place, *row))
                room += 100 + len(row[2] or "")
                if room > 4_000_000:
                    yield _batch(out, arrow)
                    out, room = [], 0
        yield _batch(out, arrow)

    return sorted_.mapInArrow(repaired, schema)


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edit, role and text of the repaired rows of a conversation, the row of place 0 first."""
    audit, at, state = next(rows)[3], 0, "start"
    yield None, None, None
    for _, _, role, text, copies in rows:
        for _ in range(copies):
            while audit[at] == "I":
                at, state = at + 1, _GIVEN[state]
                yield "I", state, ""
            letter, at = audit[at], at + 1
            if letter == "K":
                state = GRAMMAR[state][role[:1]]
                yield letter, role, text
            elif letter == "R":
                state = _GIVEN[state]
                yield letter, state, text
    for _ in audit[at:]:
        state = _GIVEN[state]
        yield "I", state, ""


def conversation_digests(edited: DataFrame) -> DataFrame:
    """edited_rows, straight from that function -> conv_id, repaired_sha256 of the ``role:text`` rows, joined by newlines.

    A hash runs along its conversation, in the task and the order in which the rows come.
    """
    schema = StructType([edited.schema["conv_id"], StructField("repaired_sha256", StringType())])
    arrow = _arrow(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in itertools.groupby(_rows(batches), operator.itemgetter(0)):
            told = hashlib.sha256()
            for _, place, _, role, text in group:
                if place:
                    told.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            out.append((conv_id, told.hexdigest()))
            if len(out) > 10_000:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return edited.mapInArrow(hashed, schema)


def analyse(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> per conversation its faults, the least cost and the best audit.

    Gaps in the turns are counted without null turns; of blank, duplicate and truncated only the first fault of a row
    counts. A conversation without a standing row has zeros and an empty audit; null ids are one conversation; no rows
    give no rows; other columns take no part.
    """
    return cheapest(signatures(marked_rows(rows)))


def repair(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text."""
    return edited_rows(rows, audits).where("place > 0")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), damaged -> faults, cost, audit and hash of every conversation."""
    rows = damage(conversations)
    told = written(analyse(rows), "conversations")
    digests = conversation_digests(edited_rows(rows, told.select("conv_id", "audit"))).withColumnRenamed("conv_id", "own_id")
    return told.join(digests, told["conv_id"].eqNullSafe(digests["own_id"])).drop("own_id")
