"""Conversation structure repair by depth-first branch-and-bound.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Rows
may be kept (cost 0), given the role user or assistant (3) or deleted (4;
required for blank and repeated rows), and empty rows inserted (3); a truncated
row that isn't deleted adds 3. Sought are the cheapest edits and, among those,
the ones whose initials (``audit``) are least in ASCII order.

A node of the search is (row, initial of the row written last); its arcs are
the edits of that row. The search goes depth first with an explicit stack. It
cuts a prefix whose cost and the least costs of all rows to come exceed the
incumbent (cost, audit), or equal its cost with a greater audit; and one that is
no better than a prefix that has reached the same node (dominance table). What
is left when the stack is empty is proved least. Two audits at one node are
never a prefix of one another (each ends with its row's edit), so comparing
prefixes compares whole audits.

Spark sorts the rows by range of (conv_id, turn, role, text), so a conversation
of any length is dealt to as many tasks as it needs; identical rows are counted
before the sort. A task walks its sorted rows in a stream. More than FOLD rows
are folded: every FOLD layers become one whose arcs are the least paths between
each pair of initials, found by the same search. Conversations that begin and
end inside a task are solved there; one that may go on in another task, or that
has more than SEGMENT_ROWS rows or SEGMENT_BYTES of text, leaves a segment with
its arcs. The segments' arcs alone then meet, the search runs over segments,
and the chosen edits are applied to each segment in order. What a task holds is
bounded by a segment, the arcs of one conversation's segments, and its audit.
A digest of a whole conversation is sequential, so one task streams its segments.

Defined results: rows are ordered by turn (null first), then role, then text;
null roles and texts are one space; a null conv_id is a conversation; repeated
rows are duplicates; a conversation without rows has zeros, an empty audit and
the digest of the empty text; an empty table gives an empty result; gaps beyond
a long are the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize, pick, sized_broadcast

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Layers that one search runs over.
FOLD = 64
#: Rows and bytes of text that a task holds of one conversation.
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 4 << 20
LONGEST = 2 ** 63 - 1
WHITE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
START = "^"
STATES = (START, "s", "u", "a")

#: arcs of a layer: state -> [(cost, edits, next state)], cheapest first
Layer = dict[str, list[tuple[int, str, str]]]


def _expected(state: str) -> str:
    return "a" if state == "u" else "u"


def _edits(initial: str, truncated: bool) -> Layer:
    """Arcs of a row that may stay. An insertion before a deletion is left out: the deletion
    first costs the same and is less. So is a second insertion, which leads back."""
    extra = TRUNCATED if truncated else 0
    out: Layer = {}
    for state in STATES:
        arcs = [(DELETE, "D", state)]
        for spent, done, at in ((0, "", state), (INSERT, "I", _expected(state))):
            if initial == _expected(at) or initial == "s" and at == START:
                arcs.append((spent + KEEP + extra, done + "K", initial))
            arcs.append((spent + REROLE + extra, done + "R", _expected(at)))
        out[state] = sorted(arcs)
    return out


_ROW_ARCS = {(i, t): _edits(i, t) for i in ("s", "u", "a", "") for t in (False, True)}
#: What may be inserted behind the last row.
_TAIL: Layer = {START: [(0, "", START)], "a": [(0, "", "a")], "u": [(INSERT, "I", "a")], "s": [(2 * INSERT, "II", "a")]}


def row_layer(role: str, truncated: bool) -> Layer:
    return _ROW_ARCS[role[:1] if role[:1] in ("s", "u", "a") else "", truncated]


def deleted_layer(n: int) -> Layer:
    """``n`` adjacent rows that must go."""
    return {s: [(DELETE * n, "D" * n, s)] for s in STATES}


def search(layers: list[Layer], entry: str, goals: tuple[str, ...]) -> tuple[int, str, str] | None:
    """(cost, audit, last state) of the least path from ``entry`` to one of the goals; None if there is none."""
    n = len(layers)
    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + min((arcs[0][0] for arcs in layers[i].values() if arcs), default=0)
    best: tuple[int, str, str] | None = None
    seen: list[dict[str, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best and (cost + floor[i], audit) > (best[0], best[1][:len(audit)]):
            continue
        known = seen[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        seen[i][state] = (cost, audit)
        if i == n:
            if state in goals and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, state)
            continue
        stack += [(i + 1, to, cost + c, audit + edits) for c, edits, to in reversed(layers[i].get(state, []))]
    return best


def joined(layers: list[Layer]) -> Layer:
    """One layer for several: the least path between each pair of states."""
    out: Layer = {}
    for a in STATES:
        found = [search(layers, a, (b,)) for b in STATES]
        out[a] = sorted(x for x in found if x)
    return out


def folded(layers: list[Layer], most: int = FOLD) -> list[Layer]:
    """At most ``most`` layers with the same least paths."""
    while len(layers) > most:
        layers = [joined(layers[i:i + most]) for i in range(0, len(layers), most)]
    return layers


def applied(audit: str, rows: Iterator[tuple[str, str]], state: str) -> tuple[list[str], str]:
    """The lines ``role:text`` that the edits leave, and the initial written last."""
    lines = []
    for edit in audit:
        if edit == "I":
            state = _expected(state)
            lines.append(f"{ROLES[state]}:")
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            state = _expected(state)
            role = ROLES[state]
        else:
            state = role[:1]
        lines.append(f"{role}:{text}")
    return lines, state


# ------------------------------------------------------------------ streams over sorted rows

class Segment:
    """Adjacent rows of one conversation, as far as a task holds them."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.layers: list[Layer] = []
        self.rows: list[tuple[str, str, int]] = []
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        seen = text.rstrip(WHITE)
        gone = copies
        if not seen:
            self.blank += copies
        else:
            if not again:
                gone -= 1
                cut = seen[-1] not in ".!?"
                self.truncated += cut
                self.layers.append(row_layer(role, cut))
            self.duplicate += gone
        if gone:
            self.layers.append(deleted_layer(gone))
        if len(self.layers) > 4 * FOLD:
            self.layers = folded(self.layers)
        self.rows.append((role, text, copies))
        self.bytes += len(role) + len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.bytes >= SEGMENT_BYTES

    def each(self) -> Iterator[tuple[str, str]]:
        for role, text, copies in self.rows:
            for _ in range(copies):
                yield role, text

    def counts(self) -> dict:
        return {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn",
                                              "first_initial", "last_initial")}


def _gaps(first, last, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, LONGEST)


def _solved(s: Segment) -> dict:
    """The row of a conversation that a segment holds whole."""
    cost, audit, _ = search([*folded(s.layers), _TAIL], START, (START, "a"))
    lines, _ = applied(audit, s.each(), START)
    repaired = "\n".join(lines)
    return {"conv_id": s.conv, "whole": True, "repaired": repaired, "gaps": _gaps(s.first_turn, s.last_turn, s.turns),
            "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest()}


def _left(s: Segment) -> dict:
    """The row of a segment: its arcs, its counts and its rows."""
    arcs = [(a, to, c, e) for a, out in joined(folded(s.layers)).items() for c, e, to in out]
    ranks = {e: i for i, e in enumerate(sorted({x[3] for x in arcs}))}
    return {"conv_id": s.conv, "whole": False, **s.counts(),
            "arcs": [{"entry": a, "leave": to, "cost": c, "rank": ranks[e], "edits": e} for a, to, c, e in arcs],
            "rows": [{"role": r, "text": t, "copies": n} for r, t, n in s.rows]}


_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
           ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_COUNTS = [("turns", "long"), ("first_turn", "long"), ("last_turn", "long"), ("first_initial", "string"), ("last_initial", "string")]
_LONG, _TEXT = pa.int64(), pa.string()
_ARCS = pa.list_(pa.struct([("entry", _TEXT), ("leave", _TEXT), ("cost", _LONG), ("rank", pa.int32()), ("edits", _TEXT)]))
_ROWS = pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT), ("copies", _LONG)]))
_ARC_TYPE = "array<struct<entry string, leave string, cost long, rank int, edits string>>"
_ROW_TYPE = "array<struct<role string, text string, copies long>>"


def _frame(fields: list[tuple[str, str]]) -> tuple[str, pa.Schema]:
    """A schema for Spark and the same for Arrow."""
    kinds = {"long": _LONG, "int": pa.int32(), "string": _TEXT, "boolean": pa.bool_(), _ARC_TYPE: _ARCS, _ROW_TYPE: _ROWS}
    return ", ".join(f"{n} {t}" for n, t in fields), pa.schema([(n, kinds[t]) for n, t in fields])


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("repaired") or "") + sum(len(x["text"]) for x in r.get("rows") or ())
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _segments(rows: DataFrame, most_rows: int) -> DataFrame:
    """Solved conversations and segments of the others, from sorted rows
    (conv_id, turn, role, text, copies, again); (part, no) orders segments."""
    spark_schema, schema = _frame([("conv_id", "long"), ("part", "int"), ("no", "long"), ("whole", "boolean"), ("repaired", "string"),
                                   *_RESULT, *_COUNTS, ("arcs", _ARC_TYPE), ("rows", _ROW_TYPE)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            s, inside, no = None, False, 0
            for conv, turn, role, text, copies, again in _rows_of(batches):
                if s is None or conv != s.conv:
                    if s is not None:
                        yield (_solved(s) if inside else _left(s)) | {"part": part, "no": no}
                        no += 1
                    # the task's first conversation may have begun in the task before
                    s, inside = Segment(conv), s is not None
                elif s.full(most_rows):
                    yield _left(s) | {"part": part, "no": no}
                    no += 1
                    s, inside = Segment(conv), False
                if copies:
                    s.add(turn, role, text, copies, again)
            if s is not None:  # and its last may go on in the next
                yield _left(s) | {"part": part, "no": no}

        yield from _batches(out(), schema)

    return rows.mapInArrow(work, spark_schema)


def _chosen(segments: DataFrame) -> DataFrame:
    """(part, no, entry, rank, tail, counts of the conversation) for every segment of the
    conversations in segments; ``tail`` and the counts only with the last one."""
    spark_schema, schema = _frame([("part", "int"), ("no", "long"), ("entry", "string"), ("rank", "int"), ("tail", "string"),
                                   *[x for x in _RESULT if x[1] == "long"]])
    names = ["conv_id", "part", "no", "arcs", "blank", "duplicate", "truncated", "illegal", *[n for n, _ in _COUNTS]]

    def finish(parts: list[dict]) -> Iterator[dict]:
        # an edit's rank as one character keeps the order of the edits' texts
        layers = [{a: sorted((x["cost"], chr(65 + x["rank"]), x["leave"]) for x in p["arcs"] if x["entry"] == a) for a in STATES}
                  for p in parts]
        cost, path, _ = search([*folded(layers), _TAIL], START, (START, "a"))
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        first = last = initial = None
        for p in parts:
            for k in total:
                total[k] += p[k]
            if p["first_turn"] is not None:
                total["turns"] -= p["first_turn"] == last
                first = p["first_turn"] if first is None else first
                last = p["last_turn"]
            if p["first_initial"] is not None:
                total["illegal"] += initial is not None and initial + p["first_initial"] not in ("su", "ua", "au")
                initial = p["last_initial"]
        total["gaps"] = _gaps(first, last, total.pop("turns"))
        state = START
        for i, p in enumerate(parts):
            row = {"part": p["part"], "no": p["no"], "entry": state, "rank": ord(path[i]) - 65}
            state = next(to for _, e, to in layers[i][state] if e == path[i])
            yield row if i + 1 < len(parts) else row | {"tail": path[len(parts):], "cost": cost, **total}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            parts: list[dict] = []
            for row in _rows_of(batches):
                p = dict(zip(names, row, strict=True))
                if parts and parts[0]["conv_id"] != p["conv_id"]:
                    yield from finish(parts)
                    parts = []
                parts.append(p)
            if parts:
                yield from finish(parts)

        yield from _batches(out(), schema)

    arcs = F.transform("arcs", lambda x: F.struct(x.entry.alias("entry"), x.leave.alias("leave"), x.cost.alias("cost"), x["rank"].alias("rank")))
    return (segments.withColumn("arcs", arcs).select(*names).repartition("conv_id")
            .sortWithinPartitions("conv_id", "part", "no").mapInArrow(work, spark_schema))


def _applied(segments: DataFrame) -> DataFrame:
    """Every segment's repaired text, and with a conversation's last segment its result."""
    spark_schema, schema = _frame([("conv_id", "long"), ("part", "int"), ("no", "long"), ("whole", "boolean"), ("repaired", "string"),
                                   *_RESULT])
    names = ["conv_id", "part", "no", "arcs", "rows", "entry", "rank", "tail", *[n for n, t in _RESULT if t == "long"]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            digest, audit, wrote = hashlib.sha256(), [], False
            for row in _rows_of(batches):
                p = dict(zip(names, row, strict=True))
                edits = next(x["edits"] for x in p["arcs"] if x["entry"] == p["entry"] and x["rank"] == p["rank"])
                edits += p["tail"] or ""
                rows = ((x["role"], x["text"]) for x in p["rows"] for _ in range(x["copies"]))
                lines, _ = applied(edits, rows, p["entry"])
                audit.append(edits)
                piece = "\n".join(lines)
                digest.update(("\n" if wrote and lines else "").encode() + piece.encode())
                wrote = wrote or bool(lines)
                done = {k: p[k] for k in ("conv_id", "part", "no")} | {"repaired": piece, "whole": False}
                if p["tail"] is None:
                    yield done
                    continue
                yield done | {n: p[n] for n, t in _RESULT if t == "long"} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                digest, audit, wrote = hashlib.sha256(), [], False

        yield from _batches(out(), schema)

    return (segments.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
            .mapInArrow(work, spark_schema))


# ------------------------------------------------------------------ operator

def counted_rows(conversations: DataFrame, copies=None) -> DataFrame:
    """Distinct rows of every conversation with the number of their copies and whether an
    earlier turn has the same role and text. ``copies`` (a Column) gives a row's number; 0
    drops it, but keeps its conversation."""
    d = pick(conversations, "conv_id", "turn", "role", "text") if copies is None else conversations
    copies = F.lit(1) if copies is None else copies
    kept = copies > 0
    d = d.select("conv_id", F.when(kept, F.col("turn")).alias("turn"),
                 F.when(kept, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
                 F.when(kept, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"), copies.cast("long").alias("copies"))
    d = materialize(d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    same = (d.where("copies > 0").groupBy("conv_id", "role", F.md5(F.encode("text", "UTF-8")).alias("said"))
            .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(F.col("conv_id").alias("same_conv"), F.col("role").alias("same_role"), "said", "first"))
    at = (F.col("conv_id").eqNullSafe(F.col("same_conv")) & (F.col("role") == F.col("same_role"))
          & (F.md5(F.encode("text", "UTF-8")) == F.col("said")))
    again = F.coalesce(F.col("first") < place, F.lit(False)).alias("again")
    return d.join(sized_broadcast(same), at, "left").select("conv_id", "turn", "role", "text", "copies", again)


def solve(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, no, whole, repaired, results) from ``counted_rows``: the repaired text in
    pieces ordered by (part, no), most conversations in one; results with the last piece."""
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    done = materialize(_segments(rows.repartitionByRange(*order).sortWithinPartitions(*order), segment_rows))
    names = ["conv_id", "part", "no", "whole", "repaired", *[n for n, _ in _RESULT]]
    cut = done.where("not whole").drop("repaired", *[n for n, _ in _RESULT if n in ("gaps", "cost", "audit", "repaired_sha256")])
    chosen = _chosen(cut)
    counts = [n for n, t in _RESULT if t == "long" and n in cut.columns]
    return done.where("whole").select(*names).unionByName(_applied(cut.drop(*counts).join(chosen, ["part", "no"])))


def repair(conversations: DataFrame, copies=None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    return solve(counted_rows(conversations, copies)).where("audit is not null").select("conv_id", *[n for n, _ in _RESULT])


def repaired_texts(conversations: DataFrame, copies=None) -> DataFrame:
    """(conv_id, part, no, repaired): the repaired ``role:text`` lines of every conversation, long ones in pieces
    ordered by (part, no)."""
    return solve(counted_rows(conversations, copies)).select("conv_id", "part", "no", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the checksum of ``conv_id:turn``. Of 20 remainders, 0
    drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the user's."""
    d = pick(conversations, "conv_id", "turn", "role", "text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault, text = F.crc32(F.encode(key, "UTF-8")) % 20, F.coalesce("text", F.lit(" "))
    return d.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
