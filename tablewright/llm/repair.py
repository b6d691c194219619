"""Repair of damaged conversations by cheapest edits.

The rows of a conversation become a directed graph without cycles: a node is a row and
what the roles so far end in, an edge is an edit.  An edge's weight is one whole number.
Its high digits are the cost, below them stands the edit's letter as an octal digit at
the place of its position in the audit, of a width that is fixed for all paths, so that
a shorter audit ends in zeros.  Weights add up along a path, and the plain minimum of
these numbers is the cheapest audit, the least in ASCII order among equally cheap ones.

A conversation of any length is cut into segments.  Two paths through a segment with the
same ends and the same cost are never one the beginning of the other, since inserts
cost something; so the best path between each pair of ends is enough to know, and the
segments of one conversation are put together by the same minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.lookup import lookup_join
from tablewright.llm.common import WORD, stored

#: A segment ends after so many rows or so much text.
SEGMENT_ROWS = 256
SEGMENT_BYTES = 4 << 20
#: Records handed over at once.
BATCH_RECORDS = 128

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: Octal digits of the letters, in ASCII order; zero is "no further letter".
LETTERS = "DIKR"
CODE = {letter: i + 1 for i, letter in enumerate(LETTERS)}
TO_DIGITS = str.maketrans(LETTERS, "1234")
TO_LETTERS = str.maketrans("1234", LETTERS)

#: What the roles so far end in: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where an inserted or renamed row leads: an assistant after a user, else a user.
NEXT = {state: ASSISTANT if state == USER else USER for state in range(4)}
LEGAL = {"su", "ua", "au"}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = "", "b", "d", "t"


class Path(NamedTuple):
    weight: int
    letters: int


class Walk:
    """Best paths over rows, as weights of ``width`` letters."""

    def __init__(self, start: int, width: int) -> None:
        self.width = width
        self.best: dict[int, Path] = {start: Path(0, 0)}

    def edge(self, path: Path, letter: str, cost: int) -> Path:
        digit = CODE[letter] << 3 * (self.width - 1 - path.letters)
        return Path(path.weight + (cost << 3 * self.width) + digit, path.letters + 1)

    def inserts(self) -> None:
        """Rows inserted before the next one; more than two would come back to the same roles."""
        layer = dict(self.best)
        for _ in range(2):
            following: dict[int, Path] = {}
            for state, path in layer.items():
                _offer(following, NEXT[state], self.edge(path, INSERT, COST[INSERT]))
            for state, path in following.items():
                _offer(self.best, state, path)
            layer = following

    def row(self, role: str, fault: str) -> None:
        self.inserts()
        after: dict[int, Path] = {}
        late = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, path in self.best.items():
            _offer(after, state, self.edge(path, DELETE, COST[DELETE]))
            if fault in (BLANK, DUPLICATE):
                continue
            kept = STEP[state].get(role[:1])
            if kept is not None:
                _offer(after, kept, self.edge(path, KEEP, COST[KEEP] + late))
            _offer(after, NEXT[state], self.edge(path, REROLE, COST[REROLE] + late))
        self.best = after

    def cost_and_audit(self, path: Path) -> tuple[int, str]:
        digits = (path.weight & ((1 << 3 * self.width) - 1)) >> 3 * (self.width - path.letters)
        return path.weight >> 3 * self.width, format(digits, "o").translate(TO_LETTERS) if path.letters else ""


def _offer(best: dict[int, Path], state: int, path: Path) -> None:
    known = best.get(state)
    if known is None or path.weight < known.weight:
        best[state] = path


def width_of(rows: int) -> int:
    """The most letters over so many rows: one each, and two inserts before each and at the end."""
    return 3 * rows + 2


def apply_audit(audit: str, state: int, rows: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The rows that an audit leaves of ``rows``, from the state before them on."""
    result, place = [], 0
    for letter in audit:
        if letter == INSERT:
            state = NEXT[state]
            result.append({"role": ROLE[state], "text": ""})
            continue
        role, text = rows[place]
        place += 1
        if letter == KEEP:
            state = STEP[state][role[:1]]
            result.append({"role": role, "text": text})
        elif letter == REROLE:
            state = NEXT[state]
            result.append({"role": ROLE[state], "text": text})
    return result


_TURNS = "turns array<struct<role string, text string>>"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SEGMENT = (
    "part int, seq int, whole boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, n_turns long, "
    f"paths array<struct<start int, stop int, cost long, audit string>>, {_TURNS}"
)


class _Segment:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv: object, opens: bool) -> None:
        self.conv, self.opens = conv, opens
        self.rows: list[tuple[str, str]] = []
        self.faults: list[str] = []
        self.turns: list[int] = []
        self.n_turns = self.illegal = self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.n_turns += 1
            self.turns = [*self.turns[:1], turn]
        self.rows.append((role, text))
        self.faults.append(fault)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def record(self, part: int, seq: int, closes: bool) -> dict:
        """The best paths; for a whole conversation only the repair itself."""
        whole = self.opens and closes
        paths = []
        for start in (START,) if self.opens else range(4):
            walk = Walk(start, width_of(len(self.rows)))
            for (role, _), fault in zip(self.rows, self.faults):
                walk.row(role, fault)
            if whole:
                walk.inserts()
                walk.best = dict([min(((s, walk.best[s]) for s in ENDS if s in walk.best), key=lambda b: b[1].weight)])
            for stop, path in walk.best.items():
                cost, audit = walk.cost_and_audit(path)
                paths.append({"start": start, "stop": stop, "cost": cost, "audit": audit})
        turns = [{"role": r, "text": t} for r, t in self.rows]
        return {
            "conv": self.conv, "part": part, "seq": seq, "whole": whole, "n_rows": len(self.rows),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(TRUNCATED), "illegal": self.illegal,
            "first_initial": self.rows[0][0][:1], "last_initial": self.rows[-1][0][:1],
            "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None,
            "n_turns": self.n_turns, "paths": paths,
            "turns": apply_audit(paths[0]["audit"], START, self.rows) if whole else turns,
        }


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, len(batch), 256):
            yield from batch.slice(low, 256).to_pylist()


def _batches(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records in batches of bounded number and text."""
    waiting, held = [], 0
    for record in records:
        waiting.append(record)
        held += sum(len(t["text"]) for t in record.get("turns") or ())
        if len(waiting) == BATCH_RECORDS or held >= SEGMENT_BYTES:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _map(df: DataFrame, each, schema: str) -> DataFrame:
    """``each`` turns the rows of one task, in their order, into records."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: _batches(each(_rows_of(batches)), arrow), schema)


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows of one task as segments.

    The first conversation may have begun in the task before and the last may go on in the
    next one, so neither counts as whole.
    """
    part, seq, segment, task_starts = TaskContext.get().partitionId(), 0, None, True
    for row in rows:
        if segment is not None and segment.conv != row["conv"]:
            yield segment.record(part, seq, closes=True)
            seq, segment, task_starts = seq + 1, None, False
        for copy in range(row["copies"]):
            if segment is not None and segment.full():
                yield segment.record(part, seq, closes=False)
                seq, segment = seq + 1, _Segment(row["conv"], opens=False)
            if segment is None:
                segment = _Segment(row["conv"], opens=not task_starts)
            fault = DUPLICATE if copy and row["fault"] != BLANK else row["fault"]
            segment.add(row["turn"], row["role"], row["text"], fault)
    if segment is not None:
        yield segment.record(part, seq, closes=False)


def _weight(cost: int, digits: int, letters: int, width: int) -> int:
    return (cost << 3 * width) + (digits << 3 * (width - letters))


class _Joined:
    """Segments of one conversation, met in order.

    Holds the best path to each of four ends as digits, and four small numbers per segment
    to find the way back.
    """

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.best = {START: (0, 0, 0)}  # cost, octal digits, letters
        self.keys: list[tuple[int, int]] = []
        self.back: list[dict[int, int]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns: list[int] = []
        self.n_turns, self.last_initial = 0, None

    def _choose(self, offers: list[tuple[int, int, tuple[int, int, int]]]) -> dict[int, int]:
        width = max(path[2] for _, _, path in offers)
        least: dict[int, tuple[int, int, tuple[int, int, int]]] = {}
        for start, stop, path in offers:
            weight = _weight(*path, width)
            if stop not in least or weight < least[stop][0]:
                least[stop] = (weight, start, path)
        self.best = {stop: path for stop, (_, _, path) in least.items()}
        return {stop: start for stop, (_, start, _) in least.items()}

    def add(self, segment: dict) -> None:
        offers = []
        for p in segment["paths"]:
            if p["start"] in self.best:
                cost, digits, letters = self.best[p["start"]]
                more = len(p["audit"])
                added = (digits << 3 * more) + int(p["audit"].translate(TO_DIGITS), 8)
                offers.append((p["start"], p["stop"], (cost + p["cost"], added, letters + more)))
        self.back.append(self._choose(offers))
        self.keys.append((segment["part"], segment["seq"]))
        for name in self.counts:
            self.counts[name] += segment[name]
        if self.last_initial is not None and self.last_initial + segment["first_initial"] not in LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = segment["last_initial"]
        if segment["first_turn"] is not None:
            same = bool(self.turns) and self.turns[-1] == segment["first_turn"]
            self.n_turns += segment["n_turns"] - same
            self.turns = [*(self.turns[:1] or [segment["first_turn"]]), segment["last_turn"]]

    def records(self) -> Iterator[dict]:
        """The report, and the ends of the path through each segment; the last one gets the closing inserts."""
        offers = [(s, s, path) for s, path in self.best.items()]
        for start, (cost, digits, letters) in self.best.items():
            state, path = start, (cost, digits, letters)
            for _ in range(2):
                state = NEXT[state]
                path = (path[0] + COST[INSERT], (path[1] << 3) + CODE[INSERT], path[2] + 1)
                offers.append((start, state, path))
        before = {path: start for start, _, path in offers}
        width = max(path[2] for _, _, path in offers)
        end = min((path for _, stop, path in offers if stop in ENDS), key=lambda path: _weight(*path, width))
        state = before[end]
        closing = end[2] - self.best[state][2]
        ends = []
        for key, back in zip(reversed(self.keys), reversed(self.back)):
            ends.append((key, back[state], state))
            state = back[state]
        for (part, seq), start, stop in ends:
            yield {"conv": self.conv, "part": part, "seq": seq, "start": start, "stop": stop, "closing": closing}
            closing = 0
        gaps = self.turns[-1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        audit = format(end[1], "o").translate(TO_LETTERS) if end[2] else ""
        yield {"conv": self.conv, "gaps": gaps, **self.counts, "cost": end[0], "audit": audit}


def _join(segments: Iterator[dict]) -> Iterator[dict]:
    joined = None
    for segment in segments:
        if joined is not None and joined.conv != segment["conv"]:
            yield from joined.records()
            joined = None
        joined = joined or _Joined(segment["conv"])
        joined.add(segment)
    if joined is not None:
        yield from joined.records()


def _finish(segments: Iterator[dict]) -> Iterator[dict]:
    """The repaired rows of segments whose ends are known."""
    for s in segments:
        audit = next(p["audit"] for p in s["paths"] if (p["start"], p["stop"]) == (s["start"], s["stop"]))
        rows = [(t["role"], t["text"]) for t in s["turns"]]
        turns = apply_audit(audit, s["start"], rows) + apply_audit(INSERT * s["closing"], s["stop"], [])
        yield {"conv": s["conv"], "part": s["part"], "seq": s["seq"], "whole": False, "turns": turns}


class Repaired(NamedTuple):
    """``report``: one row per conversation with ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost`` and ``audit``.  ``pieces``: the repaired rows, as arrays ``turns`` of
    consecutive ones; a conversation's pieces follow each other by ``part`` and ``seq``, and
    ``whole`` marks one that is all of a conversation."""

    report: DataFrame
    pieces: DataFrame


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    Rows are taken by turn (nulls first), then role and text.  Roles count by their first
    character.  A row without a visible character is blank, one whose role and text came
    before in its conversation is a duplicate, one that ends in no ``.``, ``!`` or ``?`` is
    truncated; the first of these counts.

    Null roles and texts count as one space, so they are blank or have no role to keep; rows
    without a conversation form one; an empty table gives no rows.  Repeated rows are
    counted before they are dealt out and each gets its own letter.  Other columns are not
    read, whatever their names.  Texts of any length are kept whole.

    Rows are dealt out in ranges of conversation and turn, so one that holds most of the
    table is many segments in many tasks; joining them moves one record per
    ``SEGMENT_ROWS`` rows.
    """
    kind = dict(df.dtypes)[conv]
    named = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    same = F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)
    counted = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    counted = stored(counted.withColumn("same", same), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("same", "first")
    blank = ~F.col("text").rlike(WORD)
    fault = (
        F.when(blank, BLANK)
        .when(order > F.col("first"), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    judged = lookup_join(counted, firsts, ["same"], "left").withColumn("fault", fault)
    ordered = ["conv", "turn", "role", "text"]
    judged = judged.select(*ordered, "copies", "fault").repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    segments = stored(_map(judged, _cut, f"conv {kind}, {_SEGMENT}"), "segments")

    cut = segments.where("not whole")
    scalars = [c for c in segments.columns if c != "turns"]
    by_conv = cut.select(*scalars).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    joined = stored(_map(by_conv, _join, f"conv {kind}, part int, seq int, start int, stop int, closing int, {_COUNTS}"), "joined")
    ends = joined.where("part is not null").select("part", "seq", "start", "stop", "closing")
    pieces_of_cut = _map(cut.join(ends, ["part", "seq"]), _finish, f"conv {kind}, part int, seq int, whole boolean, {_TURNS}")

    whole = segments.where("whole")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    chosen = F.col("paths")[0]
    counts = ["blank", "duplicate", "truncated", "illegal"]
    report = whole.select("conv", gaps.alias("gaps"), *counts, chosen["cost"].alias("cost"), chosen["audit"].alias("audit"))
    report = report.unionByName(joined.where("part is null").select("conv", "gaps", *counts, "cost", "audit"))
    pieces = whole.select("conv", "part", "seq", "whole", "turns").unionByName(pieces_of_cut)
    return Repaired(report, pieces)


def _digest(pieces: Iterator[dict]) -> Iterator[dict]:
    conv, digest, empty = None, None, True
    for piece in pieces:
        if digest is None or piece["conv"] != conv:
            if digest is not None:
                yield {"conv": conv, "repaired_sha256": digest.hexdigest()}
            conv, digest, empty = piece["conv"], hashlib.sha256(), True
        if piece["lines"] is not None:
            digest.update((piece["lines"] if empty else "\n" + piece["lines"]).encode())
            empty = False
    if digest is not None:
        yield {"conv": conv, "repaired_sha256": digest.hexdigest()}


def digests(pieces: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256``, the digest of all its ``role:text``, joined by newlines.

    A digest has to see its bytes in order: one task reads the pieces of a cut conversation
    one after the other, and holds one at a time.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    lines = pieces.select("conv", "part", "seq", "whole", F.when(F.size("turns") > 0, F.array_join(line, "\n")).alias("lines"))
    whole = lines.where("whole").select("conv", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    cut = lines.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return whole.unionByName(_map(cut, _digest, f"conv {dict(pieces.dtypes)['conv']}, repaired_sha256 string"))
