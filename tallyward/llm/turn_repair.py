"""Repair of damaged conversations: the cheapest edits that make the roles a well-formed exchange.

Well-formed are the role initials ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of a user and an
assistant turn. The edits of a conversation are the edges of a lattice whose nodes are (rows read, role before the
cursor). Dijkstra's search runs from both ends at once: a forward and a reverse heap, the one with the smaller top
next, until their tops together exceed the best meeting, so that every crossing of that cost is finished. The audit
is then read off along edges that lie on some cheapest path, the smallest letter first, which gives the least of all
cheapest audits: two audits that reach one node at one cost never differ by one being the beginning of the other.

Most conversations are dealt by their key, sorted, and repaired one after the other in a stream. A conversation of
more than ``BLOCK_ROWS`` rows or ``BLOCK_CHARS`` characters never comes together in one place: its rows are ranged by
turn over all tasks and cut into blocks; each block gives its costs from every role at its beginning to every role at
its end (sixteen numbers); the chain of these numbers tells each block what the rest costs behind it, and with that
each block repairs itself. Only the hash of such a conversation is taken in one task, as a stream in constant
memory: a SHA-256 has no parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import written

BLOCK_ROWS = 4096
BLOCK_CHARS = 16 << 20
ROWS_OUT = 2048

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
FAR = 1 << 60
MOST = (1 << 63) - 1

#: The role before the cursor: none yet, system, user, assistant. The last is where a conversation may end, as is none.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ORDERLY = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT = 1  # what a truncated turn costs where it stays

#: A step of the lattice: (role initial, turn is cut, number of turns that must go); the last is 0 for a turn that may stay.
Step = tuple[str, bool, int]


def _turn(state: int) -> int:
    """The role that comes after ``state`` where an edit may choose it."""
    return ASSISTANT if state == USER else USER


def _edges(initial: str, cut: bool, gone: int) -> list[list[tuple[str, int, int]]]:
    """Per state, the (edit, cost, next state) that take in one step."""
    out: list[list[tuple[str, int, int]]] = []
    for state in range(STATES):
        if gone:
            out.append([(DELETE * gone, COST[DELETE] * gone, state)])
            continue
        to = _turn(state)
        edges = [(DELETE, COST[DELETE], state), (REROLE, COST[REROLE] + CUT * cut, to)]
        if initial == "s" and state == NONE:
            edges.append((KEEP, COST[KEEP] + CUT * cut, SYSTEM))
        elif (initial == "u" and to == USER) or (initial == "a" and to == ASSISTANT):
            edges.append((KEEP, COST[KEEP] + CUT * cut, to))
        out.append(edges)
    return out


_EDGES = {(i, c): _edges(i, c, 0) for i in "sua-" for c in (False, True)}


class Lattice:
    """The edits of one run of rows. ``tail`` allows insertions behind the last row; a block's end leaves these to the next."""

    def __init__(self, steps: list[Step], tail: bool):
        self.n = len(steps)
        self.tail = tail
        self.steps = [_edges(i, c, g) if g else _EDGES[i if i in "sua" and i else "-", c] for i, c, g in steps]
        back: dict[int, list[list[tuple[int, int]]]] = {}
        self.back = []
        for edges in self.steps:
            if id(edges) not in back:
                turned: list[list[tuple[int, int]]] = [[] for _ in range(STATES)]
                for state, leaving in enumerate(edges):
                    for _, cost, to in leaving:
                        turned[to].append((state, cost))
                back[id(edges)] = turned
            self.back.append(back[id(edges)])

    def leaving(self, node: int) -> Iterator[tuple[str, int, int]]:
        at, state = divmod(node, STATES)
        if at < self.n:
            for letter, cost, to in self.steps[at][state]:
                yield letter, cost, (at + 1) * STATES + to
        if at < self.n or self.tail:
            yield INSERT, COST[INSERT], at * STATES + _turn(state)

    def entering(self, node: int) -> Iterator[tuple[int, int]]:
        at, state = divmod(node, STATES)
        if at:
            for source, cost in self.back[at - 1][state]:
                yield (at - 1) * STATES + source, cost
        if at < self.n or self.tail:
            for source in (NONE, SYSTEM, ASSISTANT) if state == USER else (USER,) if state == ASSISTANT else ():
                yield at * STATES + source, COST[INSERT]

    def distances(self, entry: int) -> list[int]:
        """The costs from ``entry`` before the first row to every state behind the last."""
        best, heap, done = {entry: 0}, [(0, entry)], set()
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for _, step, to in self.leaving(node):
                if cost + step < best.get(to, FAR):
                    best[to] = cost + step
                    heapq.heappush(heap, (cost + step, to))
        return [best.get(self.n * STATES + state, FAR) for state in range(STATES)]

    def cheapest(self, entry: int, behind: list[int]) -> tuple[int, list[tuple[str, int]]]:
        """(cost, path) of the least audit among the cheapest, from ``entry`` to an end whose rest costs ``behind``.

        A path is the list of (edit, node behind it).
        """
        goals = {self.n * STATES + state: cost for state, cost in enumerate(behind) if cost < FAR}
        ahead, back = {entry: 0}, dict(goals)
        fore, rear = [(0, entry)], [(cost, node) for node, cost in goals.items()]
        heapq.heapify(rear)
        settled, closed = set(), set()
        best = goals.get(entry, FAR)
        while fore and rear and fore[0][0] + rear[0][0] <= best:
            if fore[0][0] <= rear[0][0]:
                cost, node = heapq.heappop(fore)
                if node in settled:
                    continue
                settled.add(node)
                for _, step, to in self.leaving(node):
                    if cost + step < ahead.get(to, FAR):
                        ahead[to] = cost + step
                        heapq.heappush(fore, (cost + step, to))
                        best = min(best, cost + step + back.get(to, FAR))
            else:
                cost, node = heapq.heappop(rear)
                if node in closed:
                    continue
                closed.add(node)
                for source, step in self.entering(node):
                    if cost + step < back.get(source, FAR):
                        back[source] = cost + step
                        heapq.heappush(rear, (cost + step, source))
                        best = min(best, cost + step + ahead.get(source, FAR))
        closed |= goals.keys()
        # Nodes before a crossing of that cost, found backwards along edges that hold forward costs together.
        good, seen = set(), []
        for node in settled:
            if node not in closed and any(to in closed and ahead[node] + step + back[to] == best for _, step, to in self.leaving(node)):
                good.add(node)
                seen.append(node)
        while seen:
            node = seen.pop()
            for source, step in self.entering(node):
                if source in settled and source not in good and ahead[source] + step == ahead[node]:
                    good.add(source)
                    seen.append(source)
        path, node, spent = [], entry, 0
        while not (node in goals and spent + goals[node] == best):
            letter, step, node = min(
                (letter, step, to)
                for letter, step, to in self.leaving(node)
                if (to in closed and spent + step + back[to] == best) or (to in good and spent + step == ahead[to])
            )
            spent += step
            path.append((letter, node))
        return best, path


#: What may still be missing behind the last row, by the role before the cursor.
END = [0, FAR, FAR, 0]


def edits(path: list[tuple[str, int]]) -> Iterator[tuple[int, str, str | None]]:
    """(row, edit, new role) along a path; a kept role and a deleted turn have none, an insertion stands before its row."""
    at = 0
    for letter, node in path:
        yield at, letter, NAMES[node % STATES] if letter in (REROLE, INSERT) else None
        at = node // STATES


def _fault(text: str) -> tuple[bool, bool]:
    """(blank, cut short)"""
    end = text.rstrip(SPACE)
    return not end, bool(end) and end[-1] not in ENDS


class Conversation:
    """Faults and repair of the sorted (turn, role, text) rows of one conversation."""

    def __init__(self, rows: list[tuple[int | None, str, str]]):
        self.rows = rows
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        seen, steps, before = set(), [], None
        for _, role, text in rows:
            blank, cut = _fault(text)
            again = (role, text) in seen
            seen.add((role, text))
            self.blank += blank
            self.duplicate += again and not blank
            cut = cut and not again
            self.truncated += cut
            self.illegal += before is not None and before + role[:1] not in ORDERLY
            before = role[:1]
            steps.append((before, cut, int(blank or again)))
        self.cost, self.path = Lattice(steps, tail=True).cheapest(NONE, END)

    @property
    def gaps(self) -> int:
        turns = {turn for turn, _, _ in self.rows if turn is not None}
        return min(max(turns) - min(turns) + 1 - len(turns), MOST) if turns else 0

    @property
    def audit(self) -> str:
        return "".join(letter for letter, _ in self.path)

    def edited(self) -> Iterator[tuple[int, str, str | None, str | None]]:
        """(row, edit, role, text) in order; a deleted turn has neither role nor text."""
        for at, letter, role in edits(self.path):
            if letter == KEEP:
                yield at, letter, self.rows[at][1], self.rows[at][2]
            else:
                yield at, letter, role, None if letter == DELETE else "" if letter == INSERT else self.rows[at][2]

    @property
    def repaired_sha256(self) -> str:
        kept = (f"{role}:{text}" for _, _, role, text in self.edited() if role is not None)
        return hashlib.sha256("\n".join(kept).encode()).hexdigest()


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes the user its speaker. A null role
    or text becomes one blank, as does a null id or turn inside the key.
    """
    def told(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    conv, turn = F.col(id_col), F.col(turn_col).cast("long")
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), told(F.col(role_col)).alias("role"), told(F.col(text_col)).alias("text"))
    kind = F.crc32(F.concat(told(F.col("conv_id")), F.lit(":"), told(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITED = "part long, block long, row long, nth long, edit string, role string, text string"


def _streamed(turns: DataFrame, edited: bool) -> DataFrame:
    """Conversations that fit a block, each repaired as it comes by in its task."""
    names = [part.split()[0] for part in (EDITED if edited else SUMMARY).split(", ")]
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(EDITED if edited else SUMMARY).fields])

    def told(conv: object, rows: list) -> Iterable[tuple]:
        one = Conversation(rows)
        if edited:
            return [(conv, 0, 0, at, n, letter, role, text) for n, (at, letter, role, text) in enumerate(one.edited())]
        return [(conv, one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit, one.repaired_sha256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *names])

        key, held, out = None, [], []
        for batch in batches:
            if not kinds:
                long, string = pa.int64(), pa.string()
                kinds = [batch.schema.field(0).type, *([long] * 4 + [string] * 3 if edited else [long] * 6 + [string] * 2)]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != key:
                    out.extend(told(key, held))
                    held = []
                    if len(out) >= ROWS_OUT:
                        yield batch_of(out)
                        out = []
                key = conv
                held.append((turn, role, text))
        if held:
            out.extend(told(key, held))
        if out:
            yield batch_of(out)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


class LongConversations:
    """The conversations that do not fit a block, repaired block by block."""

    def __init__(self, turns: DataFrame):
        self.spark, self.kind = turns.sparkSession, turns.schema["conv_id"].dataType
        self.rows = written(self._numbered(turns), "long-turns")
        self.blocks = written(self._steps(), "long-blocks")
        self.costs = written(self._costs(), "long-costs")
        self.behind = written(self._behind(), "long-behind")
        self.edited = written(self._edited(), "long-edits")

    def _schema(self, fields: str) -> T.StructType:
        return T.StructType([T.StructField("conv_id", self.kind), *T.StructType.fromDDL(fields).fields])

    def _numbered(self, turns: DataFrame) -> DataFrame:
        """Distinct rows with their copies and faults, in order: task, block of the task, row of the block."""
        spoken = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
        rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("spoken", spoken)
        when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
        several = rows.groupBy("conv_id", "spoken").agg(F.min(when).alias("first"), F.count("*").alias("times")).where("times > 1")
        several = several.select(F.col("conv_id").alias("c"), F.col("spoken").alias("s"), "first")
        met = rows.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("spoken") == F.col("s")), "left")
        end = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
        told = met.select(
            "conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("first") < when, F.lit(False)).alias("again"),
            (end == "").alias("blank"), ((end != "") & ~F.substring(end, -1, 1).isin(*ENDS)).alias("cut"),
        )
        order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
        ranged = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
        names, most_rows, most_chars = ranged.columns, BLOCK_ROWS, BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, block, row, chars = None, -1, 0, 0
            for batch in batches:
                blocks, places = [], []
                sizes = [len(t) for t in batch.column(names.index("text")).to_pylist()]
                for conv, size in zip(batch.column(0).to_pylist(), sizes, strict=True):
                    if block < 0 or conv != key or row >= most_rows or (row and chars + size > most_chars):
                        block, row, chars = block + 1, 0, 0
                    blocks.append(block)
                    places.append(row)
                    key, row, chars = conv, row + 1, chars + size
                arrays = [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "block", "row"])

        return ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, *T.StructType.fromDDL("block long, row long").fields]))

    def _steps(self) -> DataFrame:
        """One row per block with the steps of its rows; copies beyond the first must go, as one step."""
        step = F.struct("row", F.substring("role", 1, 1).alias("initial"), "blank", "again", "cut", "copies")
        return self.rows.groupBy("conv_id", "part", "block").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    @staticmethod
    def _lattice(steps: list[dict], last: bool) -> tuple[Lattice, list[int]]:
        """The lattice of a block, and which row each of its steps belongs to."""
        out: list[Step] = []
        rows: list[int] = []
        for step in steps:
            gone = bool(step["blank"] or step["again"])
            runs = [(step["initial"], step["cut"], 0)] if not gone else []
            if more := step["copies"] - (not gone):
                runs.append((step["initial"], False, more))
            out.extend(runs)
            rows.extend([step["row"]] * len(runs))
        return Lattice(out, last), rows

    def _costs(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    lattice, _ = LongConversations._lattice(one["steps"], False)
                    costs = [c for entry in range(STATES) for c in lattice.distances(entry)]
                    initials = [s["initial"] for s in one["steps"]]
                    # Copies stand side by side: one pair of equal initials each.
                    illegal = sum(a + b not in ORDERLY for a, b in zip(initials, initials[1:], strict=False)) + sum(s["copies"] - 1 for s in one["steps"])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "conv_id": pa.array([one["conv_id"]], batch.schema.field(0).type), "part": [one["part"]], "block": [one["block"]],
                            "costs": pa.array([costs], pa.list_(pa.int64())), "illegal": [illegal], "head": [initials[0]], "end": [initials[-1]],
                        }
                    )

        fields = "part long, block long, costs array<long>, illegal long, head string, end string"
        return self.blocks.mapInArrow(run, self._schema(fields))

    def _behind(self) -> DataFrame:
        """Per block what the rest costs behind it, by role, and the totals of its conversation (one short row per block)."""

        def chain(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
            illegal = sum(r["illegal"] for r in rows) + sum(a["end"] + b["head"] not in ORDERLY for a, b in zip(rows, rows[1:], strict=False))
            rest = [0, 2 * COST[INSERT], COST[INSERT], 0]
            behind = []
            for n, r in enumerate(reversed(rows)):
                behind.append(END if not n else rest)
                rest = [min(FAR, *(r["costs"][e * STATES + t] + rest[t] for t in range(STATES))) for e in range(STATES)]
            n = len(rows)
            return pa.table(
                {
                    "conv_id": table["conv_id"], "part": pa.array([r["part"] for r in rows], pa.int64()),
                    "block": pa.array([r["block"] for r in rows], pa.int64()), "behind": pa.array(behind[::-1], pa.list_(pa.int64())),
                    "last": pa.array([k == n - 1 for k in range(n)], pa.bool_()), "cost": pa.array([rest[NONE]] * n, pa.int64()),
                    "illegal": pa.array([illegal] * n, pa.int64()),
                }
            )

        fields = "part long, block long, behind array<long>, last boolean, cost long, illegal long"
        return self.costs.groupBy("conv_id").applyInArrow(chain, self._schema(fields))

    def _edited(self) -> DataFrame:
        """(conv_id, part, block, row, nth, edit, role): every edit of every block, from the role it begins with."""
        told = self.blocks.select("part", "block", "steps").join(self.behind.select("conv_id", "part", "block", "behind", "last"), ["part", "block"])
        told = told.select("conv_id", "part", "block", "steps", "behind", "last")

        def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    lattice, _ = LongConversations._lattice(one["steps"], one["last"])
                    to = []
                    for entry in range(STATES):
                        _, path = lattice.cheapest(entry, one["behind"])
                        to.append(path[-1][1] % STATES)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "conv_id": pa.array([one["conv_id"]], batch.schema.field(0).type), "part": [one["part"]], "block": [one["block"]],
                            "to": pa.array([to], pa.list_(pa.int64())),
                        }
                    )

        def follow(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
            entries, state = [], NONE
            for r in rows:
                entries.append(state)
                state = r["to"][state]
            return pa.table(
                {
                    "part": pa.array([r["part"] for r in rows], pa.int64()), "block": pa.array([r["block"] for r in rows], pa.int64()),
                    "entry": pa.array(entries, pa.int64()),
                }
            )

        moved = told.mapInArrow(moves, self._schema("part long, block long, to array<long>"))
        entries = moved.groupBy("conv_id").applyInArrow(follow, "part long, block long, entry long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    lattice, rows = LongConversations._lattice(one["steps"], one["last"])
                    rows.append(one["steps"][-1]["row"] + 1)
                    made = [(rows[at], letter, role) for at, letter, role in edits(lattice.cheapest(one["entry"], one["behind"])[1])]
                    n = len(made)
                    row, letter, role = zip(*made, strict=True) if made else ((), (), ())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "conv_id": pa.array([one["conv_id"]] * n, batch.schema.field(0).type), "part": pa.array([one["part"]] * n, pa.int64()),
                            "block": pa.array([one["block"]] * n, pa.int64()), "row": pa.array(row, pa.int64()), "nth": pa.array(range(n), pa.int64()),
                            "edit": pa.array(letter, pa.string()), "role": pa.array(role, pa.string()),
                        }
                    )

        entered = told.join(entries, ["part", "block"]).select(*told.columns, "entry")
        made = entered.mapInArrow(run, self._schema("part long, block long, row long, nth long, edit string, role string"))
        texts = self.rows.select("part", "block", "row", F.col("role").alias("own"), F.col("text").alias("own_text"))
        held = made.join(texts, ["part", "block", "row"], "left")
        role = F.when(F.col("edit") == KEEP, F.col("own")).otherwise(F.col("role"))
        text = F.when(F.col("edit").isin(KEEP, REROLE), F.col("own_text")).when(F.col("edit") == INSERT, "")
        return held.select("conv_id", "part", "block", "row", "nth", "edit", role.alias("role"), text.alias("text"))

    def _hashes(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256): each conversation's edits pass one task in order, none is held."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, audit, digest, first, kind = None, None, None, True, None

            def told() -> pa.RecordBatch:
                arrays = [pa.array([key], kind), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "audit", "repaired_sha256"])

            for batch in batches:
                kind = batch.schema.field(0).type
                for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if audit is None or conv != key:
                        if audit is not None:
                            yield told()
                        key, audit, digest, first = conv, [], hashlib.sha256(), True
                    audit.append(edit)
                    if role is not None:
                        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                        first = False
            if audit is not None:
                yield told()

        order = [F.asc_nulls_first("conv_id"), "part", "block", "nth"]
        sent = self.edited.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "edit", "role", "text")
        return sent.mapInArrow(run, self._schema("audit string, repaired_sha256 string"))

    def summary(self) -> DataFrame:
        blank, again = F.col("blank"), F.col("again")
        extent = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
        counts = self.rows.groupBy("conv_id").agg(
            F.when(F.max("turn").isNull(), 0).otherwise(F.least(extent, F.lit(MOST).cast("decimal(38,0)")).cast("long")).alias("gaps"),
            F.coalesce(F.sum(F.when(blank, F.col("copies"))), F.lit(0)).alias("blank"),
            F.coalesce(F.sum(F.when(~blank, F.when(again, F.col("copies")).otherwise(F.col("copies") - 1))), F.lit(0)).alias("duplicate"),
            F.count_if(~blank & ~again & F.col("cut")).alias("truncated"),
        )
        totals = self.behind.where("last").select(F.col("conv_id").alias("c"), "cost", "illegal")
        hashes = self._hashes().select(F.col("conv_id").alias("d"), "audit", "repaired_sha256")
        joined = counts.join(totals, F.col("conv_id").eqNullSafe(F.col("c"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("d")))
        return joined.select("conv_id", *[part.split()[0] for part in SUMMARY.split(", ")])


def _parted(turns: DataFrame) -> tuple[DataFrame, LongConversations | None]:
    """The rows of conversations that fit a block, and the others repaired."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = written(sizes.where((F.col("n") > BLOCK_ROWS) | (F.col("chars") > BLOCK_CHARS)).select(F.col("conv_id").alias("c")), "long-ids")
    if long.isEmpty():
        return turns, None
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return turns.join(long, same, "left_anti"), LongConversations(turns.join(long, same, "left_semi"))


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows: its faults, the cost and audit of its repair, a hash.

    Rows count by turn, nulls first, then role and text. ``gaps`` counts missing turn numbers; a row's first fault
    counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (does not end
    in ``.!?``); ``illegal`` counts neighbours other than system-user, user-assistant, assistant-user. Keeping a turn
    costs nothing, a new role 2, deleting 3 (the only way for blank and duplicate ones), an inserted empty turn 2,
    a truncated turn that stays 1. ``audit`` spells the cheapest edits (K, R, D, I), the ASCII-least where several cost
    the same; ``repaired_sha256`` hashes the ``role:text`` lines that result.

    A null id is a conversation of its own. Roles are judged by their first letter; other roles must change or go.
    Extra columns are not read, repeated rows are duplicates, no rows give no conversations. Role and text must not
    be null (see :func:`damaged`).
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    short, long = _parted(turns)
    summary = _streamed(short, edited=False)
    return summary.unionByName(long.summary()) if long else summary


def edited_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, block, row, nth, edit, role, text): every edit, in the order of its places inside a conversation.

    The rows with a role are the repaired conversation; a deleted turn has neither role nor text.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    short, long = _parted(turns)
    rows = _streamed(short, edited=True)
    return rows.unionByName(long.edited) if long else rows


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after :func:`damaged`; one whose rows are all gone has zeros and an empty audit."""
    found = repaired(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    return joined.select("conv_id", *[F.coalesce(name, F.lit(empty.get(name, 0))).alias(name) for name in names])
