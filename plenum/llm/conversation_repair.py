"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn and then pairs of
a user's and an assistant's turn. Edits of a row: keep (0), give it the role
that is due (2), delete (3; the only one for blank and repeated rows); a turn
without text may be inserted anywhere (2); a truncated row that stays adds 1.
The cheapest edits win, of equally cheap ones those whose initials are
ASCII-least.

The grammar has four states: nothing yet, after the system turn, after a user's,
after an assistant's. Every row is a step between states: the turns inserted
before it, then its edit. Costs of the first half run forward from the state a
stretch begins with, costs of the second half backward from the state it must
end in; where they meet, the crossing state of least cost, of those the one
with the least edits so far, splits the stretch in two, which are solved alike.
Only two vectors of four are held meanwhile. As each row's step ends with its
edit, no step is the beginning of another, and comparing step by step is
comparing the initials; a vector holds the order of its states' edits beside
their costs, never the edits themselves.

On Spark rows are dealt by ranges of (conversation, turn), so that a long
conversation spreads over tasks, and cut into pieces of `PIECE` rows. Pieces are
solved in parallel. A conversation of several is solved on the pieces first, as
steps with 4 x 4 costs, which gives the state at every border.

Order and ties: by turn (null first), role, then MD5 of the text. Nulls: a null
conversation is one of its own; a null role or text is one space. Equal rows
after the first are repeated rows. A role counts by its first character, in
small letters; an empty one fits nothing. Very long texts are read whole. An
empty table gives an empty result. Other columns are ignored, whatever their
names. An audit is one string, so a conversation has fewer than 2^31 edits; its
hash is taken by one task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, shuffle_width, table

#: Rows solved by one call; a power of two.
PIECE = 4096
#: Solved pieces that a task keeps, should they come again.
KEPT = 10_000
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after s, after u, after a; the turn due after each; what ends well.
DUE = "uuau"
AFTER = {"s": 1, "u": 2, "a": 3}
ENDS = (0, 3)
#: Letters of edits: K kept, D deleted, U and A given the role of a user or an assistant, u and a inserted; and their initials.
EDITS, INITIALS = "KDUAua", "KDRRII"
ROLES = {"u": "user", "a": "assistant"}
#: Of each state the steps from it: end state, cost and what orders their edits.
Steps = list[list[tuple[int, int, object]]]


def _inserts(state: int) -> Iterator[tuple[int, str]]:
    """States that inserted turns lead to, with the turns; a third brings no new state."""
    turns = ""
    for _ in range(4):
        yield state, turns
        turns += DUE[state]
        state = AFTER[DUE[state]]


def initials(edits: str) -> str:
    return edits.translate(str.maketrans(EDITS, INITIALS))


def _row_steps(kind: str) -> tuple[Steps, dict[tuple[int, int], str]]:
    """Steps of a row from each state, and the edits of each; the digits of a kind are given in `kinds`."""
    initial, fault = "sua-"[int(kind, 16) % 4], int(kind, 16) // 4
    steps: Steps = []
    edits: dict[tuple[int, int], str] = {}
    for x in range(4):
        best: dict[int, tuple[int, str, str]] = {}
        for state, turns in _inserts(x):
            ends = [(state, 3, "D")]
            if fault < 2:
                ends.append((AFTER[DUE[state]], 2 + fault, DUE[state].upper()))
                if initial == DUE[state] or initial == "s" and state == 0:
                    ends.append((AFTER[initial], fault, "K"))
            for y, cost, edit in ends:
                way = (2 * len(turns) + cost, initials(turns + edit), turns + edit)
                best[y] = min(best.get(y, way), way)
        steps.append([(y, cost, name) for y, (cost, name, _) in sorted(best.items())])
        edits |= {(x, y): way for y, (_, _, way) in best.items()}
    return steps, edits


ROW_STEPS = {k: _row_steps(k) for k in "0123456789ab"}
#: The step after the last row: inserted turns up to a state that ends well, here named 0.
FINISH: list[tuple[int, str]] = [min((2 * len(turns), turns) for state, turns in _inserts(x) if state in ENDS) for x in range(4)]
FINISH_STEPS: Steps = [[(0, cost, "I" * len(turns))] for cost, turns in FINISH]


def forward(steps: Callable[[int], Steps], lo: int, hi: int, state: int) -> dict[int, tuple[int, int]]:
    """(cost, place among the states by edits) of the best way from state over lo..hi to each state."""
    now = {state: (0, 0)}
    for i in range(lo, hi):
        here = steps(i)
        new: dict[int, tuple[int, int, object]] = {}
        for x, (cost, place) in now.items():
            for y, more, name in here[x]:
                way = (cost + more, place, name)
                if y not in new or way < new[y]:
                    new[y] = way
        # the order of edits alone: the place so far, then the step; no two states share both
        order = sorted(new, key=lambda y: new[y][1:])
        now = {y: (new[y][0], k) for k, y in enumerate(order)}
    return now


def backward(steps: Callable[[int], Steps], lo: int, hi: int, state: int) -> list[float]:
    """Cost of the best way from each state over lo..hi to state."""
    now = [np.inf] * 4
    now[state] = 0
    for i in range(hi - 1, lo - 1, -1):
        now = [min((cost + now[y] for y, cost, _ in here), default=np.inf) for here in steps(i)]
    return now


def hirschberg(steps: Callable[[int], Steps], n: int, state: int, end: int) -> list[int]:
    """The states before each of n steps and after the last, on the best way from state to end."""
    states = [state] * n + [end]
    stretches = [(0, n)]
    while stretches:
        lo, hi = stretches.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        rest = backward(steps, mid, hi, states[hi])
        left = forward(steps, lo, mid, states[lo])
        states[mid] = min((cost + rest[x], place, x) for x, (cost, place) in left.items())[2]
        stretches += [(lo, mid), (mid, hi)]
    return states


def solve(kinds: str, state: int = 0, end: int | None = None) -> list[str]:
    """Edits of each row; those after the last row go with the last. end: the state to reach, or None for the end of the conversation."""
    last = len(kinds)
    steps = lambda i: FINISH_STEPS if i == last else ROW_STEPS[kinds[i]][0]
    states = hirschberg(steps, last + (end is None), state, 0 if end is None else end)
    edits = [ROW_STEPS[k][1][states[i], states[i + 1]] for i, k in enumerate(kinds)]
    if end is None and edits:
        edits[-1] += FINISH[states[last]][1]
    return edits


def piece_steps(kinds: str) -> Steps:
    """A piece as one step: from each state the costs of all ends, and the order of their edits."""
    steps = lambda i: ROW_STEPS[kinds[i]][0]
    return [[(y, cost, place) for y, (cost, place) in sorted(forward(steps, 0, len(kinds), x).items())] for x in range(4)]


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, conversation (a key without null), turn, role, text, pos, kind and fault of every row, stored; pos is its place in all.

    fault: blank, duplicate, truncated or null.
    """
    spark = rows.sparkSession
    rows = pick(rows, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")).alias("conversation"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = ["conversation", "turn", "role", F.md5("text")]
    rows = materialize(rows.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()), "turns")
    same = F.sha2(F.concat_ws("\u0001", "conversation", F.sha2("role", 256), F.sha2("text", 256)), 256)
    slim = rows.select("pos", same.alias("same"))
    again = slim.groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat(F.lit(""), "same").alias("same"), "first")  # another name for the key, so that the join may split it
    again = slim.join(again, "same").filter("pos > first").select("pos", F.lit(True).alias("again"))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("again"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return rows.join(again, "pos", "left").withColumn("fault", fault).withColumn("kind", kinds(F.col("role"), F.col("fault"))).drop("again")


def kinds(role: Column, fault: Column) -> Column:
    """One hexadecimal digit: the role's initial among s, u, a and others, plus four for truncated, eight for rows to be deleted."""
    initial = F.when(F.startswith(role, F.lit("s")), 0).when(F.startswith(role, F.lit("u")), 1).when(F.startswith(role, F.lit("a")), 2).otherwise(3)
    return F.lower(F.hex(initial + F.when(fault.isin("blank", "duplicate"), 8).when(fault == "truncated", 4).otherwise(0)))


def edits(rows: DataFrame) -> DataFrame:
    """pos, edits (letters of EDITS) of every row of `ordered`."""
    pieces = rows.groupBy("conversation", F.shiftright("pos", int(np.log2(PIECE))).alias("piece")).agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "").alias("kinds"))
    pieces = materialize(pieces, "pieces")
    several = pieces.groupBy("conversation").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    longer = pieces.join(several, "conversation", "left_semi")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            steps = [[[list(map(int, s)) for s in x] for x in piece_steps(k)] for k in pdf["kinds"]]
            yield pd.DataFrame({"conversation": pdf["conversation"], "pos": pdf["pos"], "steps": steps})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        each = [[[tuple(s) for s in x] for x in p] for p in pdf["steps"]]
        states = hirschberg(lambda i: FINISH_STEPS if i == len(each) else each[i], len(each) + 1, 0, 0)
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(), "state": states[:-2], "end": [*states[1:-2], -1]})

    folded = longer.mapInPandas(fold, "conversation string, pos long, steps array<array<array<int>>>")
    known = folded.groupBy("conversation").applyInPandas(borders, "pos long, state int, end int")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int, int], str] = {}  # short conversations repeat
        for pdf in batches:
            out = []
            for way in zip(pdf["kinds"], pdf["state"], pdf["end"]):
                if way not in seen:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[way] = " ".join(solve(way[0], way[1], None if way[2] < 0 else way[2]))
                out.append(seen[way])
            yield pd.DataFrame({"pos": pdf["pos"], "edits": out})

    single = pieces.join(several, "conversation", "left_anti").select("pos", "kinds", F.lit(0).alias("state"), F.lit(-1).alias("end"))
    todo = single.unionByName(longer.select("pos", "kinds").join(known, "pos"))
    return todo.mapInPandas(solved, "pos long, edits string").select("pos", F.posexplode(F.split("edits", " ")).alias("i", "edits")).select((F.col("pos") + F.col("i")).alias("pos"), "edits")


def repair(rows: DataFrame) -> DataFrame:
    """The rows of `ordered` with their edits."""
    rows = ordered(rows)
    return rows.join(edits(rows), "pos")


def repaired(edited: DataFrame) -> DataFrame:
    """conv_id, pos, step, edit, role, text of the repaired conversations; inserted turns have no text, pos is that of the row they stand beside."""
    each = edited.select("conv_id", "pos", "role", "text", F.posexplode(F.split("edits", "")).alias("step", "edit")).filter("edit <> 'D' and edit <> ''")
    own = F.col("edit").isin("u", "a")
    role = F.when(F.lower("edit") == "u", ROLES["u"]).when(F.lower("edit") == "a", ROLES["a"]).otherwise(F.col("role"))
    return each.select("conv_id", "pos", "step", "edit", role.alias("role"), F.when(own, "").otherwise(F.col("text")).alias("text"))


REPORT = "conversation string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edited: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: gaps, faults, cost, audit and hash. Rows pass in order and are never gathered."""
    columns = ["conversation", "pos", "turn", "role", "text", "fault", "edits"]
    lined = edited.select(*columns).repartition(shuffle_width(edited.sparkSession), "conversation").sortWithinPartitions("conversation", "pos")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None

        def closed() -> dict:
            gaps = now["last"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
            return {"conversation": now["name"], "gaps": gaps, **now["faults"], "illegal": now["illegal"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        names = [x.split(" ")[0] for x in REPORT.split(", ")]
        for pdf in batches:
            done = []
            for name, turn, role, text, fault, edit in zip(pdf["conversation"], pdf["turn"], pdf["role"], pdf["text"], pdf["fault"], pdf["edits"]):
                if now is None or now["name"] != name:
                    if now is not None:
                        done.append(closed())
                    now = {"name": name, "least": None, "last": None, "turns": 0, "faults": {"blank": 0, "duplicate": 0, "truncated": 0}, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "before": None, "empty": True}
                if turn is not None and int(turn) != now["last"]:
                    now["least"] = int(turn) if now["least"] is None else now["least"]
                    now["last"], now["turns"] = int(turn), now["turns"] + 1
                if fault:
                    now["faults"][fault] += 1
                now["illegal"] += now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au")
                now["before"] = role[:1]
                now["audit"].append(initials(edit))
                for e in edit:
                    now["cost"] += 3 if e == "D" else 0 if e == "K" else 2
                    if e == "D":
                        continue
                    now["cost"] += fault == "truncated" and e in "KUA"
                    line = f"{role if e == 'K' else ROLES[e.lower()]}:{'' if e in 'ua' else text}"
                    now["hash"].update((line if now["empty"] else "\n" + line).encode())
                    now["empty"] = False
            yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([closed()], columns=names)

    # turns as text: a column with nulls would turn into doubles
    return lined.withColumn("turn", F.col("turn").cast("string")).mapInPandas(walk, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by crc32(`conv_id:turn`) % 20."""
    rows = pick(rows, "conv_id", "turn", "role", "text")
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    rows = rows.withColumn("draw", F.crc32(F.encode(key, "UTF-8")) % 20).filter("draw <> 0")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = report(repair(damaged(rows)))
    every = pick(rows, "conv_id").distinct().withColumn("conversation", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conversation", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
