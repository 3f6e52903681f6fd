"""Conversation structure repair by iterative-deepening A*.

A conversation's rows stand in the order of turn (nulls first), then role and text. A row's fault is the first of:
blank (no character but ASCII white space), duplicate (its role and text stand earlier), truncated (its last other
character is none of .!?). Edits give roles whose initials are nothing or one s at most and then ua once or more:

    D delete 3, the only edit of a blank or duplicate row    I insert an empty text 2
    K keep 0                                                 R give the row the role user or assistant 2

and 1 more for each truncated row that stays. The cheapest edits are found by depth-first search in the order D, I,
K, R under growing cost bounds, with a table of states that failed; the first path that gets through is the answer,
and the least in ASCII order. The bound of what is still to pay counts rows that must go, truncated rows, and pairs
of neighbours that may not stand together: one edit mends at most two such pairs in a row.

Rows are put in ranges of (conversation, turn) and read as a stream, so a long conversation lies in many tasks. It is
cut into pieces of PIECE_ROWS rows or PIECE_BYTES; each piece is searched for every pair of a role before it and a
role at its end, a pass from the last piece to the first sums the costs, and one from the first to the last picks the
edits. That is exact: edits of a piece end with a row, so none is the start of another, and the least choice at each
piece is the least in all. A conversation that lies within one range and one piece is searched at once.

Null roles and texts are one space; rows with a null id are one conversation. Equal rows are duplicates. An empty role
has no initial, so it may not stand anywhere. Other columns are left alone. An empty table gives an empty table. The
digest of a conversation is one stream over its repaired text, as SHA-256 can't be split; repaired_turns doesn't need
it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PIECE_ROWS, PIECE_BYTES = 64, 4 << 20
#: The role initial before a row: none yet, s, u or a. Edits that add a row always add NEXT.
STATES, NEXT = "^sua", {"^": "u", "s": "u", "u": "a", "a": "u"}
FOLLOWS = {"^s", "^u", "su", "ua", "au"}
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
#: Edits and their costs after the last row, from each state.
TAIL = {"^": "", "s": "II", "u": "I", "a": ""}
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, CHANGE, SHORT = 3, 2, 1

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SUMMARY = ("gaps", *_COUNTS, "cost")
_PIECE = "part int, seq int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<long>, roles array<string>, texts array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") % 20: the made damage of op11."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("time", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "time")


def faults(roles: list[str], texts: list[str], again: Callable[[int], bool]) -> list[str]:
    """b, d, t or - for each row; again tells whether a row's role and text stand earlier."""
    out = []
    for i, text in enumerate(texts):
        last = text.rstrip(BLANKS)[-1:]
        out.append("b" if not last else "d" if again(i) else "-" if last in ".!?" else "t")
    return out


class Search:
    """The search over one piece: initials of the roles, and faults as of faults()."""

    def __init__(self, initials: list[str], faults: list[str]):
        self.initials, self.n = initials, len(initials)
        self.must = [f in "bd" for f in faults]
        self.short = [SHORT * (f == "t") for f in faults]
        self.live = [x for x, m in zip(initials, self.must, strict=True) if not m]
        n = self.n
        self.at, self.sure, self.odd, self.s_ahead = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.at[n] = len(self.live)
        for i in range(n - 1, -1, -1):
            must = self.must[i]
            self.at[i] = self.at[i + 1] - (not must)
            self.sure[i] = self.sure[i + 1] + (DELETE if must else self.short[i])
            self.odd[i] = self.odd[i + 1] + (not must and initials[i] not in ("u", "a"))
            self.s_ahead[i] = self.s_ahead[i + 1] + (not must and initials[i] == "s")

    def _ends(self, state: str) -> bool:
        return state in self.goals

    def _runs(self) -> None:
        """For each live row: the bad pairs in a row from it on, and the edits that those after them need."""
        k = len(self.live)
        self.run, self.after = [0] * (k + 1), [0] * (k + 1)
        for j in range(k - 1, -1, -1):
            bad = self.live[j] + self.live[j + 1] not in LEGAL if j + 1 < k else not self._ends(self.live[j])
            self.run[j] = self.run[j + 1] + 1 if bad else 0
            self.after[j] = self.after[j + 1] if bad else (self.run[j + 1] + 1) // 2 + self.after[j + 1]

    def least(self, i: int, state: str) -> int:
        """Never more than what edits from row i on cost."""
        j = self.at[i]
        if j == len(self.live):
            edits = 0 if self._ends(state) else 1
        else:
            edits = (self.run[j] + (state + self.live[j] not in FOLLOWS) + 1) // 2 + self.after[j]
        odd = self.odd[i] - (state == "^" and self.s_ahead[i] > 0)
        return self.sure[i] + CHANGE * max(edits, odd)

    def best(self, start: str, goal: str | None) -> tuple[int, str]:
        """Cost and initials of the cheapest edits. goal: the state after the last row's own edit; None: any end."""
        self.goals, self.final = ("^a" if goal is None else goal), goal is None
        self._runs()
        bound = self.least(0, start)
        while True:
            self.failed, self.over = {}, None
            path = self._down(0, start, bound)
            if path is not None:
                return bound, path
            bound += self.over

    def _down(self, i: int, state: str, left: int) -> str | None:
        over = self.least(i, state) - left
        if over > 0:
            self.over = over if self.over is None else min(self.over, over)
            return None
        if i == self.n and self._ends(state):
            return ""
        if self.failed.get((i, state), -1) >= left:
            return None
        more, to = i < self.n, NEXT[state]
        steps = []
        if more:
            steps.append(("D", DELETE, i + 1, state))
        if more or self.final:
            steps.append(("I", CHANGE, i, to))
        if more and not self.must[i]:
            if state + self.initials[i] in FOLLOWS:
                steps.append(("K", self.short[i], i + 1, self.initials[i]))
            steps.append(("R", CHANGE + self.short[i], i + 1, to))
        for name, cost, j, then in steps:
            path = self._down(j, then, left - cost)
            if path is not None:
                return name + path
        self.failed[i, state] = left
        return None

    def table(self) -> tuple[list[int], list[str]]:
        """Costs (-1: no way) and edits for each state before and each state after the piece."""
        costs, audits = [], []
        for start in STATES:
            for goal in STATES:
                cost, audit = -1, ""
                if goal in "ua":
                    cost, audit = self.best(start, goal)
                elif start == goal:
                    cost, audit = DELETE * self.n, "D" * self.n
                elif start + goal == "^s":
                    kept = [(self.short[i], -i) for i in range(self.n) if self.initials[i] == "s" and not self.must[i]]
                    if kept:
                        more, i = min(kept)
                        cost, audit = DELETE * (self.n - 1) + more, "D" * -i + "K" + "D" * (self.n - 1 + i)
                costs.append(cost)
                audits.append(audit)
        return costs, audits


def edited(roles: list[str], texts: list[str], audit: str, state: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that edits leave, from a state on."""
    i = 0
    for edit in audit:
        if edit == "K":
            yield edit, roles[i], texts[i]
            state = roles[i][:1]
        elif edit != "D":
            state = NEXT[state]
            yield edit, ROLES[state], texts[i] if edit == "R" else ""
        i += edit != "I"


def _after(roles: list[str], audit: str, state: str) -> str:
    for _, role, _ in edited(roles, [""] * len(roles), audit, state):
        state = role[:1]
    return state


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _whole(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """All results of a conversation that is one piece."""
    seen: set[tuple[str, str]] = set()

    def again(i: int) -> bool:
        return (roles[i], texts[i]) in seen or seen.add((roles[i], texts[i])) is not None

    found, initials = [], [r[:1] for r in roles]
    for i in range(len(roles)):
        was = again(i)
        found += faults(roles[i : i + 1], texts[i : i + 1], lambda _, was=was: was)
    cost, audit = Search(initials, found).best("^", None)
    known = {t for t in turns if t is not None}
    kept = "\n".join(f"{role}:{text}" for _, role, text in edited(roles, texts, audit, "^"))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": found.count("b"), "duplicate": found.count("d"), "truncated": found.count("t"),
        "illegal": _illegal(initials), "cost": cost, "audit": audit, "repaired_sha256": sha256(kept.encode()).hexdigest(),
    }


def _rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from batch.slice(at, step).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about most bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + sum(map(len, row.get("texts") or [])) + len(row.get("text") or "") + len(row.get("audit") or "")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """df with its rows sent through fn, which reads a partition as a stream of dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _batches(fn(_rows(batches)), schema), ddl)


def _pieces(conversations: DataFrame, piece_rows: int, keep: bool) -> DataFrame:
    """One row per piece, stored: results where the piece is a whole conversation, its rows where not (keep: always)."""

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        part, seq = TaskContext.get().partitionId(), 0
        conv, held, size, sole, opening = None, [], 0, False, True

        def piece(whole: bool) -> dict:
            nonlocal seq
            turns, roles, texts = (list(x) for x in zip(*held, strict=True))
            out = {"conv_id": conv, "part": part, "seq": seq, "whole": whole}
            seq += 1
            if whole:
                out |= _whole(turns, roles, texts)
            if keep or not whole:
                out |= {"turns": turns, "roles": roles, "texts": texts}
            return out

        for r in rows:
            if held and r["conv_id"] != conv:
                yield piece(sole and not opening)
                held, size, sole, opening = [], 0, True, False
            elif held and (len(held) >= piece_rows or size >= PIECE_BYTES):
                yield piece(False)
                held, size, sole = [], 0, False
            conv = r["conv_id"]
            held.append((r["turn"], r["role"], r["text"]))
            size += len(r["text"])
        if held:  # the next range may go on with this conversation
            yield piece(False)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # keys of ranges are sampled, so they are short
    ranged = rows.repartitionByRange(*order, F.substring("role", 1, 32)).sortWithinPartitions(*order, "role", "text")
    return stored(_arrow(ranged, cut, f"conv_id long, {_PIECE}"))


def _searched(pieces: DataFrame) -> DataFrame:
    """(part, seq, found, costs, audits) of the pieces of conversations that are cut: faults, and all ways through."""
    key = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.md5(F.concat(F.length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"]).cast("binary")))
    rows = pieces.select("conv_id", "part", "seq", F.posexplode(key).alias("i", "key"))
    firsts = rows.groupBy("conv_id", "key").agg(F.min(F.struct("part", "seq", "i")).alias("f")).groupBy("f.part", "f.seq").agg(F.collect_list("f.i").alias("firsts"))

    def search(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            new = set(r["firsts"] or ())
            found = faults(r["roles"], r["texts"], lambda i, new=new: i not in new)
            costs, audits = Search([x[:1] for x in r["roles"]], found).table()
            yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "found": "".join(found), "costs": costs, "audits": audits}

    joined = pieces.select("conv_id", "part", "seq", "roles", "texts").join(firsts, ["part", "seq"], "left")
    return stored(_arrow(joined, search, "conv_id long, part int, seq int, found string, costs array<long>, audits array<string>"))


def _ahead(searched: DataFrame) -> DataFrame:
    """(part, seq, ahead): what is to pay after each piece, for each state at its end (-1: no way)."""

    def back(rows: Iterator[dict]) -> Iterator[dict]:
        conv, ahead = object(), []
        for r in rows:
            if r["conv_id"] != conv:
                conv, ahead = r["conv_id"], [CHANGE * len(TAIL[s]) for s in STATES]
            yield {"part": r["part"], "seq": r["seq"], "ahead": ahead}
            costs = [[c + a for c, a in zip(r["costs"][4 * p : 4 * p + 4], ahead, strict=True) if c >= 0 and a >= 0] for p in range(4)]
            ahead = [min(c, default=-1) for c in costs]

    thin = searched.select("conv_id", "part", "seq", "costs")
    return _arrow(thin.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")), back, "part int, seq int, ahead array<long>")


def _picked(pieces: DataFrame) -> DataFrame:
    """The pieces of cut conversations with found, costs, audits and ahead, each conversation's in order in one partition."""
    searched = _searched(pieces)
    joined = pieces.select("conv_id", "part", "seq", "turns", "roles", "texts").join(searched.drop("conv_id"), ["part", "seq"]).join(_ahead(searched), ["part", "seq"])
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def _pick(r: dict, state: str) -> tuple[int, str]:
    """Cost and edits of a piece: cheapest with what follows, then least in ASCII order."""
    at = 4 * STATES.index(state)
    ways = [(r["costs"][at + q] + r["ahead"][q], r["audits"][at + q], r["costs"][at + q]) for q in range(4) if r["costs"][at + q] >= 0 and r["ahead"][q] >= 0]
    _, audit, cost = min(ways)
    return cost, audit


def _together(rows: Iterator[dict]) -> Iterator[dict]:
    """One row of results per conversation from its pieces in order."""
    conv, state, out, digest, audits, any_yet, last, lowest, highest, n = object(), "^", None, None, [], False, None, None, None, 0

    def add(more: Iterator[tuple[str, str, str]]) -> None:
        nonlocal any_yet
        for _, role, text in more:
            digest.update(("\n" if any_yet else "").encode() + f"{role}:{text}".encode())
            any_yet = True

    def done() -> dict:
        add(edited([], [], TAIL[state], state))
        out["cost"] += CHANGE * len(TAIL[state])
        return out | {"gaps": highest - lowest + 1 - n if n else 0, "audit": "".join(audits) + TAIL[state], "repaired_sha256": digest.hexdigest()}

    for r in rows:
        if r["conv_id"] != conv:
            if out:
                yield done()
            conv, state, digest, audits, any_yet, last, lowest, highest, n = r["conv_id"], "^", sha256(), [], False, None, None, None, 0
            out = {"conv_id": conv} | dict.fromkeys((*_COUNTS, "cost"), 0)
            before: list[str] = []
        initials = [x[:1] for x in r["roles"]]
        out["illegal"] += _illegal(before + initials)
        before = initials[-1:]
        for name in ("blank", "duplicate", "truncated"):
            out[name] += r["found"].count(name[0])
        for t in r["turns"]:
            if t is not None:
                n += t != last
                last, lowest, highest = t, t if lowest is None else lowest, t
        cost, audit = _pick(r, state)
        out["cost"] += cost
        audits.append(audit)
        add(edited(r["roles"], r["texts"], audit, state))
        state = _after(r["roles"], audit, state)
    if out:
        yield done()


def repair(conversations: DataFrame, *, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    gaps are the turn numbers missing between the first and the last, illegal the pairs of neighbours whose role
    initials are none of su, ua and au, audit the initials of the cheapest edits, and the digest is that of the
    repaired lines role:text.
    """
    pieces = _pieces(conversations, piece_rows, keep=False)
    ddl = "conv_id long, " + ", ".join(f"{c} long" for c in _SUMMARY) + ", audit string, repaired_sha256 string"
    cut = _arrow(_picked(pieces.where("not whole")), _together, ddl)
    return pieces.where("whole").select(cut.columns).union(cut)


def repaired_turns(conversations: DataFrame, *, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, n, edit, role, text): the turns of the repaired conversations, n from 0 on, edit K, R or I."""

    def turns(rows: Iterator[dict]) -> Iterator[dict]:
        conv, state, n = object(), "^", 0

        def rest() -> Iterator[dict]:
            for i, (edit, role, text) in enumerate(edited([], [], TAIL[state], state)):
                yield {"conv_id": conv, "n": n + i, "edit": edit, "role": role, "text": text}

        for r in rows:
            if r["conv_id"] != conv:
                yield from rest()
                conv, state, n = r["conv_id"], "^", 0
            _, audit = _pick(r, state)
            for edit, role, text in edited(r["roles"], r["texts"], audit, state):
                yield {"conv_id": conv, "n": n, "edit": edit, "role": role, "text": text}
                n, state = n + 1, role[:1]
        yield from rest()

    def whole(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            for n, (edit, role, text) in enumerate(edited(r["roles"], r["texts"], r["audit"], "^")):
                yield {"conv_id": r["conv_id"], "n": n, "edit": edit, "role": role, "text": text}

    pieces = _pieces(conversations, piece_rows, keep=True)
    ddl = "conv_id long, n long, edit string, role string, text string"
    return _arrow(pieces.where("whole"), whole, ddl).union(_arrow(_picked(pieces.where("not whole")), turns, ddl))


def repair_all(ids: DataFrame, conversations: DataFrame) -> DataFrame:
    """repair() with a row for every id of ids: zeros, no edits and the digest of nothing where no rows are left."""
    found = repair(conversations)
    known = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    fill = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _SUMMARY} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest()))}
    mine = found.withColumnRenamed("conv_id", "id")
    return known.join(mine, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id").withColumns(fill)
