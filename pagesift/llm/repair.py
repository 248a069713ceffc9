"""Conversation structure repair by iterative-deepening A*.

A conversation's roles must read: nothing, or an optional system turn and then user and assistant in turns. Rows are
kept, given another role or deleted, and empty turns are inserted. The cheapest edits are searched depth first in
ASCII order of their initials, under cost bounds that grow, with a table of states that failed; the first path that is
accepted is the cheapest and, of those, the least.

Conversations of any length are searched in segments of ``SEGMENT`` rows. A segment is searched once from each state
that it can begin in to each it can end in, so segments join exactly: edits before a row belong to the row's segment,
hence no segment's edits begin another's, and ties are settled segment by segment. Rows are sorted globally over
ranges, so that a conversation with a third of all rows is dealt to many tasks; only its costs, a few numbers for each
piece, and at last its result, which is one row, come together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.storage import lookup_join, materialize

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
FAR = 1 << 30
#: States: nothing yet, after system, after user, after assistant. For each: the state after an inserted or re-roled turn.
NEXT = (2, 2, 3, 2)
ROLE = (None, None, "user", "assistant")
#: What it costs to end in a state, and the edits: an assistant turn, or both, are inserted.
END = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
LEGAL = ("su", "ua", "au")
#: Rows that are searched as one, and bounds on the rows and text of a piece, which is one row of a table.
SEGMENT = 32
PIECE_ROWS = 4096
PIECE_CHARS = 4_000_000
SPACES = " \t\n\x0b\x0c\r"


def after_keep(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role may not follow."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "a":
        return 3 if state == 2 else None
    return 2 if initial == "u" and state != 2 else None


def lower_bounds(rows: list[tuple[str, str]]) -> list[int]:
    """For each place, what the rows from there on cost at least: each row alone, and neighbours that cannot both stay."""
    n = len(rows)
    own = [DELETE if f in "bd" else min(DELETE, (0 if i in ("s", "u", "a") else REROLE) + (TRUNCATED if f == "t" else 0)) for i, f in rows]
    low = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        low[k] = own[k] + low[k + 1]
        if k + 1 < n:
            pair = own[k] + own[k + 1]
            (a, f), (b, g) = rows[k], rows[k + 1]
            if f in "-t" and g in "-t" and a in ("s", "u", "a") and b in ("s", "u", "a") and a + b not in LEGAL:
                pair = max(pair, min(own[k] + own[k + 1] + INSERT, DELETE + own[k + 1], own[k] + DELETE))
            low[k] = max(low[k], pair + low[k + 2])
    return low


def search(rows: list[tuple[str, str]], entry: int, goal: int, low: list[int] | None = None) -> tuple[int, str | None]:
    """Cost and edits from state ``entry`` over all ``rows`` (role initial and fault) to state ``goal``; (FAR, None) if there are none.

    Faults are ``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none. The last edit is one of the last row.
    """
    low = low or lower_bounds(rows)
    n = len(rows)
    failed: dict[tuple[int, int], int] = {}  # states and the least cost that is left open by what has failed
    path: list[str] = []

    def least(k: int, state: int) -> int:
        if goal < 2 and state > goal:  # no edit leads back to the beginning
            return FAR
        return failed.get((k, state), low[k])

    def edits(k: int, state: int):
        initial, fault = rows[k]
        cut = TRUNCATED if fault == "t" else 0
        yield "D", DELETE, k + 1, state
        yield "I", INSERT, k, NEXT[state]
        if fault in "-t":
            kept = after_keep(state, initial)
            if kept is not None:
                yield "K", KEEP + cut, k + 1, kept
            yield "R", REROLE + cut, k + 1, NEXT[state]

    def visit(k: int, state: int, budget: int) -> int:
        """-1 with the edits in ``path`` if the goal is within ``budget``, else what it costs at least."""
        if least(k, state) > budget:
            return least(k, state)
        if k == n:
            return -1 if state == goal else FAR
        best = FAR
        for edit, cost, k2, state2 in edits(k, state):
            found = cost + least(k2, state2)
            if found <= budget:
                below = visit(k2, state2, budget - cost)
                if below < 0:
                    path.append(edit)
                    return -1
                found = cost + below
            best = min(best, found)
        failed[k, state] = best
        return best

    bound = least(0, entry)
    while bound < FAR:
        found = visit(0, entry, bound)
        if found < 0:
            return bound, "".join(reversed(path))
        bound = found
    return FAR, None


def searched(rows: list[tuple[str, str]], entries) -> tuple[list[int], list[str]]:
    """Costs and edits of a segment by ``4 * entry + goal``."""
    low = lower_bounds(rows)
    costs, audits = [FAR] * 16, [""] * 16
    for entry in entries:
        for goal in range(4):
            cost, audit = search(rows, entry, goal, low)
            if audit is not None:
                costs[4 * entry + goal], audits[4 * entry + goal] = cost, audit
    return costs, audits


def ranks(costs: list[int], audits: list[str]) -> list[int]:
    """The place of each goal's edits among those of the same entry, by ASCII."""
    out = [0] * 16
    for entry in range(0, 16, 4):
        for place, k in enumerate(sorted((k for k in range(entry, entry + 4) if costs[k] < FAR), key=lambda k: audits[k])):
            out[k] = place
    return out


def joined(costs: list[list[int]], order: list[list[int]], entry: int, end: dict[int, int]) -> tuple[int, list[int]]:
    """The cheapest way through all segments from ``entry`` to the states of ``end`` with their costs: its cost and the index of each segment."""
    left = [[end.get(s, FAR) for s in range(4)]]
    for c in reversed(costs):
        after = left[-1]
        left.append([min(FAR, min(c[4 * s + t] + after[t] for t in range(4))) for s in range(4)])
    left.reverse()
    total = left[0][entry]
    if total >= FAR:
        return FAR, []
    way, state = [], entry
    for k, (c, o) in enumerate(zip(costs, order)):
        state = min((t for t in range(4) if c[4 * state + t] + left[k + 1][t] == left[k][state]), key=lambda t: o[4 * state + t])
        way.append(4 * (way[-1] % 4 if way else entry) + state)
    return total, way


def searched_piece(rows: list[tuple[str, str]], entries, segment: int = SEGMENT) -> tuple[list[int], list[str]]:
    """As ``searched``, for more rows than one segment."""
    parts = [rows[k : k + segment] for k in range(0, len(rows), segment)]
    found = [searched(part, entries if not k else range(4)) for k, part in enumerate(parts)]
    if len(found) == 1:
        return found[0]
    order = [ranks(*f) for f in found]
    costs, audits = [FAR] * 16, [""] * 16
    for entry in entries:
        for goal in range(4):
            cost, way = joined([c for c, _ in found], order, entry, {goal: 0})
            if cost < FAR:
                costs[4 * entry + goal], audits[4 * entry + goal] = cost, "".join(a[w] for (_, a), w in zip(found, way))
    return costs, audits


def repaired(roles: list[str], texts: list[str], audit: str, state: int):
    """Yield ``role:text`` of the rows that the edits give, from ``state`` on."""
    k = 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        if edit == "K":
            state = after_keep(state, roles[k][:1])
            yield f"{roles[k]}:{texts[k]}"
            k += 1
            continue
        state = NEXT[state]
        yield f"{ROLE[state]}:{texts[k] if edit == 'R' else ''}"
        k += edit == "R"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text and ``n``, how often the row stands, with damage by the crc32 of ``conv_id:turn``. Nulls count as one space."""
    blank = F.lit(" ")
    mark = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), text.alias("text"), mark.alias("mark")).where("mark <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("mark") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """One row for each row that stands, with its first fault: ``b``, ``d``, ``t`` or ``-``.

    Rows are first counted by conversation, turn and digest of role and text, which combines before the shuffle, so
    a row that stands very often is one row until it is dealt out again.
    """
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    counted = rows.groupBy("conv_id", "turn", digest.alias("digest")).agg(F.sum("n").alias("n"), F.min("role").alias("role"), F.min("text").alias("text"))
    counted = materialize(counted, "rows")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = materialize(counted.groupBy("conv_id", "digest").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1"), "again").select(F.struct("conv_id", "digest", "first").alias("g"))
    flagged = lookup_join(counted, again, F.col("conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("digest") == F.col("g.digest")), "left")
    single = flagged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    seen = (F.col("copy") > 1) | (F.col("g").isNotNull() & (F.col("g.first") < place))
    words = F.rtrim("text", F.lit(SPACES))
    fault = F.when(words == "", "b").when(seen, "d").when(~F.right(words, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    return single.select("conv_id", "turn", "digest", "copy", "role", "text", fault.alias("fault"))


COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"
WAYS = "costs array<int>, ranks array<int>"


def _schema(conv: str, *parts: str) -> str:
    return ", ".join((f"conv_id {conv}", "part int", "seq int", *parts))


def _arrow(kind: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def _in_order(df: DataFrame) -> DataFrame:
    """Pieces by conversation, each conversation's in their order within one task, which reads them as a stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def pieces(rows: DataFrame, segment: int = SEGMENT, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rows that follow one another, in pieces with the costs and edits from each state to each: one row a piece, written.

    Order: turn, nulls first; rows of one turn by the digest of role and text, so that copies are neighbours.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "digest", "copy"]
    kind = _schema(conv, COUNTS, WAYS, "audits array<string>", "roles array<string>", "texts array<string>")
    arrow = _arrow(kind)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list] = {"turn": [], "role": [], "text": [], "fault": []}
        conv_id, known, seq, chars, out = None, False, 0, 0, []

        def close(first: bool):
            roles, faults = held["role"], held["fault"]
            initials = [r[:1] for r in roles]
            # the first conversation of a task may go on from the task before
            costs, audits = searched_piece(list(zip(initials, faults)), range(1) if first else range(4), segment)
            turns = [t for t in held["turn"] if t is not None]
            out.append({
                "conv_id": conv_id, "part": part, "seq": seq,
                **{name: faults.count(f) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))},
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
                "head": initials[0], "tail": initials[-1],
                "costs": costs, "ranks": ranks(costs, audits), "audits": audits, "roles": roles[:], "texts": held["text"][:],
            })
            for values in held.values():
                values.clear()

        inside = False  # whether an earlier conversation stood in this task
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns):
                if known and (row[0] != conv_id or len(held["role"]) >= piece_rows or chars >= piece_chars):
                    close(inside and not seq)
                    seq, chars, inside = (seq + 1, 0, inside) if row[0] == conv_id else (0, 0, True)
                conv_id, known = row[0], True
                for name, value in zip(("turn", "role", "text", "fault"), row[1:]):
                    held[name].append(value)
                chars += len(row[3])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if known:
            close(inside and not seq)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    return materialize(dealt.mapInArrow(cut, kind), "pieces", batch=1000)


def chosen(cut: DataFrame) -> DataFrame:
    """For each piece which of its ways is taken (``pick``), with the conversation's figures and edits after its last row on its last piece."""
    kind = _schema(cut.schema["conv_id"].dataType.simpleString(), "pick int", "after string", "gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    arrow = _arrow(kind)

    def choose(batches):
        import pyarrow as pa

        held: list[dict] = []

        def close() -> list[dict]:
            cost, way = joined([r["costs"] for r in held], [r["ranks"] for r in held], 0, {s: c for s, (c, _) in END.items()})
            seen = [r for r in held if r["turns"]]
            same = sum(a["high"] == b["low"] for a, b in zip(seen, seen[1:]))
            gaps = seen[-1]["high"] - seen[0]["low"] + 1 - (sum(r["turns"] for r in seen) - same) if seen else 0
            sums = {name: sum(r[name] for r in held) for name in ("blank", "duplicate", "truncated", "illegal")}
            sums["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(held, held[1:]))
            out = [{"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "pick": pick} for r, pick in zip(held, way)]
            out[-1].update(after=END[way[-1] % 4][1], gaps=gaps, cost=cost, **sums)
            held.clear()
            return out

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    out += close()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(close(), schema=arrow)

    return _in_order(cut.drop("audits", "roles", "texts")).mapInArrow(choose, kind)


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, segment: int = SEGMENT, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rows conv_id, the figures of its faults, the cost and ``audit`` of its cheapest repair, and the digest of the repaired rows.

    ``conversations`` has rows ``conv_id, turn, role, text, n`` (n: how often the row stands, one after the other), as
    ``damage`` gives; role and text are not null, turn may be, conv_id too, and is then a conversation of its own. Texts
    may be of any length; a conversation's digest is taken in a stream, its audit is one value of its result row.
    """
    cut = pieces(with_faults(conversations), segment, piece_rows, piece_chars)
    way = materialize(chosen(cut), "ways").select(F.struct("*").alias("w"))
    on = F.col("conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("part") == F.col("w.part")) & (F.col("seq") == F.col("w.seq"))
    audit = F.element_at("audits", F.col("w.pick") + 1)
    edits = cut.join(way, on).select("conv_id", "part", "seq", (F.col("w.pick") / 4).cast("int").alias("state"), audit.alias("edits"), "roles", "texts", "w.after", "w.gaps", "w.blank", "w.duplicate", "w.truncated", "w.illegal", "w.cost")
    kind = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, {FIGURES}"
    arrow = _arrow(kind)

    def apply(batches):
        import hashlib

        import pyarrow as pa

        digest, audit, rows = hashlib.sha256(), [], 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit.append(r["edits"])
                for line in repaired(r["roles"], r["texts"], r["edits"] + (r["after"] or ""), r["state"]):
                    digest.update((("\n" if rows else "") + line).encode("utf-8", "surrogatepass"))
                    rows += 1
                if r["after"] is not None:  # the last piece
                    figures = {k: r[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                    out.append(figures | {"audit": "".join(audit) + r["after"], "repaired_sha256": digest.hexdigest()})
                    digest, audit, rows = hashlib.sha256(), [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _in_order(edits).mapInArrow(apply, kind)


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the undamaged table: what ``repair`` gives on its damaged rows, zeros where none are left."""
    found = materialize(repair(damage(conversations)), "repairs", batch=1000).select(F.struct("*").alias("r"))
    ids = conversations.select("conv_id").distinct()
    joined_ids = ids.join(found, F.col("conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    zeros = (F.coalesce(f"r.{k}", F.lit(0).cast("long")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined_ids.select("conv_id", *zeros, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
