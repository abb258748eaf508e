"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

Turns go by turn (nulls first), then by role and text. Each turn's first fault counts: blank (no word), duplicate (its role and
text were seen earlier in the conversation), truncated (its last character beside white space is none of `.!?`). A turn is
kept (0), reroled to user or assistant (3), or deleted (4), which blank and duplicate turns must be; a truncated turn that is not
deleted costs 3 more; an empty turn of user or assistant may be inserted anywhere (3).

The retained turns (kept or reroled) are a subsequence, and the role of the last one is all that the next one depends on: none
yet, s, u or a. So for each of these the least cost less the deletions up to there (a prefix sum, 4 a turn) is kept as a running
minimum; a turn that is retained next adds the difference of the prefix sums, the inserts that the pair of roles asks for and
its own price. Of equal costs the least audit stays: the audits of two states never are prefixes of one another, so their
order is kept as a rank beside the costs and no string is built on the way. Costs relative to the least one, up to HOPELESS, and ranks take few
values, so a step is looked up in a table that fills itself. Deletions stand before inserts in a gap, as D < I.

Conversations of any length: rows are sorted in ranges over all tasks, and conversations that lie in one range and fit CHUNK turns
end there. The others are cut into chunks, each of which tells its costs and ranks from every state to every state; a fold over
these small tables picks the states at the cuts, and the chunks are then walked once more side by side. Only the
digest of a conversation runs through its pieces in order. Duplicates come from an aggregate over hashes of role and text.

Nulls: role and text are one space, a null turn is none for the gaps and comes first, null conv_ids are one conversation.
Repeated rows are duplicates but for the first. Conversations without turns give zeros, an empty audit and the hash of the empty
string. An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise, release

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A state that costs so much more than another never ends cheaper: whatever follows it, the other can follow with one turn
#: deleted and two inserted.
HOPELESS = 20
#: Turns of a chunk, and bytes of text after which it ends.
CHUNK, CHUNK_BYTES = 1000, 1 << 20
_NONE, _FAR = 0, 1 << 40
#: States are places in this string: no turn retained yet, then the role of the last one.
STATES = "-sua"
#: What must be inserted between a state and the next retained role, and at the end.
BETWEEN = {"-s": "", "-u": "", "-a": "u", "su": "", "sa": "u", "uu": "a", "ua": "", "au": "", "aa": "u"}
ENDING = {"-": "", "s": "ua", "u": "a", "a": ""}
LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}


@functools.cache
def step(least: tuple[int, ...], rank: tuple[int, ...], role: str, fault: str) -> tuple[tuple[int, ...], tuple[int, ...], int, tuple[tuple[int, str], ...]]:
    """After one turn: running minima less their least, ranks, that least, and for each state (state before, edit).

    `least` holds costs less the deletions so far. A turn that may be retained offers each role its cost in place of a deletion.
    """
    options = [[(least[y], rank[y], "D", y)] for y in range(4)]  # deleted: nothing but the prefix sum changes
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        for y in (1, 2, 3):
            new = STATES[y]
            for edit, price in (("K", 0), ("R", REROLE)):
                if new == role if edit == "K" else new != "s":
                    for x in range(4):
                        gap = BETWEEN.get(STATES[x] + new)
                        if gap is not None and least[x] < _FAR:
                            options[y].append((least[x] + INSERT * len(gap) + price + more - DELETE, rank[x], "I" * len(gap) + edit, x))
    best = [min(o) for o in options]
    order = sorted(range(4), key=lambda y: best[y][1:3])
    low = min(b[0] for b in best)
    ranks = [0] * 4
    for k, y in enumerate(order):
        ranks[y] = k
    return tuple(b[0] - low if b[0] - low <= HOPELESS else _FAR for b in best), tuple(ranks), low, tuple((b[3], b[2][-1]) for b in best)


def walk(turns: list[tuple[str, str]], state: int) -> tuple[list[int], list[int], list[tuple]]:
    """Over (role initial, fault) from one state: costs and ranks of the four states, and the edits by turn."""
    least, rank, total, edits = tuple(0 if k == state else _FAR for k in range(4)), (0, 1, 2, 3), 0, []
    for role, fault in turns:
        least, rank, low, edit = step(least, rank, role, fault)
        total += low
        edits.append(edit)
    return [c + total + DELETE * len(turns) if c < _FAR else _FAR for c in least], list(rank), edits


def ended(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """(cost, state) of the best end."""
    cost, _, state = min((costs[y] + INSERT * len(ENDING[STATES[y]]), ranks[y], y) for y in range(4))
    return cost, state


def edited(rows: list[tuple], edits: list[tuple], begin: int, state: int, last: bool) -> list[tuple[str, str, str]]:
    """(edit, role, text) in order, from state `begin` to `state`; rows are (turn, role, text, fault)."""
    back = []
    for edit in reversed(edits):
        before, what = edit[state]
        back.append((what, state))
        state = before
    out, now = [], begin
    for (_, role, text, _), (what, then) in zip(rows, reversed(back), strict=True):
        if what != "D":
            out += [("I", _NAMES[r], "") for r in BETWEEN[STATES[now] + STATES[then]]]
            now = then
        out.append((what, _NAMES[STATES[then]] if what == "R" else role, text))
    return out + ([("I", _NAMES[r], "") for r in ENDING[STATES[now]]] if last else [])


def _joined(turns: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for what, role, text in turns if what != "D").encode()


def _counts(rows: list[tuple]) -> dict:
    """What adds up over the chunks of a conversation, with what is needed at their cuts."""
    turns = [r[0] for r in rows if r[0] is not None]
    roles = [r[1][:1] for r in rows]
    faults = [r[3] for r in rows]
    found = {"rows": len(rows), "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}
    found |= {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t")}
    return found | {"illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)), "first_role": roles[0] if rows else None, "last_role": roles[-1] if rows else None}


def _added(a: dict, b: dict) -> dict:
    if not a["rows"] or not b["rows"]:
        return b if not a["rows"] else a
    out = {k: a[k] + b[k] for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first_role": a["first_role"], "last_role": b["last_role"]}


def _report(found: dict, cost: int) -> dict:
    gaps = 0 if found["low"] is None else found["high"] - found["low"] + 1 - found["turns"]
    return {"gaps": gaps, **{k: found[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = "rows long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_TURNS = "array<struct<edit string, role string, text string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of the damaged turns; dropped ones are not present, so their conversation is still known."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code").isin(0, 1), F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), "code")
    return rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code", "copy")


def faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text, fault, at): b, d, t, k (none) or x (not present); and the stored table that it reads."""
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "turns")
    code = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    coded = rows.withColumn("code", F.when(F.col("present"), code))
    firsts = coded.where("present").groupBy("conv_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "at")).alias("first")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("code").alias("f_code"), F.col("first.at").alias("first_at"))
    met = coded.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("code") == F.col("f_code")), "left")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(~F.col("present"), "x").when(F.ltrim(trimmed, F.lit(BLANKS)) == "", "b").when(F.col("at") != F.col("first_at"), "d").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k")
    return met.select("conv_id", "turn", "role", "text", fault.alias("fault"), "at"), rows


def _chunks(rows: DataFrame, texts: bool, most: int) -> DataFrame:
    """Sorted rows -> a row per conversation that ends here, and a row per chunk of the others.

    The first and the last conversation of a range may go on in others, so they are chunks.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, part int, seq int, whole boolean, report struct<{_REPORT}>, audit string, repaired_sha256 string, turns {_TURNS}, counts struct<{_COUNTS}>, costs array<array<long>>, ranks array<array<int>>, rows array<struct<turn long, role string, text string, fault string>>"
    kind = {"string": pa.string(), "int": pa.int32()}.get(conv, pa.int64())
    counts_type = pa.struct([(n, pa.string() if n.endswith("role") else pa.int64()) for n in (x.split()[0] for x in _COUNTS.split(", "))])
    report_type = pa.struct([(x.split()[0], pa.int64()) for x in _REPORT.split(", ")])
    turns_type = pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")]))
    rows_type = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]))
    types = [kind, pa.int32(), pa.int32(), pa.bool_(), report_type, pa.string(), pa.string(), turns_type, counts_type, pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32())), rows_type]
    names = ["conv_id", "part", "seq", "whole", "report", "audit", "repaired_sha256", "turns", "counts", "costs", "ranks", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, weight = TaskContext.get().partitionId(), [], 0

        def whole(conv_id, rows: list[tuple], seq: int) -> tuple:
            costs, ranks, edits = walk([(r[1][:1], r[3]) for r in rows], _NONE)
            cost, state = ended(costs, ranks)
            turns = edited(rows, edits, _NONE, state, True)
            shown = [dict(zip(("edit", "role", "text"), t, strict=True)) for t in turns] if texts else None
            return conv_id, part, seq, True, _report(_counts(rows), cost), "".join(t[0] for t in turns), hashlib.sha256(_joined(turns)).hexdigest(), shown, None, None, None, None

        def chunk(conv_id, rows: list[tuple], seq: int) -> tuple:
            walked = [walk([(r[1][:1], r[3]) for r in rows], x)[:2] for x in range(4)]
            given = [dict(zip(("turn", "role", "text", "fault"), r, strict=True)) for r in rows]
            return conv_id, part, seq, False, None, None, None, None, _counts(rows), [w[0] for w in walked], [w[1] for w in walked], given

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        now, held, size, seq, serial, begun, first = None, [], 0, 0, 0, False, True
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if begun and conv_id != now:
                    out.append((chunk if first or seq else whole)(now, held, serial))
                    weight += size + 100
                    held, size, seq, serial, first = [], 0, 0, serial + 1, False
                elif len(held) >= most or size >= CHUNK_BYTES:
                    out.append(chunk(now, held, serial))
                    weight += size + 100
                    held, size, seq, serial = [], 0, seq + 1, serial + 1
                if weight >= 4 << 20:
                    yield batch_of(out)
                    out, weight = [], 0
                now, begun = conv_id, True
                if fault != "x":
                    held.append((turn, role, text, fault))
                    size += len(text)
        if begun:
            out.append(chunk(now, held, serial))
        if out:
            yield batch_of(out)

    return rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, schema)


def folded(chunks: list[dict]) -> tuple[dict, list[tuple[int, int]]]:
    """The report of a conversation and the states (before, after) of each of its chunks, from their tables in order."""
    costs, ranks, found, back = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3], None, []
    for c in chunks:
        found = c["counts"] if found is None else _added(found, c["counts"])
        best = [min((min(costs[x] + c["costs"][x][y], _FAR), ranks[x], c["ranks"][x][y], x) for x in range(4)) for y in range(4)]
        order = sorted(range(4), key=lambda y: best[y][1:3])
        costs, ranks = [b[0] for b in best], [order.index(y) for y in range(4)]
        back.append([b[3] for b in best])
    cost, state = ended(costs, ranks)
    path = []
    for b in reversed(back):
        path.append((b[state], state))
        state = b[state]
    return _report(found, cost), path[::-1]


def _paths(chunks: DataFrame) -> DataFrame:
    """(part, seq, before, after, last, report) of every chunk."""
    tables = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "counts", "costs", "ranks"))).alias("chunks")).select("chunks")
    report_type = pa.struct([(x.split()[0], pa.int64()) for x in _REPORT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (given,) in zip(batch.column(0).to_pylist(), strict=True):
                report, path = folded(given)
                out += [(c["part"], c["seq"], x, y, k == len(path) - 1, report) for k, (c, (x, y)) in enumerate(zip(given, path, strict=True))]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32()] * 4 + [pa.bool_(), report_type])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "before", "after", "last", "report"])

    return tables.mapInArrow(run, f"part int, seq int, before int, after int, last boolean, report struct<{_REPORT}>")


def _pieces(chunks: DataFrame, paths: DataFrame, texts: bool) -> DataFrame:
    """(conv_id, part, seq, report, audit, repaired, turns) of every chunk, walked from its state before to its state after."""
    conv = chunks.schema["conv_id"].dataType
    given = chunks.select("conv_id", "part", "seq", "rows").join(paths, ["part", "seq"]).select("rows", "before", "after", "last", "conv_id", "part", "seq", "report")
    turns_type = pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, joined, shown = [], [], []
            for rows, before, after, last in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                rows = [(r["turn"], r["role"], r["text"], r["fault"]) for r in rows]
                turns = edited(rows, walk([(r[1][:1], r[3]) for r in rows], before)[2], before, after, last)
                audits.append("".join(t[0] for t in turns))
                joined.append(_joined(turns))
                shown.append([dict(zip(("edit", "role", "text"), t, strict=True)) for t in turns] if texts else None)
            columns = [*batch.columns[4:], pa.array(audits, pa.string()), pa.array(joined, pa.binary()), pa.array(shown, turns_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "report", "audit", "repaired", "turns"])

    return given.mapInArrow(run, f"conv_id {conv.simpleString()}, part int, seq int, report struct<{_REPORT}>, audit string, repaired binary, turns {_TURNS}")


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, report, audit, repaired_sha256): the pieces of each conversation run through its hash in order."""
    conv = pieces.schema["conv_id"].dataType.simpleString()
    kind = {"string": pa.string(), "int": pa.int32()}.get(conv, pa.int64())
    report_type = pa.struct([(x.split()[0], pa.int64()) for x in _REPORT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            columns = [pa.array([now], kind), pa.array([report], report_type), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "report", "audit", "repaired_sha256"])

        digest, now, report, audit, some = None, None, None, [], False
        for batch in batches:
            for conv_id, given, edits, joined in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest is None or conv_id != now:
                    if digest is not None:
                        yield result()
                    digest, now, report, audit, some = hashlib.sha256(), conv_id, given, [], False
                audit.append(edits)
                if joined:
                    digest.update(b"\n" + joined if some else joined)
                    some = True
        if digest is not None:
            yield result()

    rows = pieces.select("conv_id", "report", "audit", "repaired", "part", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return rows.select("conv_id", "report", "audit", "repaired").mapInArrow(run, f"conv_id {conv}, report struct<{_REPORT}>, audit string, repaired_sha256 string")


def _walked(turns: DataFrame, texts: bool, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The conversations and chunks of `_chunks`, and the pieces of the chunks."""
    rows, read = faults(turns)
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text", "at").sortWithinPartitions("conv_id", "turn", "role", "text", "at")
    made = materialise(_chunks(ordered, texts, chunk), "conversations")
    release(read)
    chunks = made.where("not whole")
    return made, _pieces(chunks, materialise(_paths(chunks), "paths"), texts)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `turns` has conv_id, turn, role, text and may have `present`: a row where it is false only names its conversation.
    """
    made, pieces = _walked(turns, False, chunk)
    out = made.where("whole").select("conv_id", "report", "audit", "repaired_sha256").unionByName(_digests(pieces))
    return out.select("conv_id", "report.*", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, seq, i, edit, role, text): the turns that stay, in the order of part, seq and i; edit is K, R or I."""
    made, pieces = _walked(turns, True, chunk)
    both = made.where("whole").select("conv_id", "part", "seq", "turns").unionByName(pieces.select("conv_id", "part", "seq", "turns"))
    return both.select("conv_id", "part", "seq", F.posexplode("turns").alias("i", "t")).where("t.edit != 'D'").select("conv_id", "part", "seq", "i", "t.*")
