"""Operator 12: conversations repaired to the grammar ``(system? (user assistant)+)?`` by cost layers.

Turns are edited at the costs KEEP, REROLE, DELETE and INSERT; blank turns and repeats must go, and a truncated turn that stays costs
TRUNCATED more. States of the grammar are the start, after system, after user and after assistant. For each turn and each cost a
bitset holds the states from which the rest of the conversation can be accepted at that cost or less. The layer of a cost at a
turn comes from lower layers at the next turn (an edit) and at the same turn (an insert), by table lookups on bitsets, for all
conversations of a batch and all layers at once. The first layer that holds the start state at the first turn gives the cost. From there the
trace follows the bits: of the edits that lead to a set bit of the layer that remains, the least initial in ASCII is taken (D, I, K,
R). An initial fixes the next state, so this greedy trace is the least audit of all cheapest ones.

Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any size is spread over tasks, and cut into chunks of
at most CHUNK_ROWS rows and about CHUNK_BYTES of text. Most conversations are one chunk. For others, a chunk's layers run from each state it
could end in to each it could begin in (four bitsets a turn): its costs are a 4 x 4 matrix. Folding these from the end of the
conversation gives each chunk the cost of all that follows it by state; traces from each entry state then say where a chunk would be left, and
folding those from the front picks one. Only matrices and exits of a conversation meet in a task, a few numbers a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Costs of edits; what a truncated turn that stays costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of text of a chunk; rows whose layers are held at once.
CHUNK_ROWS, CHUNK_BYTES, BLOCK = 4096, 4_000_000, 64
#: Grammar: states start, after system, after user, after assistant; where each initial leads (-1: nowhere); accepting states.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1), "x": (-1, -1, -1, -1)}
ACCEPTING = (START, ASSISTANT)
#: Letters of a script: keep, delete, rerole to user or assistant, insert user or assistant; and their audit initials.
SCRIPT, AUDIT = "KDUAij", "KDRRII"
FAR = 1 << 40


def _from(initials: str) -> np.ndarray:
    """By bitset of states after an edit: the states before it that one of these initials leads there from."""
    return np.array([sum(1 << s for s in range(4) if any(NEXT[x][s] >= 0 and after >> NEXT[x][s] & 1 for x in initials)) for after in range(16)], np.uint8)


#: Lookup tables: edits that keep a turn of each initial, and that put a user or assistant there.
_KEEPS = np.stack([_from(x) for x in "suax"])
_PUTS = _from("ua")
_CODE = {x: i for i, x in enumerate("suax")}


def _later(sets: np.ndarray, by: int) -> np.ndarray:
    """Layers moved up by a cost, along the first axis."""
    out = np.zeros_like(sets)
    out[by:] = sets[: len(sets) - by] if by else sets
    return out


def layers(initial: np.ndarray, gone: np.ndarray, short: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bitsets (turn, cost, sequence, ...) of sequences of n turns: initial, gone (must be deleted), short (truncated) are (n, m).

    ``last``: bitsets (cost, m, ...) at the end, with inserts there already made. Gone turns of -1 in ``initial`` are padding at no cost.
    """
    n = len(initial)
    out = np.zeros((n + 1, *last.shape), np.uint8)
    out[n] = last
    wide = (..., *[None] * (last.ndim - 2))
    for i in range(n - 1, -1, -1):
        after = out[i + 1]
        stay, off, pad = ~gone[i], short[i], initial[i] < 0
        kept = np.zeros_like(after)
        for code in range(4):
            who = stay & (initial[i] == code)
            if who.any():
                kept[:, who] = _KEEPS[code][after[:, who]]
        put = np.where(stay[wide], _PUTS[after], 0).astype(np.uint8)
        put = _later(put, REROLE)
        late = off[wide]
        now = np.where(late, _later(kept | put, TRUNCATED), kept | put) | _later(after, DELETE)
        for _ in range(3):  # a fourth insert leads nowhere new
            now |= _later(_PUTS[now], INSERT)
        out[i] = np.where(pad[wide], after, now)
    return out


def _ends(to: np.ndarray, depth: int) -> np.ndarray:
    """Bitsets (depth, m) of the end: the states whose cost in ``to`` (m, 4) is at most that of each layer."""
    return ((to[None] <= np.arange(depth)[:, None, None]) * np.array([1, 2, 4, 8])).sum(2).astype(np.uint8)


def accept_costs() -> np.ndarray:
    """Cost of each state at the end of a conversation: inserts up to an accepting one."""
    cost = np.full(4, FAR)
    cost[list(ACCEPTING)] = 0
    for _ in range(3):
        for s in range(4):
            for x in "ua":
                if NEXT[x][s] >= 0:
                    cost[s] = min(cost[s], INSERT + cost[NEXT[x][s]])
    return cost


def _pad(codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns of sequences (see :func:`code`) as arrays (n, m), padded at the front."""
    n = max(map(len, codes), default=0)
    raw = np.full((n, len(codes)), 255, np.uint8)
    for j, c in enumerate(codes):
        if c:
            raw[n - len(c) :, j] = np.frombuffer(c.encode("ascii"), np.uint8)
    initial = np.full(raw.shape, -1)
    for x, k in _CODE.items():
        initial[(raw == ord(x)) | (raw == ord(x.upper()))] = k
    initial[raw == ord("d")] = _CODE["x"]
    return initial, raw == ord("d"), np.isin(raw, [ord(x.upper()) for x in "suax"])


def _deepest(n: int) -> int:
    """No way through n turns from a state to another that can be reached costs more: delete all, three inserts; and its layers."""
    return DELETE * n + 3 * INSERT + 1


def matrices(codes: list[str]) -> np.ndarray:
    """(m, 4, 4) least costs from each state before a block to each after it, without inserts at the end."""
    initial, gone, short = _pad(codes)
    depth = _deepest(len(initial))
    last = np.broadcast_to(np.array([1, 2, 4, 8], np.uint8), (depth, len(codes), 4)).copy()
    sets = layers(initial, gone, short, last)[0]  # (cost, m, exit)
    out = np.full((len(codes), 4, 4), FAR)
    for s in range(4):
        has = sets >> s & 1 > 0
        out[:, s, :] = np.where(has.any(0), has.argmax(0), FAR)
    return out


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through a matrix and then a matrix or vector of costs."""
    b = b if b.ndim == 2 else b[:, None]
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def traces(codes: list[str], to: np.ndarray, entry: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(scripts, exits, costs) of the least cheapest audits of blocks, from states ``entry`` (m) on, where ``to`` (m, 4) is the cost of what
    follows by state. Scripts of entries from which nothing is accepted are empty and their exits are -1.
    """
    initial, gone, short = _pad(codes)
    n, m = initial.shape
    low = np.where((to < FAR).any(1), np.where(to < FAR, to, FAR).min(1), 0)
    to = np.where(to < FAR, to - low[:, None], FAR)  # costs that all ways share need no layers
    depth = _deepest(n) + int(np.where(to < FAR, to, 0).max(initial=0))
    sets = layers(initial, gone, short, _ends(to, depth))
    scripts: list[str] = []
    exits, costs = np.full(m, -1), np.full(m, FAR)
    for j in range(m):
        state, at, out = int(entry[j]), 0, []
        first = sets[0, :, j] >> state & 1
        if not first.any():
            scripts.append("")
            continue
        left = int(first.argmax())
        costs[j] = left + low[j]

        def leads(i: int, s: int, cost: int, j: int = j) -> bool:
            return s >= 0 and cost >= 0 and bool(sets[i, cost, j] >> s & 1)

        while at < n:
            code = int(initial[at, j])
            if code < 0:
                at += 1
                continue
            more = TRUNCATED * int(short[at, j])
            put = next(((x, NEXT[x][state]) for x in "ua" if NEXT[x][state] >= 0), None)
            if leads(at + 1, state, left - DELETE):
                out.append("D")
                at, left = at + 1, left - DELETE
            elif put and leads(at, put[1], left - INSERT):
                out.append("i" if put[0] == "u" else "j")
                state, left = put[1], left - INSERT
            elif not gone[at, j] and leads(at + 1, NEXT["suax"[code]][state], left - KEEP - more):
                out.append("K")
                at, state, left = at + 1, NEXT["suax"[code]][state], left - KEEP - more
            else:
                assert put and not gone[at, j]
                out.append(put[0].upper())
                at, state, left = at + 1, put[1], left - REROLE - more
        scripts.append("".join(out))
        exits[j] = state
    return scripts, exits, costs


def _closing(state: int) -> str:
    """Inserts at the end of a conversation."""
    out = ""
    while state not in ACCEPTING:
        x, state = next((x, NEXT[x][state]) for x in "ua" if NEXT[x][state] >= 0)
        out += "i" if x == "u" else "j"
    return out


def _blocks(code: str) -> list[str]:
    return [code[i : i + BLOCK] for i in range(0, len(code), BLOCK)]


def chunk_matrix(code: str) -> np.ndarray:
    whole = np.full((4, 4), FAR)
    np.fill_diagonal(whole, 0)
    for a in matrices(_blocks(code)):
        whole = chain(whole, a)
    return whole


def chunk_script(code: str, entry: int, to: np.ndarray) -> tuple[str, int, int]:
    """(script, exit, cost with all that follows) of a chunk from a state, block after block."""
    parts = _blocks(code)
    after = [to]
    for a in matrices(parts)[:0:-1]:
        after.append(chain(a, after[-1])[:, 0])
    out, cost = [], int(to[entry]) if not parts else None
    for part, then in zip(parts, reversed(after)):
        got, exits, costs = traces([part], then[None], np.array([entry]))
        cost = int(costs[0]) if cost is None else cost
        if exits[0] < 0:
            return "", -1, FAR
        out.append(got[0])
        entry = int(exits[0])
    return "".join(out), entry, int(cost)


def batch_scripts(codes: list[str]) -> list[tuple[str, int]]:
    """(script, cost) of whole conversations, those of up to BLOCK turns together by length."""
    out: list[tuple[str, int] | None] = [None] * len(codes)
    close = accept_costs()
    small = sorted((len(c), k) for k, c in enumerate(codes) if len(c) <= BLOCK)
    for lo in range(0, len(small), 512):
        ks = [k for _, k in small[lo : lo + 512]]
        scripts, exits, costs = traces([codes[k] for k in ks], np.repeat(close[None], len(ks), 0), np.zeros(len(ks), int))
        for k, s, x, c in zip(ks, scripts, exits, costs):
            out[k] = (s + _closing(int(x)), int(c))
    for k, c in enumerate(codes):
        if out[k] is None:
            s, x, cost = chunk_script(c, START, close)
            out[k] = (s + _closing(x), cost)
    return out  # type: ignore[return-value]


# -- Spark -----------------------------------------------------------------------------------------------------------

#: White space of the contract, and what ends a sentence.
_BLANK, _SEEN, _ENDED = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def code(initial: Column, gone: Column, short: Column) -> Column:
    """One letter a turn: the initial (x if it is none of s, u, a), upper case where truncated, d where it must be deleted."""
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(gone, "d").when(short, F.upper(letter)).otherwise(letter)


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault) of turns: blank, duplicate, truncated or null; null roles and texts are one space.

    A column ``copies`` says how often a row is there. Equal rows become one with their number, of which only the first can be no duplicate. An earlier turn of the same
    role and text makes a duplicate; nulls come first.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies") if "copies" in turns.columns else F.lit(1).alias("copies"))
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    key = F.md5(F.col("text").cast("binary"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = t.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), key.alias("k")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    t = t.join(again, t["conv_id"].eqNullSafe(again["c"]) & (t["role"] == again["r"]) & (key == again["k"]), "left")
    fault = (
        F.when(~F.col("text").rlike(_SEEN), "blank").when(F.col("first").isNotNull() & (order != F.col("first")), "duplicate").when(~F.col("text").rlike(_ENDED), "truncated")
    )
    return t.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_CHUNK = "conv_id long, chunk long, code string, initials string, turns array<struct<role: string, text: string>>, script string, cost long"


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("code", pa.string()), ("initials", pa.string()), ("turns", pa.list_(_TURN)), ("script", pa.string()), ("cost", pa.int64())])


def _chunks(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row a chunk out of sorted rows; script and cost are those of a conversation that is this chunk alone."""
    task, no, held, size = TaskContext.get().partitionId(), 0, 0, 0
    done: list[dict] = []
    now: dict | None = None

    def flush() -> pa.RecordBatch:
        codes = ["".join(d["code"]) for d in done]
        for d, c, (script, cost) in zip(done, codes, batch_scripts(codes)):
            d |= {"code": c, "initials": "".join(d["initials"]), "script": script, "cost": cost}
        return pa.RecordBatch.from_pylist(done, schema=_ARROW)

    for batch in batches:
        for conv, role, text, letter, initial, copies in zip(*(c.to_pylist() for c in batch.columns)):
            for copy in range(copies):
                if now is None or conv != now["conv_id"] or len(now["code"]) >= most_rows or size >= most_bytes:
                    if held >= most_bytes or len(done) >= most_rows:
                        yield flush()
                        done, held = [], 0
                    now, size = {"conv_id": conv, "chunk": (task << 40) + no, "code": [], "initials": [], "turns": []}, 0
                    done.append(now)
                    no += 1
                now["code"].append("d" if copy else letter)
                now["initials"].append(initial)
                now["turns"].append({"role": role, "text": text})
                size += len(role) + len(text) + 8
                held += len(role) + len(text) + 8
    if done:
        yield flush()


def _split_scripts(chunks: DataFrame) -> DataFrame:
    """(chunk, split_script, split_cost) of the conversations of several chunks; their cost stands in the first."""

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = [chunk_matrix(c).ravel().tolist() for c in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), pa.array(grid, pa.list_(pa.int64()))], names=["conv_id", "chunk", "grid"])

    def back(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        to, out = accept_costs(), []
        for m in reversed(t.column("grid").to_pylist()):
            out.append(to.tolist())
            to = chain(np.array(m).reshape(4, 4), to)[:, 0]
        last = [False] * (len(out) - 1) + [True]
        return pa.table({"chunk": t.column("chunk"), "to": pa.array(out[::-1], pa.list_(pa.int64())), "last": last})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exits, costs, scripts = [], [], []
            for code_, to, last in zip(*(b.column(c).to_pylist() for c in ("code", "to", "last"))):
                got = [chunk_script(code_, s, np.array(to)) for s in range(4)]
                exits.append([g[1] for g in got])
                costs.append([g[2] for g in got])
                scripts.append([g[0] + (_closing(g[1]) if last and g[1] >= 0 else "") for g in got])
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), pa.array(exits, numbers), pa.array(costs, numbers), pa.array(scripts, pa.list_(pa.string()))], names=["conv_id", "chunk", "exits", "costs", "scripts"])

    def forth(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        state, entry = START, []
        for exits in t.column("exits").to_pylist():
            entry.append(state)
            state = exits[state]
        return pa.table({"chunk": t.column("chunk"), "entry": pa.array(entry, pa.int32()), "first": [True] + [False] * (len(entry) - 1)})

    # of a conversation only numbers meet in one task, a row of 16 and then of 4 a chunk
    to = chunks.select("conv_id", "chunk", "code").mapInArrow(grids, "conv_id long, chunk long, grid array<long>").groupBy("conv_id").applyInArrow(back, "chunk long, to array<long>, last boolean")
    told = chunks.select("conv_id", "chunk", "code").join(to, "chunk").mapInArrow(follow, "conv_id long, chunk long, exits array<long>, costs array<long>, scripts array<string>")
    told = materialize(told, "repair-scripts")
    entry = told.select("conv_id", "chunk", "exits").groupBy("conv_id").applyInArrow(forth, "chunk long, entry int, first boolean")
    return told.join(entry, "chunk").select("chunk", F.expr("scripts[entry]").alias("split_script"), F.when(F.col("first"), F.expr("costs[entry]")).otherwise(0).alias("split_cost"))


def repair_rows(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """:func:`repair` of rows that :func:`faults` has made."""
    initial = F.substring("role", 1, 1)
    is_ = lambda *names: F.coalesce(F.col("fault").isin(*names), F.lit(False))
    keys = ["conv_id", "seen", "turn", "role", "text"]
    t = rows.select(
        "conv_id", F.col("turn").isNotNull().alias("seen"), "turn", "role", "text", code(initial, is_("blank", "duplicate"), is_("truncated")).alias("code"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), "copies",
    )
    t = t.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text", "code", "initial", "copies")
    out = materialize(t.mapInArrow(lambda batches: _chunks(batches, chunk_rows, chunk_bytes), _CHUNK), "repair-chunks")
    several = out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    split = out.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    if not split.isEmpty():
        out = out.join(_split_scripts(split), "chunk", "left")
        out = out.withColumn("script", F.coalesce("split_script", "script")).withColumn("cost", F.coalesce("split_cost", "cost"))
    step = F.regexp_extract_all("script", F.lit("[ij]*[DKUA]|[ij]+$"), 0)

    def line(turn: Column, letter: Column) -> Column:
        role = F.when(letter.isin("i", "U"), "user").when(letter.isin("j", "A"), "assistant").when(letter == "K", turn["role"])
        return F.struct(role.alias("role"), F.when(letter.isin("i", "j"), "").otherwise(turn["text"]).alias("text"))

    made = F.flatten(F.zip_with("turns", step, lambda r, s: F.filter(F.transform(F.split(s, ""), lambda x: line(r, x)), lambda x: x["role"].isNotNull())))
    return out.select("conv_id", "chunk", "initials", "script", "cost", "turns", made.alias("repaired"))


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, initials, script, cost, turns, repaired): each conversation as chunks in the order of ``chunk``.

    turns: its rows (role, text) by turn (nulls first), role and text; initials: a letter for each, x if it is none of s, u, a; script: a
    letter of SCRIPT for each edit; repaired: the (role, text) that come out. The cost of a conversation stands in its first chunk, the
    others have 0. Null roles and texts count as one space, a null conv_id is a conversation, repeated rows are duplicates;
    other columns are ignored; no rows give no rows.
    """
    return repair_rows(faults(turns.select("conv_id", "turn", "role", "text")))


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` damaged by a checksum of conversation and turn: dropped, emptied, without sentence ends, repeated or all user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = materialize(faults(damage(turns)), "repair-rows")
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    part = F.struct("chunk", "initials", F.translate("script", "UAij", "RRII").alias("audit"), F.when(F.size("repaired") > 0, lines).alias("lines"))
    conv = repair_rows(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.sum("cost").alias("cost"))
    join = lambda f, by="": F.array_join(F.transform("p", lambda x: x[f]), by)
    conv = conv.select(
        F.col("conv_id").alias("c"), "cost", join("audit").alias("audit"), F.sha2(join("lines", "\n").cast("binary"), 256).alias("sha"),
        (F.length(join("initials")) - 1 - F.regexp_count(join("initials"), F.lit("(?=su|ua|au)"))).alias("illegal"),
    )
    is_ = lambda f: F.coalesce(F.col("fault") == f, F.lit(False))
    more = F.when(is_("blank"), 0).otherwise(F.col("copies") - F.when(is_("duplicate"), 0).otherwise(1))  # the first of equal rows is no duplicate by itself
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(is_("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(more).alias("duplicate"), F.sum(is_("truncated").cast("int")).alias("truncated"),
    )
    found = found.join(conv, F.col("conv_id").eqNullSafe(F.col("c"))).drop("conv_id")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(
        "conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
#: An independent way: the cheapest (cost, audit, lines) to each state, turn after turn, with zero to two inserts before each edit.
ORACLE_SQL = {
    "op12_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hit AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
), told AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, count(*) OVER (PARTITION BY conv_id) AS size,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM numbered
), ins(s, t, k, audit, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']),
    (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 2, 3, 'I', ['user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])
), edit(s, t, act, initial) AS (
  VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
    (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL)
), way AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM told)
  UNION ALL
  SELECT w.conv_id, w.n + 1, e.t, min({'cost': w.best.cost + i.k + CASE e.act WHEN 'D' THEN 4 ELSE CASE e.act WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END END,
    'audit': w.best.audit || i.audit || e.act,
    'lines': list_concat(list_concat(w.best.lines, i.lines), CASE e.act WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END)})
  FROM way w JOIN told r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1 JOIN ins i ON i.s = w.s JOIN edit e ON e.s = i.t
  WHERE (e.act = 'D' OR coalesce(r.fault, '') NOT IN ('blank', 'duplicate')) AND (e.act <> 'K' OR e.initial = r.initial)
  GROUP BY w.conv_id, w.n + 1, e.t
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.k, 'audit': w.best.audit || i.audit, 'lines': list_concat(w.best.lines, i.lines)}) AS best
  FROM way w JOIN (SELECT conv_id, max(size) AS size FROM told GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.size = w.n JOIN ins i ON i.s = w.s WHERE i.t IN (0, 3) GROUP BY w.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
}
