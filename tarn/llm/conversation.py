"""Conversation structure repair by composition of weighted finite-state machines.

Three machines are composed lazily: the input acceptor, whose symbols are a conversation's
rows in order; an edit transducer, which keeps, reroles or deletes a row and inserts rows
before it; and the acceptor of the role grammar. Weights are (cost, edits' initials): the
sum takes the lesser, cost first, then the initials in ASCII order; the product adds and
joins. The composed machine is acyclic, since no cheapest path inserts more than two rows
in a place, so one pass in topological order finds the shortest path.

Rows are dealt to partitions by ranges of (conversation, turn), so a conversation lies in
neighbouring partitions, whatever its size. A partition cuts conversations into chunks of
bounded size. One that lies in a single chunk is repaired there. Of the others, a chunk
yields the weights of its shortest paths from each grammar state to each: they are
combined in a tree of bounded groups, and what the root decides goes back down to the
chunks. In the tree, initials are known by their rank among a chunk's paths. That is
exact: a chunk's paths end with an edit of its last row and have as many such edits as
the chunk has rows, so none begins with the whole of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
FINE, TRUNCATED, UNWANTED = 0, 1, 2  # of a row: what the edit transducer may do with it
ROLES = {"u": "user", "a": "assistant"}
#: The role grammar (s?(ua)+)?: what each state reads, and where that leads.
GRAMMAR: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
STATES, FINAL = range(len(GRAMMAR)), (0, 3)
MOST_INSERTS = 2  # in one place; a third would come back to a state that the path has been in
PAIRS = len(GRAMMAR) ** 2
CHUNK_ROWS, CHUNK_BYTES, FAN = 256, 4_000_000, 64
SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


def _lesser(found: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in found or weight < found[state]:
        found[state] = weight


@lru_cache
def inserted(state: int) -> dict[int, Weight]:
    """The grammar states that inserts lead to, none included."""
    found, layer = {state: (0, "")}, {state: (0, "")}
    for _ in range(MOST_INSERTS):
        after: dict[int, Weight] = {}
        for g, (cost, label) in layer.items():
            for role in ROLES:
                if role in GRAMMAR[g]:
                    _lesser(after, GRAMMAR[g][role], (cost + COST[INSERT], label + INSERT))
        for g, weight in after.items():
            _lesser(found, g, weight)
        layer = after
    return found


@lru_cache
def composed(state: int, initial: str, kind: int) -> dict[int, Weight]:
    """Arcs of the composed machine from a grammar state over one row; made when first asked for."""
    arcs = [(DELETE, COST[DELETE], None)]
    if kind != UNWANTED:
        more = TRUNCATED_COST if kind == TRUNCATED else 0
        arcs += [(KEEP, COST[KEEP] + more, initial), *[(REROLE, COST[REROLE] + more, r) for r in ROLES]]
    found: dict[int, Weight] = {}
    for g, (cost, label) in inserted(state).items():
        for letter, own, role in arcs:
            if role is None or role in GRAMMAR[g]:
                _lesser(found, g if role is None else GRAMMAR[g][role], (cost + own, label + letter))
    return found


def shortest(rows: list[tuple[str, int]], start: int) -> dict[int, Weight]:
    """The least weight from start to each grammar state over (initial, kind) of rows."""
    reached: dict[int, Weight] = {start: (0, "")}
    for initial, kind in rows:
        after: dict[int, Weight] = {}
        for g, (cost, label) in reached.items():
            for to, (own, letters) in composed(g, initial if initial in "sua" else "", kind).items():
                _lesser(after, to, (cost + own, label + letters))
        reached = after
    return reached


def closed(reached: dict[int, Weight]) -> Weight:
    """The least weight to an accepting state, inserts after the last row included."""
    return min((cost + more, label + letters) for g, (cost, label) in reached.items() for to, (more, letters) in inserted(g).items() if to in FINAL)


def applied(label: str, roles: list[str], texts: list[str], start: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that the edits leave, from a grammar state on."""
    out, state, at = [], start, 0
    for letter in label:
        role, text = next((ROLES[x] for x in ROLES if x in GRAMMAR[state]), ""), ""
        if letter != INSERT:
            role, text = roles[at] if letter == KEEP else role, texts[at]
            at += 1
        if letter != DELETE:
            state = GRAMMAR[state][role[:1]]
            out.append((letter, role, text))
    return out


def _lines(rows: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in rows)


# --- chunks

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SUMMARY = [*[(c, pa.int64()) for c in _COUNTS], ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string())]
_SUMMARY_DDL = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _SUMMARY)
_WEIGHTS = [("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))]
_WEIGHTS_DDL = "costs array<long>, ranks array<long>"
_CHUNK = [("part", pa.int64()), ("no", pa.int64()), *_SUMMARY, *_WEIGHTS, ("kinds", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string())]
_CHUNK_DDL = f"part long, no long, {_SUMMARY_DDL}, {_WEIGHTS_DDL}, kinds array<int>, roles array<string>, texts array<string>, cost long, audit string, digest string"
ILLEGAL_UNLESS = ("su", "ua", "au")


def _summary(rows: list[tuple]) -> dict:
    """rows: turn, role, text, fault."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        **{c: sum(r[3] == c for r in rows) for c in _COUNTS[:3]}, "illegal": sum(a + b not in ILLEGAL_UNLESS for a, b in zip(initials, initials[1:], strict=False)), "turns": len(set(turns)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first_role": initials[0], "last_role": initials[-1],
    }


def joined(one: dict, two: dict) -> dict:
    """The summary of two neighbours."""
    out = {c: one[c] + two[c] for c in _COUNTS}
    out["illegal"] += one["last_role"] + two["first_role"] not in ILLEGAL_UNLESS
    out["turns"] -= one["last_turn"] is not None and one["last_turn"] == two["first_turn"]
    out["first_turn"] = one["first_turn"] if one["first_turn"] is not None else two["first_turn"]
    out["last_turn"] = two["last_turn"] if two["last_turn"] is not None else one["last_turn"]
    return out | {"first_role": one["first_role"], "last_role": two["last_role"]}


def _kind(fault: str | None) -> int:
    return FINE if fault is None else TRUNCATED if fault == "truncated" else UNWANTED


def _weights(rows: list[tuple[str, int]]) -> tuple[list, list, dict]:
    """costs and ranks by pair of states, and the initials."""
    found = {(g, to): w for g in STATES for to, w in shortest(rows, g).items()}
    order = {label: k for k, label in enumerate(sorted({label for _, label in found.values()}))}
    pairs = [(g, to) for g in STATES for to in STATES]
    return [found[p][0] if p in found else None for p in pairs], [order[found[p][1]] if p in found else None for p in pairs], found


def _chunks(batches: Iterator[pa.RecordBatch], rows_of_chunk: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows, in order, as chunks; a conversation in one chunk, neither the partition's first nor its last, is repaired."""
    out, schema, chunk, size = [], None, [], 0
    conv = part = None
    no, first, begun = 0, True, False

    def ended(whole: bool) -> None:
        roles, texts, faults = [r[1] for r in chunk], [r[2] for r in chunk], [r[3] for r in chunk]
        symbols = [(role[:1], _kind(f)) for role, f in zip(roles, faults, strict=True)]
        row = {"conv": conv, "part": part, "no": no, **_summary(chunk)}
        if whole:
            cost, audit = closed(shortest(symbols, 0))
            row |= {"cost": cost, "audit": audit, "digest": hashlib.sha256(_lines(applied(audit, roles, texts)).encode()).hexdigest()}
        else:
            costs, ranks, _ = _weights(symbols)
            row |= {"costs": costs, "ranks": ranks, "kinds": [k for _, k in symbols], "roles": roles, "texts": texts}
        out.append(row)

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv", batch.schema.field("conv").type), *_CHUNK])
        columns = [batch.column(c).to_pylist() for c in ("conv", "part", "turn", "role", "text", "fault")]
        for c, p, turn, role, text, fault in zip(*columns, strict=True):
            if begun and (c != conv or len(chunk) >= rows_of_chunk or size >= CHUNK_BYTES):
                ended(whole=c != conv and no == 0 and not first)
                first, no = first and c == conv, no + 1 if c == conv else 0
                chunk, size = [], 0
            conv, part, begun = c, p, True
            chunk.append((turn, role, text or "", fault))
            size += len(text or "")
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
    if begun:
        ended(whole=False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# --- the tree


def combined(matrices: list[tuple[list, list]]) -> tuple[list, list]:
    """The product of matrices of (costs, ranks) by pair of states."""
    n = len(GRAMMAR)
    held = {(g, g): (0, 0) for g in STATES}
    for costs, ranks in matrices:
        after: dict = {}
        for (start, g), (cost, rank) in held.items():
            for to in STATES:
                if (own := costs[g * n + to]) is not None:
                    _lesser(after, (start, to), (cost + own, (rank, ranks[g * n + to])))
        order = {r: i for i, r in enumerate(sorted({r for _, r in after.values()}))}
        held = {p: (c, order[r]) for p, (c, r) in after.items()}
    pairs = [(g, to) for g in STATES for to in STATES]
    return [held[p][0] if p in held else None for p in pairs], [held[p][1] if p in held else None for p in pairs]


def traced(matrices: list[tuple[list, list]], start: int, end: int) -> list[tuple[int, int]]:
    """The states in which the least path from start to end enters and leaves each matrix."""
    n, held, back = len(GRAMMAR), {start: (0, 0)}, []
    for costs, ranks in matrices:
        after: dict = {}
        for g, (cost, rank) in held.items():
            for to in STATES:
                if (own := costs[g * n + to]) is not None:
                    _lesser(after, to, (cost + own, (rank, ranks[g * n + to]), g))
        order = {r: i for i, r in enumerate(sorted({r for _, r, _ in after.values()}))}
        back.append({to: g for to, (_, _, g) in after.items()})
        held = {to: (c, order[r]) for to, (c, r, _) in after.items()}
    out = []
    for came in reversed(back):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def _in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["at"])


def _up(table: pa.Table) -> pa.Table:
    rows = _in_order(table)
    costs, ranks = combined([(r["costs"], r["ranks"]) for r in rows])
    whole = {k: rows[0][k] for k, _ in _SUMMARY}
    for r in rows[1:]:
        whole = joined(whole, r)
    schema = pa.schema([("conv", table.schema.field("conv").type), ("at", pa.int64()), *_SUMMARY, *_WEIGHTS])
    return pa.Table.from_pylist([{"conv": rows[0]["conv"], "at": rows[0]["up"], **whole, "costs": costs, "ranks": ranks}], schema=schema)


def _down(table: pa.Table) -> pa.Table:
    rows = _in_order(table)
    found = traced([(r["costs"], r["ranks"]) for r in rows], rows[0]["enters"], rows[0]["leaves"])
    schema = pa.schema([("conv", table.schema.field("conv").type), ("up", pa.int64()), ("at", pa.int64()), ("enters", pa.int32()), ("leaves", pa.int32())])
    return pa.Table.from_pylist([{"conv": r["conv"], "up": r["up"], "at": r["at"], "enters": a, "leaves": b} for r, (a, b) in zip(rows, found, strict=True)], schema=schema)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each conversation's whole matrix decides: its cost, the state in which its last row leaves it, and the inserts after that."""
    n = len(GRAMMAR)
    for batch in batches:
        rows = batch.select(["conv", "costs", "ranks"]).to_pylist()
        out = []
        for r in rows:
            # a rank stands for initials that no other's begin with, so ranks compare first
            cost, (_, after), state = min((r["costs"][g] + more, (r["ranks"][g], letters), g) for g in range(n) if r["costs"][g] is not None for to, (more, letters) in inserted(g).items() if to in FINAL)
            out.append({"conv": r["conv"], "cost": cost, "after": after, "leaves": state})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", batch.schema.field("conv").type), ("cost", pa.int64()), ("after", pa.string()), ("leaves", pa.int32())]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk whose path is known: its edits and the rows they leave."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            symbols = [(role[:1], k) for role, k in zip(r["roles"], r["kinds"], strict=True)]
            _, label = shortest(symbols, r["enters"])[r["leaves"]]
            left = applied(label, r["roles"], r["texts"], r["enters"])
            out.append({"conv": r["conv"], "part": r["part"], "no": r["no"], "audit": label, "lines": _lines(left)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", batch.schema.field("conv").type), ("part", pa.int64()), ("no", pa.int64()), ("audit", pa.string()), ("lines", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits and the hash of each conversation whose pieces come in order; a piece at a time is held."""
    now, labels, sha, some, begun = None, [], hashlib.sha256(), False, False
    schema = None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": now, "audit": "".join(labels), "digest": sha.hexdigest()}], schema=schema)

    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("audit", pa.string()), ("digest", pa.string())])
        for r in batch.to_pylist():
            if begun and r["conv"] != now:
                yield ended()
                labels, sha, some = [], hashlib.sha256(), False
            now, begun = r["conv"], True
            labels.append(r["audit"])
            if r["lines"]:
                sha.update((("\n" if some else "") + r["lines"]).encode())
                some = True
    if begun:
        yield ended()


def _matched(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """left with right's other columns, by conversation (a null one too) and names."""
    keys = ("conv", *names)
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    for k in names:
        on &= F.col(k) == F.col(f"_{k}")
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _open_repaired(chunks: DataFrame, kind: str) -> DataFrame:
    """conv, summary, cost, audit, digest of the conversations in several chunks, or at a partition's edge."""
    levels = [chunks.select("conv", (F.col("part") * (1 << 32) + F.col("no")).alias("at"), F.col("part").alias("up"), *[n for n, _ in _SUMMARY], "costs", "ranks")]
    parts = chunks.agg(F.max("part")).first()[0]
    node = f"conv {kind}, at long, {_SUMMARY_DDL}, {_WEIGHTS_DDL}"
    while True:
        above = written(levels[-1].groupBy("conv", "up").applyInArrow(_up, node), "tree")
        if not parts:
            break
        parts //= FAN
        levels.append(above.withColumn("up", F.floor(F.col("at") / FAN).cast("long")))
    root = written(above.mapInArrow(_roots, f"conv {kind}, cost long, after string, leaves int"), "roots")
    decided = root.select("conv", F.lit(0).cast("long").alias("up"), F.lit(0).alias("enters"), "leaves")
    for level in reversed(levels):
        met = _matched(level.select("conv", "up", "at", "costs", "ranks"), decided, "up")
        found = written(met.groupBy("conv", "up").applyInArrow(_down, f"conv {kind}, up long, at long, enters int, leaves int"), "decided")
        decided = found.select("conv", F.col("at").alias("up"), "enters", "leaves")
    placed = decided.select("conv", F.shiftright("up", 32).alias("part"), F.col("up").bitwiseAND(F.lit(0xFFFFFFFF)).alias("no"), "enters", "leaves")
    known = _matched(chunks.select("conv", "part", "no", "kinds", "roles", "texts"), placed, "part", "no")
    pieces = known.mapInArrow(_pieces, f"conv {kind}, part long, no long, audit string, lines string")
    # inserts after the last row: an assistant where a user waits, both where a system row stands alone
    tail = F.concat_ws("\n", *[F.when((F.col("leaves") <= 1) & (F.length("after") > 1), f"{ROLES['u']}:"), F.when(F.length("after") > 0, f"{ROLES['a']}:")])
    ends = root.where("after != ''").select("conv", F.lit(1 << 31).cast("long").alias("part"), F.lit(0).cast("long").alias("no"), F.col("after").alias("audit"), tail.alias("lines"))
    ordered = pieces.unionByName(ends).repartition("conv").sortWithinPartitions("conv", "part", "no")
    digests = ordered.mapInArrow(_digests, f"conv {kind}, audit string, digest string")
    found = _matched(_matched(above, root), digests)
    return found.select("conv", *[n for n, _ in _SUMMARY], "cost", "audit", "digest")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows_of_chunk: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in order of turn, nulls first; ties by role, then by text (its first 64
    characters, then its digest). A row's fault is the first of: blank (white space only),
    duplicate (role and text stood earlier), truncated (its last character is none of
    .!?). The audit has the initials of the cheapest edits that make the roles' initials
    (s?(ua)+)?, the least in ASCII order; the hash is of the rows they leave, role:text by
    line. A null role or text counts as one space. gaps counts the turns missing between
    the least and the greatest, nulls aside. A null conversation is one like others. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[conv_col]
    own = lambda c: rows[f"`{c}`"]
    plain = rows.select(own(conv_col).alias("conv"), own(turn_col).cast("long").alias("turn"), F.coalesce(own(role_col), F.lit(" ")).alias("role"), F.coalesce(own(text_col), F.lit(" ")).alias("text"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    stated = written(plain.select(F.monotonically_increasing_id().alias("row"), "*", last.alias("last"), said.alias("said")), "turns")
    repeated = stated.where("last != ''").groupBy("conv", "said").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "said", F.col("first.row").alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("row") != F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    faulty = _matched(stated, repeated, "said", how="left").withColumn("fault", fault).withColumns({"head": F.substring("text", 1, 64), "text": F.when(F.col("fault").isin("blank", "duplicate"), F.lit("")).otherwise(F.col("text"))})
    order = ["conv", "turn", "role", "head", "said", "row"]
    dealt = faulty.repartitionByRange(partitions, *order) if partitions else faulty.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("conv", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "text", "fault")
    chunks = written(ordered.mapInArrow(lambda it: _chunks(it, rows_of_chunk), f"conv {kind}, {_CHUNK_DDL}"), "chunks")

    whole = chunks.where("audit IS NOT NULL").select("conv", *[n for n, _ in _SUMMARY], "cost", "audit", "digest")
    open_chunks = chunks.where("audit IS NULL")
    found = whole.unionByName(_open_repaired(open_chunks, kind)) if open_chunks.limit(1).count() else whole
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.select(F.col("conv").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def reported(repaired: DataFrame, ids: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """repair()'s rows for every distinct id of ids; those without rows have zeros, no edits and the hash of nothing."""
    every = ids.select(ids[f"`{conv_col}`"].alias("_conv")).distinct()
    met = every.join(repaired, every["_conv"].eqNullSafe(repaired[f"`{conv_col}`"]), "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return met.select(F.col("_conv").alias(conv_col), *[v.alias(k) for k, v in zeros.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
