"""Structure repair of conversations: the cheapest edits that give turns of the form ``(system? (user assistant)+)?``.

Rows are hash-partitioned by conversation, flagged by one window in place (blank, duplicate, truncated) and sorted. A task takes its rows in
batches; in each, one recursive DuckDB query advances one turn for all conversations at a time and keeps, for every grammar state, the minimum
cost and the audit of edits that gives it. A conversation longer than a batch carries four states (cost, audit, running digest) into the next
one, so a task holds one batch and never a conversation's texts. A conversation is still read by one task: its digest is sequential.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4, the only one for blank and duplicate rows), Insert an empty user or assistant turn
(3); a truncated row that stays adds 3. Within one cost the least audit in ASCII order wins. Audits of one state end with a row's letter and hold the
same number of those, so none is the start of another and they may be compared by rank from batch to batch.

Defined results: null roles and texts are one space (so the text is blank); rows are ordered by turn (null first), then role, then text; repeated rows are
duplicates of the first; a role that begins with none of s, u, a (an empty one, too) has to be changed or deleted; a null conversation is one
conversation; an empty table gives no rows. Texts of any length are hashed in pieces of a row. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Grammar states: nothing yet, after system, after user, after assistant. Where a role's initial leads from each.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {"u": "user", "a": "assistant"}
INSERT = REROLE = CUT = 3
DELETE = 4
#: Inserts that complete the turns from each state.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}
FAULTS = ("blank", "duplicate", "truncated")
FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles string, repaired_sha256 string"


def _due(state: int) -> str:
    """The initial that may follow (besides a leading system turn)."""
    return "a" if state == 2 else "u"


def _steps() -> pa.Table:
    """Every way to pass one row: (state, kind, letters, cost, next). A kind is the initial ("-": another) with the fault of the row."""
    rows = []
    for start in range(4):
        state, before = start, ""
        while True:
            for initial in "sua-":
                for fault in range(4):
                    spent, kind = INSERT * len(before), f"{initial}{fault}"
                    rows.append((start, kind, before + "D", spent + DELETE, state))
                    if fault in (1, 2):
                        continue
                    spent += CUT * (fault == 3)
                    if (to := AFTER.get(initial, {}).get(state)) is not None:
                        rows.append((start, kind, before + "K", spent, to))
                    if initial != _due(state):
                        rows.append((start, kind, before + "R", spent + REROLE, AFTER[_due(state)][state]))
            state, before = AFTER[_due(state)][state], before + "I"
            if len(before) > 2 or state == start:
                break
    return pa.table(dict(zip(("state", "kind", "letters", "cost", "next"), zip(*rows, strict=True), strict=True)))


#: One turn for all conversations a recursion; ``rank`` orders the audits before this batch, ``origin`` is the state they ended in.
ADVANCE = """
with recursive path(conv, state, place, best) using key (conv, state) as (
  select conv, state, 0, {'cost': cost, 'rank': rank, 'audit': '', 'origin': state} from carried
  union
  select p.conv, s.next, p.place + 1, min({'cost': p.best.cost + s.cost, 'rank': p.best.rank, 'audit': p.best.audit || s.letters, 'origin': p.best.origin})
  from path p join turns t on t.conv = p.conv and t.place = p.place join steps s on s.state = p.state and s.kind = t.kind
  group by p.conv, s.next, p.place)
select p.conv, p.state, p.best.cost, p.best.audit, p.best.origin from path p join (select conv, count(*) n from turns group by conv) c on c.conv = p.conv and c.n = p.place
order by p.conv, p.state"""


@dataclass
class Path:
    """The cheapest way to a state: its cost, its edits, the roles they leave, and the digest of the turns so far."""

    cost: int = 0
    audit: str = ""
    roles: str = ""
    digest: object = field(default_factory=hashlib.sha256)

    def extended(self, state: int, letters: str, cost: int, rows: list[tuple[str, str]]) -> Path:
        """Edits of the next rows, from a state."""
        digest, roles, follow, begun = self.digest.copy(), [], iter(rows), state != 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else next(follow)
            if letter == "D":
                roles.append("-")
                continue
            initial = role[:1] if letter == "K" else _due(state)
            state = AFTER[initial][state]
            roles.append(initial)
            digest.update(f"{chr(10) if begun else ''}{role if letter == 'K' else ROLE[initial]}:".encode())
            digest.update(text.encode())
            begun = True
        return Path(cost, self.audit + letters, self.roles + "".join(roles), digest)


class Conversation:
    """What is known of a conversation so far."""

    def __init__(self, name):
        self.name, self.paths = name, {0: Path()}
        self.counts, self.illegal, self.last = [0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0

    def see(self, turn: int | None, initial: str, fault: int) -> None:
        """Count a row; rows come by turn, nulls first."""
        if fault:
            self.counts[fault - 1] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1

    def result(self) -> tuple:
        closed = [(p.cost + INSERT * len(CLOSING[s]), p.audit + CLOSING[s], s) for s, p in self.paths.items()]
        cost, _, state = min(closed)
        path = self.paths[state].extended(state, CLOSING[state], cost, [])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.name, gaps, *self.counts, self.illegal, cost, path.audit, path.roles, path.digest.hexdigest()


def _advance(con, open_: Conversation | None, batch: pa.RecordBatch) -> tuple[list[Conversation], Conversation | None]:
    """Conversations that end before the batch's last one, and that one."""
    found: list[Conversation] = []
    rows: dict[int, list[tuple[str, str]]] = {}
    turns: tuple[list, list, list] = ([], [], [])
    for name, turn, role, text, absent, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if not found:
            found.append(open_ if open_ and open_.name == name else Conversation(name))
        elif found[-1].name != name:
            found.append(Conversation(name))
        if absent:
            continue
        k = len(found) - 1
        own, initial = rows.setdefault(k, []), role[:1]
        found[k].see(turn, initial, fault)
        for column, x in zip(turns, (k, len(own), f"{initial if initial in AFTER else '-'}{fault}"), strict=True):
            column.append(x)
        own.append((role, text))
    done = [open_] if open_ and found and found[0] is not open_ else []
    if rows:
        con.register("turns", pa.table({"conv": pa.array(turns[0], pa.int32()), "place": pa.array(turns[1], pa.int32()), "kind": turns[2]}))
        ranked = [(k, s, p.cost, r) for k in rows for r, (s, p) in enumerate(sorted(found[k].paths.items(), key=lambda x: x[1].audit))]
        con.register("carried", pa.table(dict(zip(("conv", "state", "cost", "rank"), (pa.array(c, pa.int32()) for c in zip(*ranked, strict=True)), strict=True))))
        before, after = {k: found[k].paths for k in rows}, {k: {} for k in rows}
        for k, state, cost, audit, origin in con.execute(ADVANCE).fetchall():
            after[k][state] = (cost, audit, origin)
        last = len(found) - 1
        for k, ways in after.items():
            if k != last:  # it ends here: only the cheapest way is followed through the texts
                _, _, best = min((cost + INSERT * len(CLOSING[s]), before[k][o].audit + audit + CLOSING[s], s) for s, (cost, audit, o) in ways.items())
                ways = {best: ways[best]}
            found[k].paths = {s: before[k][o].extended(o, audit, cost, rows[k]) for s, (cost, audit, o) in ways.items()}
    return done + found[:-1], found[-1] if found else open_


def _repair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.register("steps", _steps())
    open_ = schema = None
    for batch in batches:
        schema = schema or _schema(batch.schema.field(0))
        done, open_ = _advance(con, open_, batch)
        if done:
            yield _results(done, schema)
    if open_:
        yield _results([open_], schema)
    con.close()


def _schema(name: pa.Field) -> pa.Schema:
    kinds = [("audit", pa.string()), ("roles", pa.string()), ("repaired_sha256", pa.string())]
    return pa.schema([name, *((n, pa.int64()) for n in ("gaps", *FAULTS, "illegal", "cost")), *kinds])


def _results(done: list[Conversation], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*(c.result() for c in done), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def flagged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """conv, turn, role, text, absent, fault (0: none, else the place in FAULTS), nth (of its repetitions), hash-partitioned by conversation."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    absent = F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), absent.alias("absent"))
    same = Window.partitionBy("conv", "absent", "digest", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("digest", F.xxhash64("role", "text")).repartition("conv").withColumn("nth", F.row_number().over(same))
    fault = F.when(trimmed == "", 1).when(F.col("nth") > 1, 2).when(~F.substring(trimmed, -1, 1).isin(*ENDS), 3).otherwise(0)
    return rows.select("conv", "turn", "role", "text", "absent", fault.alias("fault"), "nth")


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row a conversation: faults, minimum cost, audit (initials of the edits), the roles they leave ("-": deleted), and the digest of the repaired turns.

    Rows whose ``absent_col`` is true take no part, but their conversation has a result.
    """
    rows = flagged(df, id_col, turn_col, role_col, text_col, absent_col).sortWithinPartitions("conv", "turn", "role", "text", "nth").drop("nth")
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_repair_task, f"conv {kind}, {FIELDS}").withColumnRenamed("conv", id_col)


def repaired_turns(df: DataFrame, repaired: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """The turns that the audits leave: id, position (place of the edit), edit, role, text."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "nth")
    rows = flagged(df, id_col, turn_col, role_col, text_col, absent_col).where("not absent").select("conv", F.row_number().over(order).alias("row"), F.col("role").alias("old"), "text")
    letters = repaired.select(F.col(id_col).alias("conv"), "roles", F.posexplode(F.split("audit", "")).alias("position", "edit")).where("edit <> ''")
    passed = F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(Window.partitionBy("conv").orderBy("position"))
    letters = letters.select("conv", "position", "edit", F.expr("substring(roles, position + 1, 1)").alias("initial"), F.when(F.col("edit") != "I", passed).alias("row"))
    joined = letters.where("edit <> 'D'").alias("l").join(rows.alias("r"), F.expr("l.conv <=> r.conv and l.row = r.row"), "left")
    role = F.when(F.col("edit") == "K", F.col("old")).when(F.col("initial") == "u", F.lit(ROLE["u"])).otherwise(F.lit(ROLE["a"]))
    return joined.select(F.col("l.conv").alias(id_col), "position", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of ``conv_id:turn`` (nulls: one space): conv_id, turn, role, text, dropped."""
    plain = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = plain.withColumn("harm", F.crc32(name) % 20)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), times.alias("time")).drop("time")
