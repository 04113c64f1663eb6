"""Chat formatting: heterogeneous records to canonical turns, to a marked-up text with a loss mask, and back.

A record's layout is known by its schema fingerprint: a hash of the sorted nested field paths that hold a value, list positions
left out. A registry maps fingerprints to declarative mappings: a list of turns, each a role and a nested field path, or a path to a list with the
paths of role and text inside its items, with role aliases where a layout has its own names for roles. Records whose fingerprint isn't registered
take the mapping whose required paths they hold with the fewest paths left over, the first by name on ties; none gives ``layout`` null and no turns.
Roles without an alias are kept as they are.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts every ``<`` followed by backslashes and ``|`` gets one
more backslash, so no text holds a control string and the inverse takes exactly one away. Roles escape backslashes and line
breaks besides. The loss mask covers the text of assistant turns.

Null text or role counts as empty. Turns of a conversation are ordered by turn (nulls first), then place in the record, role, text; repeated rows
stay. A null conversation id is a conversation of its own. A turn of any length is held whole, batches are cut by bytes. Records that are no JSON
object have no layout. Empty tables give empty results. Columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
#: Declarative mappings. ``turns``: (role, path or paths) pairs; ``list``: path of a list ("" for the record itself), ``role`` and ``text``: paths in its
#: items; ``aliases``: the layout's own names of roles. Paths are nested field names joined by points; ``needs`` lists the paths that must hold a value.
MAPPINGS = {
    "flat_turn": {"list": "", "role": "role", "text": "text", "needs": ("role", "text")},
    "messages": {"list": "messages", "role": "role", "text": "content", "needs": ("messages[].role", "messages[].content")},
    "messages_in_parts": {"list": "messages", "role": "role", "text": "content", "needs": ("messages[].role", "messages[].content[].text")},
    "conversation_values": {"list": "conversations", "role": "from", "text": "value", "aliases": SPEAKERS, "needs": ("conversations[].from", "conversations[].value")},
    "turn_list": {"list": "turns", "role": "role", "text": "text", "needs": ("turns[].role", "turns[].text")},
    "author_mapping": {"list": "mapping", "role": "message.author.role", "text": "message.content.parts", "needs": ("mapping[].message.author.role", "mapping[].message.content.parts[]")},
    "prompt_completion": {"turns": (("user", "prompt"), ("assistant", "completion")), "needs": ("prompt", "completion")},
    "prompt_response": {"turns": (("system", "system"), ("user", "prompt"), ("assistant", "response")), "needs": ("prompt", "response")},
    "instruction": {"turns": (("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")), "needs": ("instruction", "output")},
    "question_answer": {"turns": (("user", "question"), ("assistant", "answer")), "needs": ("question", "answer")},
    "prompt_alone": {"turns": (("user", "prompt"),), "needs": ("prompt",)},
    "completion_alone": {"turns": (("assistant", "completion"),), "needs": ("completion",)},
    "instruction_alone": {"turns": (("user", "instruction"),), "needs": ("instruction",)},
    "output_alone": {"turns": (("assistant", "output"),), "needs": ("output",)},
}
#: Fields that may hold a record of any other layout.
WRAPPERS = ("data", "record", "conversation", "example")
MAPPINGS |= {
    f"{w}.{name}": m | ({"list": f"{w}.{m['list']}".rstrip(".")} if "list" in m else {"turns": tuple((role, tuple(f"{w}.{p}" for p in ((path,) if isinstance(path, str) else path))) for role, path in m["turns"])}) | {"needs": tuple(f"{w}.{n}" for n in m["needs"])}
    for w in WRAPPERS
    for name, m in tuple(MAPPINGS.items())
}


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths that hold a value."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(paths(v, f"{prefix}[]") for v in value), set()) or {prefix + "[]"}
    return {prefix} if value is not None else set()


def at_path(value, path: str):
    """What stands at a nested path; None where a field is missing. The empty path is the value itself."""
    for name in path.split(".") if path else ():
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


class Layouts:
    """Selects mappings by fingerprint; a fingerprint is resolved once."""

    def __init__(self, mappings: dict | None = None):
        self.mappings = mappings or MAPPINGS
        self.known: dict[str, str | None] = {fingerprint(set(m["needs"])): name for name, m in self.mappings.items()}

    def select(self, found: set[str]) -> tuple[str, str | None]:
        key = fingerprint(found)
        if key not in self.known:
            fits = [(len(found) - len(set(m["needs"])), name) for name, m in self.mappings.items() if found >= set(m["needs"])]
            if len(self.known) > 65536:
                return key, min(fits, default=(0, None))[1]
            self.known[key] = min(fits, default=(0, None))[1]
        return key, self.known[key]

    def turns(self, record: dict) -> tuple[str, str | None, list[tuple[str, str]]]:
        key, name = self.select(paths(record))
        if name is None:
            return key, None, []
        m = self.mappings[name]
        if "list" in m:
            items, aliases = at_path(record, m["list"]), m.get("aliases", {})
            items = items if isinstance(items, list) else [items]
            roles = [(_text(at_path(i, m["role"])), _text(at_path(i, m["text"]))) for i in items if isinstance(i, dict)]
            return key, name, [(aliases.get(r, r), t) for r, t in roles]
        out = []
        for role, path in m["turns"]:
            parts = [_text(at_path(record, p)) for p in ((path,) if isinstance(path, str) else path)]
            text = "\n\n".join(p for p in parts if p)
            if text or role != "system":
                out.append((role, text))
        return key, name, out


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):  # content parts
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's marked-up text and the span under the loss mask (empty unless the assistant speaks)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
    return f"{head}{body}{END}\n", *span


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def canonical_turns(df: DataFrame, id_col: str, record_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Records as JSON objects to rows (id, ``also``, fingerprint, layout, item, role, text); text that isn't an object has no layout."""
    source = df.select(id_col, *also, record_col)
    kept = len(also) + 1
    schema = T.StructType([*(source.schema[c] for c in (id_col, *also)), *T.StructType.fromDDL("fingerprint string, layout string, item bigint, role string, text string")])

    def run(batches):
        layouts = Layouts()
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for a, b in slices(batch.column(kept)):
                rows = []
                for i, raw in enumerate(batch.column(kept).slice(a, b - a).to_pylist(), a):
                    try:
                        record = json.loads(raw) if raw else None
                        key, name, turns = layouts.turns(record) if isinstance(record, dict) else (None, None, [])
                    except (ValueError, RecursionError):
                        key, name, turns = None, None, []
                    rows += [(i, key, name, t, r, x) for t, (r, x) in enumerate(turns)] or [(i, key, name, None, None, None)]
                at, *cols = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(kept)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


#: Layouts that ``mixed_records`` writes a single turn in.
WRITTEN = 6


def mixed_records(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, record): each turn row as a JSON record, in a layout that depends on the conversation's id.

    Single-field layouts tell the role by the field's name and serve users and assistants; other roles stay in a list layout.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    kind = F.pmod(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.lit(WRITTEN))
    said = lambda r, t: F.struct(role.alias(r), text.alias(t))
    flat = F.to_json(said("role", "text"))
    listed = F.to_json(F.struct(F.array(said("role", "content")).alias("messages")))
    nested = F.to_json(F.struct(F.struct(F.array(said("role", "text")).alias("turns"), F.lit("made").alias("origin")).alias("data")))
    author = F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content"))
    mapped = F.to_json(F.struct(F.array(F.struct(author.alias("message"))).alias("mapping")))
    alone = lambda user, assistant: F.when(role == "user", F.to_json(F.struct(text.alias(user)))).when(role == ASSISTANT, F.to_json(F.struct(text.alias(assistant)))).otherwise(nested)
    record = (
        F.when(kind == 0, flat).when(kind == 1, listed).when(kind == 2, nested).when(kind == 3, mapped)
        .when(kind == 4, alone("prompt", "completion")).otherwise(alone("instruction", "output"))
    )
    return df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), record.alias("record"))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, item, role, text, formatted, loss_start, loss_end) of canonical turns: a conversation is the concatenation of its turns."""
    source = turns.where("layout is not null and item is not null").select("conv_id", "turn", "item", "role", "text")
    schema = T.StructType([*source.schema, *T.StructType.fromDDL("formatted string, loss_start int, loss_end int")])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(4)):
                part = batch.slice(a, b - a)
                out = [format_turn(role or "", text or "") for role, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=schema.names)

    return source.mapInArrow(run, schema)


def formatted_records(records: DataFrame) -> DataFrame:
    """Records (conv_id, turn, record) of any layouts to formatted turns."""
    return formatted_turns(canonical_turns(records, "conv_id", "record", ("turn",)))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read the formatted turns back, conversation by conversation, with one turn in memory at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")])
    order = ["conv_id", "turn", "item", "role", "text"]
    placed = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches):
        current, state, kind = None, None, None

        def one():
            n, said, chars, loss, total = state
            values = (current[0], n, said.hexdigest(), chars, loss.hexdigest(), total)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            rows = (row for x, y in slices(batch.column(1)) for row in zip(*(batch.column(i).slice(x, y - x).to_pylist() for i in range(4)), strict=True))
            for conv, formatted, a, b in rows:
                if current != (conv,):
                    if current is not None:
                        done.append(one())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(formatted[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if current is not None:
            yield one()

    return placed.mapInArrow(run, schema)
