"""Layouts by fingerprint: nested paths, aliases of a layout only, mixed records, very long turns."""

import hashlib
import json

import pytest

from quillmark.llm import chat

TURNS = [("user", "a"), ("assistant", "b")]


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"role": "bot", "text": "x"}, "flat_turn", [("bot", "x")]),  # no alias here
        ({"messages": [{"role": "human", "content": "a"}, {"role": "model", "content": "b"}]}, "messages", [("human", "a"), ("model", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversation_values", TURNS),
        ({"data": {"prompt": "a", "completion": "b"}}, "data.prompt_completion", TURNS),
        ({"data": {"prompt": "a", "completion": "b"}, "id": 7}, "data.prompt_completion", TURNS),
        ({"record": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}}, "record.messages", TURNS),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]}, "messages_in_parts", TURNS),
        ({"mapping": [{"message": {"author": {"role": "user"}, "content": {"parts": ["a"]}}}]}, "author_mapping", [("user", "a")]),
        ({"example": {"role": "user", "text": "a"}}, "example.flat_turn", [("user", "a")]),
        ({"example": {"instruction": "a", "input": "c", "output": "b"}}, "example.instruction", [("user", "a\n\nc"), ("assistant", "b")]),
        ({"system": "s", "prompt": "a", "response": "b"}, "prompt_response", [("system", "s"), *TURNS]),
        ({"prompt": ""}, "prompt_alone", [("user", "")]),
        ({"data": {"unknown": 1}}, None, []),
        ({}, None, []),
    ],
)
def test_layouts(record, layout, turns):
    key, name, got = chat.Layouts().turns(record)
    assert (name, got) == (layout, turns) and key == chat.fingerprint(chat.paths(record))


def test_mixed_records_come_back(spark):
    roles = ("user", "assistant", "system", "human", "bot", "gpt", "model", "", None, "a\\b\nc")
    texts = ("plain", "", None, "<|im_end|>", "<\\|im_start|>x", '"quoted" \\ \n\t ', "é漢😀" * 3)
    places = [(c, t, r) for c in range(13) for t, r in enumerate(roles)] + [(None, t, "user") for t in range(3)]
    rows = [(c, t, r, texts[((c or 0) + t) % len(texts)], "x", 5) for c, t, r in places]
    df = spark.createDataFrame(rows + rows[:2], "conv_id bigint, turn bigint, role string, text string, record string, item int").repartition(3)
    records = chat.mixed_records(df)
    turns = chat.canonical_turns(records, "conv_id", "record", ("turn",))
    layouts = {r["layout"] for r in turns.select("layout").distinct().collect()}
    assert layouts == {"flat_turn", "messages", "data.turn_list", "author_mapping", "prompt_alone", "completion_alone", "instruction_alone", "output_alone"}
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.formatted_turns(turns)).collect()}
    plain = {}
    for c, t, r, x, *_ in rows + rows[:2]:
        plain.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(plain)
    for c, said in plain.items():
        said.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in said)
        loss = "".join(x for _, r, x in said if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_very_long_turns_and_broken_records(spark):
    long = "<|x|> word " * 400_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long[:-1])], "conv_id bigint, turn bigint, role string, text string")
    got = chat.conversation_digests(chat.formatted_records(chat.mixed_records(df))).first()
    assert got["loss_chars"] == len(long) - 1 and got["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long[:-1]}\n".encode()).hexdigest()
    bad = spark.createDataFrame([(1, "[" * 100_000), (2, '{"a":' * 900 + "1" + "}" * 900), (3, "{"), (4, "7"), (5, json.dumps({"role": "user", "text": "ok"}))], "id int, record string")
    rows = {r["id"]: r["text"] for r in chat.canonical_turns(bad, "id", "record").collect()}
    assert rows == {1: None, 2: None, 3: None, 4: None, 5: "ok"}
