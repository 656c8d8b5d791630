"""Chat formatting against a plain reading of the conversations, and on records made to be awkward."""

import hashlib

import pytest

from tickloom.llm import chat_format, queries

SF = "/root/testdata/sf0.001"
NASTY = ["", "\\", "\\\\#", "### user: </turn>\n", "</turn>\n### assistant: hi</turn>\n", "<\\/turn>", "#</#\\</\\#", "a\n\nb", "\n\n", "é ﬁ ✓ 🙂 #", "%41: +x", "</" * 5, "#" * 7 + "\\" * 3]
MESSAGES = "conv_id long, messages array<struct<role:string,content:string>>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by_id.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for _, _, r, t in own)), len(loss), sha(loss))
    return out


def digests(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.chat_digests(frame).collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.QUERIES["op11_schema_chat"](spark, SF).collect()}
    assert got == wanted(rows)


def test_awkward_conversations(spark):
    rows = [(i, k, role, text) for i in range(12) for k, (role, text) in enumerate([("user", NASTY[i]), ("assistant", NASTY[(i + 1) % len(NASTY)])])]
    rows += [(100 + i, k, role, t) for i in range(8) for k, (role, t) in enumerate([("system", NASTY[i]), ("user", "x\n\n" + NASTY[i]), ("assistant", "b")])]
    rows += [(200 + i, k, "user: ### %" if k % 2 else "human", t) for i in range(6) for k, t in enumerate(NASTY)]
    rows += [(300, 0, None, None), (301, None, "assistant", "first"), (301, 1, "assistant", None), (301, 1, "assistant", "tie"), (301, 1, "assistant", "tie"),
             (None, 0, "user", "no id"), (302, 0, "assistant", "long # </ \\ " * 200000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, layout string, messages int")
    assert digests(frame) == wanted(rows)
    assert chat_format.chat_digests(frame.limit(0)).count() == 0


def test_turns_come_from_the_output_alone(spark):
    frame = spark.createDataFrame([(k, [("user", t), ("assistant", u)]) for k, (t, u) in enumerate(zip(NASTY, reversed(NASTY)))], MESSAGES)
    chats = chat_format.formatted_chats(chat_format.canonical_turns(frame))
    assert chats.columns == ["conv_id", "fingerprint", "layout", "turns", "formatted", "loss_runs"]
    for r in chat_format.read_back(chats.drop("turns")).collect():
        assert [tuple(t) for t in r.read_turns] == [("user", NASTY[r.conv_id]), ("assistant", NASTY[-1 - r.conv_id])]
        assert r.loss_text == NASTY[-1 - r.conv_id]
        assert sum(s.skip + s.take + s.rest for s in r.loss_runs) == len(r.formatted)


def test_layouts_by_fingerprint(spark):
    schema = """conv_id long, system string, prompt string, completion string, instruction string, input string, output string,
        messages array<struct<role:string,content:string,name:string>>, conversations array<struct<`from`:string,value:string>>,
        dialog struct<turns:array<struct<speaker:string,utterance:string>>>, text string, layout string, turns int"""
    names = [f.split()[0] for f in schema.replace("\n", " ").split(", ")]
    cases = [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"completion": "c"}, "prompt", [("assistant", "c")]),
        ({"system": "s", "prompt": "p"}, "prompt", [("system", "s"), ("user", "p")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"instruction": "i", "output": ""}, "instruction", [("user", "i"), ("assistant", "")]),
        ({"messages": [("user", "m", "me"), None, (None, "n", None), ("tool", None, None)]}, "messages", [("user", "m"), ("", "n"), ("tool", "")]),
        ({"conversations": [("human", "h"), ("gpt", "g"), ("system", "s")]}, "shared", [("user", "h"), ("assistant", "g"), ("system", "s")]),
        ({"dialog": ([("a", "x")],)}, "dialog", [("a", "x")]),
        ({"system": "s"}, None, None), ({"text": "t", "layout": "l", "turns": 3}, None, None), ({"messages": []}, None, None), ({}, None, None),
        ({"prompt": "p", "messages": [("user", "m", None)]}, None, None),
    ]
    frame = spark.createDataFrame([tuple(k if n == "conv_id" else c.get(n) for n in names) for k, (c, _, _) in enumerate(cases)], schema)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted_chats(chat_format.canonical_turns(frame))).collect()}
    for k, (_, layout, turns) in enumerate(cases):
        assert got[k].layout == layout
        assert (got[k].turns is None and got[k].formatted is None) if turns is None else [tuple(t) for t in got[k].read_turns] == turns
    other = chat_format.canonical_turns(spark.createDataFrame([(1, "not a list", "p")], "conv_id long, messages string, prompt string")).first()
    assert (other.layout, [tuple(t) for t in other.turns]) == ("prompt", [("user", "p")])


def test_ambiguous_layouts_are_refused():
    one = chat_format.Layout("a", (chat_format.One("user", ("text",)),))
    with pytest.raises(ValueError):
        chat_format.registry([one, chat_format.Layout("b", (chat_format.One("assistant", ("text",)),))])


def test_no_python_in_the_plan(spark):
    frame = chat_format.chat_digests(chat_format.with_marked(spark.read.parquet(f"{SF}/conversations.parquet")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
