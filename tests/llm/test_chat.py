import hashlib

import pytest
from pyspark.sql import functions as F

from shotspark.llm import chat

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hello <|im_end|> there"), (1, 2, "assistant", "hi"), (1, 3, "user", "word " * 400),
    (1, 4, "assistant", "reply " * 300), (1, 5, "user", "more"), (1, 6, "assistant", r"<\|im_start|> and <| and <\\\|x|> \ <"),
    (2, 0, "assistant", None), (2, 1, None, "role is null"), (2, 1, None, "role is null"), (2, None, "assistant", "first"),
    (None, 0, "assistant", "no key\n\n"), (3, 0, "user", "only a user"), (4, 0, "tool\n<|im_start|>\\n", "x"), (4, 1, "assistant", ""),
    (5, 0, "system", "long " * 3000), (5, 1, "user", "u"), (5, 2, "assistant", "a"), (6, 1, "assistant", "é漢😀" * 50),
] + [(7, i, ["user", "assistant"][i % 2], f"turn {i} " + "w " * (i % 50)) for i in range(300)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))


def turns_of(rows):
    out: dict = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def check_digests(got, rows):
    want = turns_of(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        said = "".join(f"{a}\n{x}\n" for a, x in turns)
        loss = "".join(x for a, x in turns if a == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_read_back(spark, rows):
    windows = chat.format_windows(rows, budget=200, history=50)
    parsed = chat.parse_windows(windows).orderBy("conv_id", "window").collect()
    turns, learned = {}, {}
    for r in parsed:
        turns.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        learned.setdefault(r["conv_id"], []).extend(r["learned"])
    want = turns_of(ROWS)
    assert turns == want
    assert learned == {c: [x for a, x in v if a == "assistant"] for c, v in want.items()}


def test_windows_keep_budget_system_and_history(spark, rows):
    budget, history = 200, 60
    found = chat.format_windows(rows, budget, history).orderBy("conv_id", "window").collect()
    assert sum(r["conv_id"] == 7 for r in found) > 5
    for r in found:
        assert r["n_tokens"] <= budget or r["n_new"] == 1
        assert r["text"].count(chat.START) == r["text"].count(chat.END) == r["n_context"] + r["n_new"]
        if r["conv_id"] == 1:
            assert r["text"].startswith("<|im_start|>system\nbe brief<|im_end|>\n")
        for m in r["loss"]:
            assert r["text"][: m["start"]].endswith("<|im_start|>assistant\n")
            assert r["text"][m["start"] + m["length"] :].startswith("<|im_end|>\n")
    later = [r for r in found if r["conv_id"] == 7 and r["window"] > 0]
    assert all(r["n_context"] > 0 for r in later)  # short turns before a window are repeated


def test_a_conversation_over_many_slices(spark, monkeypatch):
    """Slices of few rows: prefix sums carry over borders, and windows stay whole."""
    monkeypatch.setattr(chat, "CHUNK_ROWS", 40)
    data = [(9, i, ["user", "assistant"][i % 2], f"t{i} " + "w " * (i * 7 % 90)) for i in range(400)]
    data += [(None, i, "assistant", f"n{i}") for i in range(100)] + [(c, 0, "user", "u") for c in range(20, 60)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(7)
    budget, history = 128, 32
    windows = chat.format_windows(table, budget, history)
    turns, learned = {}, {}
    for r in chat.parse_windows(windows).orderBy("conv_id", "window").collect():
        turns.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        learned.setdefault(r["conv_id"], []).extend(r["learned"])
    want = turns_of(data)
    assert turns == want
    assert learned == {c: [x for a, x in v if a == "assistant"] for c, v in want.items() if any(a == "assistant" for a, _ in v)} | {
        c: [] for c, v in want.items() if not any(a == "assistant" for a, _ in v)
    }
    found = windows.collect()
    assert all(r["n_tokens"] <= budget or r["n_new"] == 1 for r in found)
    own = [r for r in found if r["conv_id"] == 9]
    # a window repeats as much of what stands before it as the history holds
    tokens = [len(x.split()) + 4 for _, x in want[9]]
    ends = [sum(tokens[:i]) for i in range(len(tokens) + 1)]
    start = 0
    for r in sorted(own, key=lambda r: r["window"]):
        assert r["n_context"] == sum(ends[start] - ends[i] <= history for i in range(start))
        start += r["n_new"]


def test_empty(spark, rows):
    assert chat.parse_windows(chat.format_windows(rows.limit(0))).count() == 0


def test_query(spark, sf):
    reply = "<|im_end|><|im_start|>assistant ok"
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    data = [tuple(r) for r in table] + [(-1, 0, "user", reply), (-1, 1, "assistant", reply)]
    got = chat.op5_chat(spark, sf).collect()
    check_digests(got, data)
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in got)


def test_plan_has_no_python(spark, sf):
    plan = chat.op5_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
