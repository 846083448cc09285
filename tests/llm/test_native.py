"""Quality rules, mixing and chat formatting: against plain Python, round trips, odd input; no Python on the executors."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, quality

from oddities import ODD

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def measured(text):
    t = text or ""
    w = [x.decode() for x in words(t)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_measures_and_verdicts(make):
    rng = random.Random(5)
    rows = ODD + [(100 + i, " ".join(rng.choice("ab cd ef\n gh | # ij kl mn".split(" ")) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(300, "The quick brown fox jumps over the lazy dog and runs far away from here.")]
    df = quality.quality(make(rows))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t in rows for m in [measured(t)]), key=repr)
    assert [r[:7] for r in got] == want
    assert all(not r[7] for r in got if r[6]) and next(r for r in got if r[0] == 300)[7]
    assert no_python(df)
    assert quality.quality(make([])).count() == 0


def test_cascade_order(make):
    rules = {"never": lambda t, w: F.lit(True), "often": lambda t, w: F.size(w) > 3}
    order = quality.plan_order(make([(i, "a " * (i % 6)) for i in range(60)]), rules)
    assert [x["name"] for x in order] == ["often", "never"] and 0.5 < order[0]["rejected"] < 0.9
    rows = make([(1, "a b c d e f g h i j k")])
    rules = {"no": lambda t, w: F.lit(False) & (F.size(w) > 99), "fails": lambda t, w: F.raise_error(F.concat(F.lit("evaluated "), t)).isNull()}
    verdict = quality.cascade(rules, ["no", "fails"], F.lit(False))
    assert rows.select("text", F.split("text", " ").alias("_words")).select(verdict.alias("kept")).first()["kept"] is False


def targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_mix(make):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * 2 for _ in range(rng.choice([0, 1, 7, 40, 900]))), rng.choice(["b", "a", "a", "é", "Z", None, "a", "tiny"] if i % 50 else ["tiny"])) for i in range(300)]
    rows += [(None, "x y z", "a"), (7000, None, "a"), (7001, "w " * 20_000, "b")]
    df = mixing.mix(make(rows), block_tokens=64)
    got = df.collect()
    assert no_python(df)
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert sum(p["words"] for p in r["passes"]) == r["taken"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert taken == {s: int(t + 1e-9) for s, t in want.items()}
    again = mixing.mix(make(rows[::-1]), block_tokens=64).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    mixed = mixing.mixed_rows(make(rows), block_tokens=64)
    assert mixed.columns == make([]).columns
    texts, written = {(i, t) for i, t, _ in rows}, Counter()
    for r in mixed.collect():
        assert (r["doc_id"], r["text"]) in texts  # whole documents only
        written[r["source"]] += len(words(r["text"]))
    for name, t in taken.items():
        assert abs(written[name] - t) <= max(len(words(x)) for _, x, source in rows if source == name) / 2
    assert mixing.mix(make([])).count() == 0 and mixing.mixed_rows(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix(make([(1, ""), (2, None)])).collect()] == [0, 0]


def test_schedule_is_even(make):
    sources = mixing.source_targets(mixing.sized(make([(i, "w " * 64, "ab"[i % 2]) for i in range(512)])), (3, 1), 1.0, 2)
    slots = [r["source_id"] for r in mixing.schedule(sources, 64).orderBy("slot").collect()]
    share = slots.count(0) / len(slots)
    for n in (32, 64, 128, 256):
        assert abs(slots[:n].count(0) - share * n) <= 6


def test_mix_comes_in_slot_order(make):
    """Any beginning of what is written holds the sources close to their shares, and a table may have any column names."""
    clashing = ["size", "_pass", "_doc_id", "_source", "slot", "at", "c0", "_id"]
    rows = [(i, "w " * (20 + i % 30), "ab"[i % 2]) for i in range(800)]
    mixed = mixing.mixed_rows(make(rows, *clashing), weights=(3, 1), share=1.0, block_tokens=64)
    assert mixed.columns == make(rows, *clashing).columns
    got = mixed.collect()
    sizes = [len(words(r["text"])) * (1 if r["source"] == "a" else 0) for r in got], [len(words(r["text"])) for r in got]
    share = sum(sizes[0]) / sum(sizes[1])
    for n in (len(got) // 8, len(got) // 4, len(got) // 2):
        assert abs(sum(sizes[0][:n]) / sum(sizes[1][:n]) - share) < 0.05
    assert all(r["_pass"] == "x" for r in got)


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "### a: </turn>\n\\x\\\\"), (1, 2, "assistant", None), (2, 1, None, "é"), (2, 0, "sys: x\n", "</turn>\n### user: "), (None, 0, "assistant", ""), (3, 0, "user", "a"), (3, 0, "user", "a")]
CHAT_SCHEMA = "conv_id bigint, turn int, role string, text string, mask string"


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*c, "x") for c in CHATS], CHAT_SCHEMA)
    shown = chat.formatted(chat.from_table(df))
    done = chat.digests(shown)
    assert no_python(done)
    texts = {r["conv_id"]: r["text"] for r in shown.collect()}
    for r in done.collect():
        turns = sorted(((t, role or "", text or "") for i, t, role, text in CHATS if i == r["conv_id"]))
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha(spoken), len(loss), sha(loss))
        assert r["formatted_chars"] == len(texts[r["conv_id"]])
    assert chat.digests(chat.formatted(chat.from_table(spark.createDataFrame([], CHAT_SCHEMA)))).count() == 0


def test_fingerprints(spark):
    a = [("user", "q"), ("assistant", "a")]
    records = [
        ("messages", {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, a),
        ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, a),
        ("turns", {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "assistant", "text": "a"}]}, a),
        ("prompt_completion", {"prompt": "q", "completion": "a"}, a),
        ("instruction_input", {"instruction": "q", "input": "", "output": "a"}, a),
        ("instruction_input", {"output": "a", "instruction": "q", "input": "more"}, [("user", "q\nmore"), ("assistant", "a")]),
        ("system_prompt", {"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *a]),
        ("prompt_response", {"prompt": None, "response": "a"}, [("assistant", "a")]),
        (None, {"prompt": "q", "answer": "a"}, None),
        ("messages", {"id": 7, "meta": {"messages": []}, "messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a"}]}, a),
        ("messages", {"messages": []}, []),
        ("instruction_input", {"instruction": "q", "input": "", "output": "a", "prompt": "z"}, a),
        ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None, "weight": 1}], "turns": 2}, [("user", "q"), ("assistant", "")]),
    ]
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(records)] + [(90, "not json"), (91, None), (92, "[]")]
    df = chat.from_json(spark.createDataFrame(rows, "conv_id bigint, payload string"), "payload")
    got = {r["conv_id"]: r for r in df.collect()}
    for i, (name, _, turns) in enumerate(records):
        assert got[i]["layout"] == name
        assert (None if got[i]["turns"] is None else [tuple(x) for x in got[i]["turns"]]) == turns
    assert all(got[i]["layout"] is None and got[i]["turns"] is None for i in (90, 91, 92))
    nested = spark.createDataFrame([(1, [("user", "q")])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    assert chat.from_table(nested).first()["turns"][0]["text"] == "q"
    with pytest.raises(ValueError, match="no layout"):
        chat.from_table(spark.range(1))
    clashing = spark.createDataFrame([(1, "x", "y", "z", json.dumps({"prompt": "q", "completion": "a"}))], "conv_id bigint, record string, paths string, own string, payload string")
    r = chat.from_json(clashing, "payload").first()
    assert (r["layout"], r["record"], r["paths"], r["own"]) == ("prompt_completion", "x", "y", "z")
