import itertools
import random

import numpy as np
from compare import assert_same
from pyspark.sql import functions as F

from lectern.llm import chat_format as T
from lectern.llm import queries

LINES = "conv_id long, pos long, tie long, line_no long, line string"


def test_round_trip(spark, sf_dir, duck):
    assert_same(queries.op8_chat_format(spark, sf_dir), duck.sql(T.ORACLE_SQL))


def lines(spark, texts):
    return spark.createDataFrame([(c, i, 0, 0, x) for c, ls in texts.items() for i, x in enumerate(ls)], LINES)


def turns(df):
    return [(r.conv_id, r.turn_no, r.role, r.content) for r in df.orderBy("conv_id", "turn_no").collect()]


def said(spark, model, texts):
    """{conversation: [(role, content)]} of transcripts given as lists of lines."""
    out = {c: [] for c in texts}
    for c, _, role, content in turns(T.parse(lines(spark, texts), model)):
        out[c].append((role[0], content))
    return out


MODELS = {}


def learnt(spark, sf_dir):
    if sf_dir not in MODELS:
        MODELS[sf_dir] = T.fit(T.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return MODELS[sf_dir]


def test_inner_markers_stay_content(spark, sf_dir):
    texts = {
        1: ["User: add these", "Question: what is 2 + 2?", "Assistant: Reasoning first.", "Answer: 4", "Context: sums", "User: thanks", "Assistant: welcome"],
        2: ["Human: hello", "AI: hi", "Assistant: inner?", "Human: bye"],
        3: ["User: one", "Assistant: a", "Assistant: b", "User: c", "User: d"],
        4: ["**Customer**: where is it", "Q: my parcel", "**Agent**: there", "System: out of order, it says"],
        5: ["Q: what", "A: that", "Answer: no turn", "Q: and", "A: so"],
        6: ["User: hi", "Bot: hello", "User: and", "Bot: so"],
        7: ["User: ask", "Assistant: say", "Note: this is text", "http: also text", "User: ask again"],
    }
    want = {
        1: [("u", "add these\nQuestion: what is 2 + 2?"), ("a", "Reasoning first.\nAnswer: 4\nContext: sums"), ("u", "thanks"), ("a", "welcome")],
        2: [("u", "hello"), ("a", "hi"), ("a", "inner?"), ("u", "bye")],
        3: [("u", "one"), ("a", "a"), ("a", "b"), ("u", "c"), ("u", "d")],
        5: [("u", "what"), ("a", "that\nAnswer: no turn"), ("u", "and"), ("a", "so")],
        6: [("u", "hi"), ("a", "hello"), ("u", "and"), ("a", "so")],
        7: [("u", "ask"), ("a", "say\nNote: this is text\nhttp: also text"), ("u", "ask again")],
    }
    for at in (sf_dir, sf_dir.replace("0.001", "0.1")):  # a model of more conversations is as tolerant
        got = said(spark, learnt(spark, at), texts)
        assert {k: got[k] for k in want} == want
        assert got[4][:2] == [("u", "where is it\nQ: my parcel"), ("a", "there")] or got[4][0] == ("u", "where is it\nQ: my parcel")


def test_inner_markers_of_generated_transcripts(spark, sf_dir):
    r = random.Random(4)
    rows, want = [], []
    inner = ["Answer: 4", "Context: as above", "Question: why?", "Instruction: do it"]
    for c in range(0, 200, 4):  # the style of these conversations is the plain one
        for t in range(r.randint(2, 8)):
            text = ["some words of a turn"] + [r.choice(inner) if r.random() < 0.3 else "more words" for _ in range(r.randint(0, 4))]
            role = ("user", "assistant")[t % 2] if r.random() < 0.85 else r.choice(("user", "assistant"))
            rows.append((c, t, role, "\n".join(text)))
            want.append((c, t, role, "\n".join(text)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert turns(T.parse(T.transcripts(df), learnt(spark, sf_dir))) == want


def test_best_path_is_the_best_of_all(spark, sf_dir):
    model, r = learnt(spark, sf_dir), random.Random(2)
    pool = ["User: a", "Assistant: b", "plain", "Answer: c", "", "why?", "Human: d", "AI: e", "x" * 150]
    for _ in range(25):
        ls = [r.choice(pool) for _ in range(r.randint(1, 4))]
        s = model.scores(ls)
        best = max(
            model.start[f, p[0]] + s[0, f, p[0]] + sum(model.step[a, b] + s[k + 1, f, b] for k, (a, b) in enumerate(zip(p, p[1:])))
            for f in range(T.STYLES_KNOWN) for p in itertools.product(range(T.STATES), repeat=len(ls))
        )
        path = model.decode(s, None, None)
        f, p = path[0] // T.STATES, [x % T.STATES for x in path]
        assert all(x // T.STATES == f for x in path)
        mine = model.start[f, p[0]] + s[0, f, p[0]] + sum(model.step[a, b] + s[k + 1, f, b] for k, (a, b) in enumerate(zip(p, p[1:])))
        assert np.isclose(mine, best)
        assert np.isclose(model.transfer(s, True)[:, 0].max(), best)


def test_unmarked_turns_by_alternation(spark, sf_dir):
    """Held out: every line's role where a third of the turns have no marker, and where none has."""
    c = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/conversations.parquet")
    train, rest = c.where("conv_id % 2 = 0"), c.where("conv_id % 2 = 1")
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) != 0
    model = T.fit(T.transcripts(train, hidden))
    shares = []
    for marked in (hidden, F.lit(False)):
        ls = T.transcripts(rest, marked).cache()
        by_line = T.parse(ls, model).select("conv_id", F.col("role").alias("got"), F.posexplode(F.split("content", "\n")).alias("k", "x"), "turn_no")
        n = lambda df, *o: [(r.conv_id, r[1]) for r in df.orderBy("conv_id", *o).collect()]
        want, got = n(ls.select("conv_id", "role", "pos", "line_no"), "pos", "line_no"), n(by_line.select("conv_id", "got", "turn_no", "k"), "turn_no", "k")
        assert len(want) == len(got)
        shares.append(sum(w == g for w, g in zip(want, got)) / len(want))
    print("share of lines with the right role:", shares)
    assert shares[0] > 0.8 and shares[1] > 0.5


def test_unmarked_talk_has_no_system(spark, sf_dir):
    got = said(spark, learnt(spark, sf_dir), {1: ["Can you help me?", "Sure, with what?", "My bike is broken.", "Let us see."]})
    assert "s" not in {r for r, _ in got[1]} and "\n".join(t for _, t in got[1]) == "Can you help me?\nSure, with what?\nMy bike is broken.\nLet us see."


def test_chunks_agree_with_one_pass(spark, monkeypatch):
    model = T.model_from_counts({("t", 1, 2): 50, ("t", 2, 1): 50, ("t", -1, 1): 50, ("c", 2, 1): 50, ("c", 5, 1): 50})
    talk = [f"{('User', 'Assistant')[i % 2]}: line {i}" if i % 3 == 0 else f"more {i}" for i in range(400)]
    whole = turns(T.parse(lines(spark, {1: talk, 2: talk[:5]}), model))
    monkeypatch.setattr(T, "CHUNK", 16)
    assert turns(T.parse(lines(spark, {1: talk, 2: talk[:5]}), model)) == whole
    path = model.decode(model.scores(talk), None, None)
    assert [t[2] for t in whole if t[0] == 1] == [T.ROLES[s % 3] for s in path if s % T.STATES < 3]


def test_crowded_positions_and_edges(spark, monkeypatch):
    model = T.model_from_counts({})
    monkeypatch.setattr(T, "CHUNK", 8)
    rows = [(1, 0, "user", f"text {i}") for i in range(40)] + [(1, 1, "assistant", None)] + [(2, None, "user", "a\nb")] * 3 + [(None, 1, "user", "x"), (3, 0, "narrator", "no marker\nat all"), (4, 0, "user", "q" * 200_000), (4, 1, "assistant", "l\n" * 3000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(9), "line": F.lit("z"), "n": F.lit(1)})
    got = T.parse(T.transcripts(c), model).collect()
    of = lambda k: [(r.role, r.content) for r in sorted(got, key=lambda r: r.turn_no) if r.conv_id == k]
    assert len(of(1)) == 41 and of(2) == [("user", "a\nb")] * 3 and of(None) == [("user", "x")] and of(3) == [(of(3)[0][0], "no marker\nat all")]
    assert of(4) == [("user", "q" * 200_000), ("assistant", "l\n" * 3000)] and len(got) == 41 + 3 + 1 + 1 + 2
    assert T.parse(T.transcripts(c.limit(0)), model).count() == 0
    assert T.fit(T.transcripts(c.limit(0))) is not None and T.fit(T.transcripts(c)) is not None


def test_markers():
    word = lambda x: T.WORDS[T.marker(x)[0]] if T.marker(x)[1] else None
    assert word("**Agent**: hi") == "agent" and word("note: hi") is None and T.features(None) == (T.NO_WORD, 0, 0)
    assert "### Instruction: do"[T.marker("### Instruction: do")[1] :] == "do"
