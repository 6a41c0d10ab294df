import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat

PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/ROLE]", "[ROLE", "\\", "]", "[", "<", " ", "a", "é", "\n"]), max_size=8).map("".join)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to]ol", "", None]), st.one_of(st.none(), PIECES)), min_size=1, max_size=6), min_size=1, max_size=30))
    def check(conversations):
        rows = [(c, i, r, t) for c, turns in enumerate(conversations) for i, (r, t) in enumerate(turns)]
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
        got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
        for c, turns in enumerate(conversations):
            turns = [(r or "", t or "") for r, t in turns]
            loss = "".join(t for r, t in turns if r == "assistant")
            want = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss))
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want

    check()


def test_examples(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "B"), (1, 0, "user", "a"), (1, 1, "assistant", "A"), (1, 3, "user", "z"), (2, 0, None, None)], "conv_id bigint, turn int, role string, text string")
    got = sorted(chat.format_chats(df).collect())
    assert [(r.conv_id, r.example, r.formatted, r.formatted[r.loss_start : r.loss_end]) for r in got] == [
        (1, 0, "[INST] a [/INST] A</s>", "A"),
        (1, 1, "[INST] a [/INST] A</s> B</s>", "B"),
        (1, 2, "[INST] a [/INST] A</s> B</s>[INST] z [/INST]", ""),
        (2, 0, "[ROLE ]  [/ROLE]", ""),
    ]
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_repeats_ties_long_conversations_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "assistant", "c"), (1, None, "system", "s"), (None, 0, "user", "n"), (None, 1, "assistant", None)]
    rows += [(2, i, "assistant" if i % 2 else "user", "long " * (2000 if i == 7 else 2)) for i in range(60)]
    names = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(rows, names).repartition(3)
    clash = df.selectExpr("*", "'x' AS example", "1 AS formatted", "2 AS loss_start", "'y' AS parts", "'z' AS roles", "3 AS turns", "4 AS end", "5 AS last", "6 AS target")
    want = sorted(map(tuple, chat.format_chats(df).collect()), key=str)
    assert sorted(map(tuple, chat.format_chats(clash).collect()), key=str) == want
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(clash)).collect()}
    assert len(got) == 3
    for c in (1, 2, None):  # null turns first, then by turn, role and text; repeated rows are turns of their own
        turns = sorted((t if t is not None else -(2**63), r, x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), digest(loss), len(loss))
    assert len([w for w in want if w[0] == 2]) == 30
