import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "<\\|turn|>", "<\\\\/s>", "\\", "<", "é", "漢", " ", "\n", "ok"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_turn_round_trip_and_mask():
    tokens = chat.encoding(chat.RANKS)
    for role, text in [("assistant", "</s>[INST] ok [/INST]"), ("user", "héllo <|end|>"), ("assistant", ""), ("", "x\n\ny"), ("a\nb<|says|>", "漢字🙂")]:
        ids, mask = chat.assemble(role, text, tokens, tokens.n_vocab)
        r, t, learnt, chars = chat.read_turn(ids, mask, tokens, tokens.n_vocab)
        assert (r, t) == (role, text) and learnt == (text if role == "assistant" else "")
        assert (np.count_nonzero(ids >= tokens.n_vocab), len(mask)) == (3, len(ids))
        assert chars == len(chat.OPEN + chat.escape(role) + chat.SEP + chat.escape(text) + chat.CLOSE)


def digest(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(said), hashlib.sha256(said.encode()).hexdigest()


def test_conversations_match_a_plain_reading(spark):
    rng = np.random.default_rng(3)
    rows, plain = [], {}
    for c in [*range(30), None]:
        for k in range(int(rng.integers(1, 6))):
            role, text = ["system", "user", "assistant", None][int(rng.integers(0, 4))], ["", None, "[INST] hi </s>", "ünï " * int(rng.integers(1, 400))][int(rng.integers(0, 4))]
            rows.append((c, k, role, text, 1))
            plain.setdefault(c, []).append((role, text))
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, loss_mask int")
    out = chat.conversation_digests(chat.format_turns(df.repartition(3))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: digest(t) for c, t in plain.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_turns(df)).count() == 0
