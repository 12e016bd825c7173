import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = [*chat.CONTROL, "\\", "<", "|", ">", "[", "]", "/", "s>", "INST]", "a", "é", "\n", " ", "", "<\\/s>", "<<", "SYS>>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
TURN = st.fixed_dictionaries({"role": st.sampled_from(["user", "assistant", "system", "tool", "", "<|x|>"]), "text": TEXT})


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_escape_is_reversible_and_leaves_no_control_string(t):
    assert chat.unescape(chat.escape(t)) == t
    assert not any(c in chat.escape(t) for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(TURN, max_size=6))
def test_spans(turns):
    got = chat.spans(turns, chat.inst_template)
    assert got["rewritten_at"] == 0 and got["formatted"] == chat.inst_template(turns)
    assert [chat.unescape(got["formatted"][s["text_begin"] : s["text_end"]]) for s in got["turns"]] == [t["text"] for t in turns]
    edges = [0, *(s["end"] for s in got["turns"])]
    assert [s["begin"] for s in got["turns"]] == edges[:-1] and edges[-1] == len(got["formatted"])


def test_other_templates():
    turns = [{"role": "user", "text": "one"}, {"role": "assistant", "text": "two"}, {"role": "user", "text": "three"}]
    last_only = lambda ts: "".join(f"{t['role']}:{t['text'] if t is ts[-1] else '-'};" for t in ts)
    got = chat.spans(turns, last_only)
    assert got["rewritten_at"] == 2 and got["stable_chars"] == 5
    last = got["turns"][-1]
    assert got["formatted"][last["text_begin"] : last["text_end"]] == "three" and got["turns"][0]["begin"] == -1
    twice = chat.spans(turns, lambda ts: "".join(t["text"] * 2 for t in ts))
    assert twice["rewritten_at"] == 0 and {s["text_begin"] for s in twice["turns"]} == {-1}


def test_frames(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(PIECES) * r.randint(0, 3) or None, "x") for c in range(12) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "n", "x"), (3, 1, "user", "tie", None), (3, 1, "user", "tie", None), (40, 0, "assistant", "long " * 40000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {x.conv_id: x for x in chat.read_back(chat.render(df)).collect()}
    assert set(got) == {x[0] for x in rows}
    for c, g in got.items():
        turns = sorted((t, role or "", text or "") for k, t, role, text, _ in rows if k == c)
        assert g.n_turns == len(turns) and g.rewritten_at == 0
        assert g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(chat.inst_template([{"role": a, "text": b} for _, a, b in turns]))
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_large_ids_beside_a_null_id_and_a_long_text(spark):
    big, long = (1 << 60) + 1, "word </s> " * 40_000
    rows = [(big, 0, "user", "a"), (None, 0, "user", "b"), (big, 1, "assistant", None), (None, 1, "assistant", long), (3, 0, None, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").coalesce(1)
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    assert set(got) == {big, None, 3} and got[big].n_turns == 2 and got[None].loss_chars == len(long) and got[big].loss_chars == 0
    assert chat.render(df.limit(0)).count() == 0
