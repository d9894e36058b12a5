import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import chat

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
pieces = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "<", "/", ">", "[", "s", "\n", " ", "é", "日", "\0"]), st.text(max_size=3)), max_size=8).map("".join)
talks = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), pieces), max_size=6)


@given(talks)
def test_round_trip_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_masked_tokens_cover_assistant_texts_exactly():
    t = chat.chat_tokenizer(PATH)
    turns = [("user", " hi </s>"), ("assistant", "  <s>[INST]é日 ok \n"), ("assistant", ""), ("tool:[INST]", "x"), ("assistant", "end\\")]
    formatted, spans = chat.render(turns)
    e = t.encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets)
    got = []
    for a, b in chat.mask(offsets, spans).tolist():
        got.append(chat.unescape(formatted[offsets[a, 0] : offsets[b - 1, 1]]) if b > a else "")
    assert got == [x for r, x in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, ""), (None, 0, "user", "lost"), (2, 0, "assistant", "</s>"), (2, 0, "assistant", "</s>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_control_probe(df), PATH)).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    probe = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-1].loss_sha256 == sha(probe) and got[-1].loss_chars == len(probe)
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].n_turns == 2 and got[1].loss_sha256 == sha("b")
    assert got[2].turns_sha256 == sha("\n\nassistant\n</s>\nassistant\n</s>\n") and got[2].loss_sha256 == sha("</s></s>")
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.format_conversations(df.limit(0), PATH).count() == 0
