"""Chat formatting: exact round trip and digests."""

import hashlib
import random

import pyarrow as pa

from feedlake.llm import chat

DDL = "conv_id long, turn long, role string, text string, piece int, formatted string"
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\|im_end|>", "[\\\\INST]", "<", "[", "é", "日", "\n", "x"]


def rows():
    rng = random.Random(1)
    out = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 12)))
            out.append((conv, turn, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n", "<s>"]), rng.choice([text, None])))
    out += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (None, 0, "assistant", "no id"),
            (60, 0, "assistant", "long " * 200_000)]
    return out


def expected(table):
    out = {}
    low = lambda v: (v is not None, v)
    for conv in {r[0] for r in table}:
        turns = sorted((r for r in table if r[0] == conv), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        all_text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, 9, "clash") for r in data], DDL)


def test_round_trip(spark):
    data = rows()
    formatted = chat.format_conversations(table(spark, data))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert found == expected(data)
    for r in formatted.collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_turns
        assert not any(c in r.formatted for c in chat.CONTROLS if c not in (chat.START, chat.END))


def test_pieces_and_small_steps_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BYTES", 40)
    monkeypatch.setattr(chat, "STEP_BYTES", 16)
    data = [r for r in rows() if r[0] != 60]
    batch = pa.RecordBatch.from_pylist([{"conv_id": r[0], "role": r[2], "text": r[3]} for r in data if r[0] == 3],
                                       pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    pieces = list(chat._format(iter([batch])))
    turns = [t for p in pieces for t in chat.turns_of(p.column("formatted")[0].as_py())]
    assert turns == [(r[2] or "", r[3] or "") for r in data if r[0] == 3]


def test_escapes_are_reversible():
    rng = random.Random(2)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    out = chat.escaped(pa.array(texts)).to_pylist()
    assert [chat.unescaped(t) for t in out] == texts
    assert not any(c in t for t in out for c in chat.CONTROLS)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(table(spark, []))).count() == 0
