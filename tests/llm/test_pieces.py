"""Streaming Viterbi against the sentencepiece library and against whole-text search."""

import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

from feedlake.llm import lockstep
from feedlake.llm.pieces import Model, encode
from tests.llm.helpers import docs, odd_rows, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Model.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(model, library):
    texts = [r[1] for r in odd_rows() if r[1]] + [prose(k, 80) for k in range(40)]
    texts += ["x" * 3000, "ab" * 2000, " " * 100 + "z", "日本語" * 300, "don't stop?!  ...", "aaaa\n\n\nbbbb\t\tc", "\x00\x7f", "🙂🙂 ok", "ñandú élan Straße", "http://a.b/c?d=1&e=%20"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abcetho n\n.") for _ in range(400)) for _ in range(40)]
    for text in texts:
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text.replace("▁", " ")


def test_side_by_side_equals_one_after_the_other(model, library, monkeypatch):
    rng = random.Random(9)
    parts = {" " + "".join(rng.choice("abcdeorstÈÉüßж日\n\t.🙂X ") for _ in range(rng.randint(0, 30))) for _ in range(3000)}
    expected = {p: [i for some in model.stream(p) for i in some] for p in parts}
    for slots, cells in ((1 << 20, 1 << 20), (4, 50)):
        monkeypatch.setattr(lockstep, "PAIRS", slots)
        monkeypatch.setattr(lockstep, "CELLS", cells)
        found = lockstep.Lockstep(model).encode(list(parts))
        assert {p: ids.tolist() for p, ids in found.items()} == expected
    assert all(ids == library.encode(p[1:]) for p, ids in expected.items() if p[1:])
    assert lockstep.Lockstep(model).encode([]) == {}


def test_commits_early_with_a_bounded_window(model):
    parts = list(model.stream(" " + "thequickbrownfoxjumpsoverthelazydog" * 200))
    assert len(parts) > 50 and max(map(len, parts)) < 100


def test_unigram_model_takes_the_best_sum():
    pieces = {p: (k, s) for k, (p, s) in enumerate([(" ", -4.0), ("a", -2.5), ("b", -2.0), ("ab", -3.0), ("ba", -3.5), (" a", -3.2), ("aba", -5.1), ("bab", -9.0)])}
    model = Model(pieces, None, 99, merges=False)

    def best(text):
        cuts = range(1, len(text))
        options = []
        for n in range(len(text)):
            for at in itertools.combinations(cuts, n):
                parts = [text[i:j] for i, j in zip((0, *at), (*at, len(text)))]
                if all(p in pieces for p in parts):
                    options.append(sum(pieces[p][1] for p in parts))
        return max(options)

    rng = random.Random(1)
    score = {i: s for i, s in pieces.values()}
    for _ in range(30):
        text = " " + "".join(rng.choice("ab") for _ in range(rng.randint(1, 11)))
        ids = [i for part in model.stream(text) for i in part]
        assert abs(sum(score[i] for i in ids) - best(text)) < 1e-9
    # A longer text is cut alike whether committed early or not.
    text = " " + "".join(rng.choice("ab") for _ in range(300))
    assert "".join({i: p for p, (i, _) in pieces.items()}[i] for part in model.stream(text) for i in part) == text


def test_table_with_odd_rows(spark, model, library):
    table = odd_rows()
    found = encode(docs(spark, table), model).collect()
    key = lambda r: (repr(r[0]), r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=key) == sorted(((r[0], library.encode(r[1] or "")) for r in table), key=key)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in found)
    assert encode(docs(spark, []), model).count() == 0
