"""Token-id files: code, bits and whole tables."""

import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedlake.llm import tokenids
from tests.llm.helpers import docs, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def json_text():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 300):
        counts = rng.integers(1, 10**6, n) ** 2
        counts[rng.integers(0, n)] = 0
        used = counts > 0
        free = tokenids.package_merge(counts, 40)
        if used.sum() > 1:
            assert (counts * free.astype(np.int64)).sum() == huffman_cost(counts)
        limit = int(used.sum()).bit_length() + 1
        short = tokenids.package_merge(counts, limit)
        assert short.max() <= limit and not short[~used].any() and (2.0 ** -short[used].astype(float)).sum() <= 1


def test_bits_come_back_from_checkpoints():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 5000):
        ids = (rng.zipf(1.3, n) % 500).astype(np.uint16)
        lengths = tokenids.package_merge(np.bincount(ids, minlength=500), 16)
        bits, checkpoints, total = tokenids.pack(ids, tokenids.canonical(lengths), lengths)
        assert total == lengths[ids].astype(int).sum() and len(checkpoints) == -(-n // tokenids.STEP)
        assert (tokenids.unpack(bits, checkpoints, n, tokenids.decode_table(lengths)) == ids).all()
        words = {format(c, f"0{k}b") for c, k in zip(tokenids.canonical(lengths), lengths) if k}
        assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_encoder_equals_the_library(json_text):
    encoder, library = tokenids.Encoder(json_text), Tokenizer.from_str(json_text)
    rng = random.Random(3)
    parts = ["a", "don't", "é", "日本", "12", "!!", " ", "  ", "\n", "\t", " ", "　", "<|endoftext|>", "🙂", "'s", "Word", "."]
    texts = ["", " ", "a", " a", "a ", "x  y", "x \n y"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += [prose(k) for k in range(20)]
    texts += ["", " ", "  a b", " x", "a <|endoftext|> b", "a  b", "a\tb c", "x \ny", "one. two, three.\x1cé! ü? 日本. x1. .", "a\u3000 b", "a \x85b", "k. " * 50]
    for some in (texts, texts[::-1], texts[:1], []):
        ids, sizes = encoder.encode(pa.array(some, pa.string()), 7)
        ends = np.cumsum(sizes)
        assert len(sizes) == len(some) and len(ids) == sizes.sum()
        for text, begin, end in zip(some, ends - sizes, ends):
            assert ids[begin:end].tolist() == [*library.encode(text, add_special_tokens=False).ids, 7], text


@pytest.mark.parametrize("block", [500_000, 50])
def test_table_comes_back_in_order(spark, json_text, monkeypatch, block):
    library = Tokenizer.from_str(json_text)
    rows = odd_rows() + [(k, prose(k, k % 90)) for k in range(20, 120)]
    random.Random(1).shuffle(rows)
    # Tasks take the size of blocks with them.
    monkeypatch.setattr(tokenids, "BLOCK_IDS", block)
    found = tokenids.read(tokenids.write(docs(spark, rows), json_text, 2)).collect()
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == want


def test_empty_table(spark, json_text):
    assert tokenids.read(tokenids.write(docs(spark, []), json_text, 2)).count() == 0
