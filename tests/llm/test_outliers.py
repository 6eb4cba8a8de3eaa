"""Base rules and the robust estimate against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np

from feedlake.llm import outliers
from tests.llm.helpers import docs, odd_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def rows():
    rng = random.Random(3)
    out = odd_rows()
    for k in range(20, 60):
        text = prose(k, rng.randint(15, 60))
        part = " ".join(text.split()[:rng.randint(7, 12)])
        out.append((k, text + "".join(rng.choice(["\n" + part, " " + part, "\n\n", " # 12 <b>", "\r\n"]) for _ in range(rng.randint(0, 4))), "en", "s"))
    out.append((60, " ".join(["go"] * 30), "en", "s"))
    return out


def test_base_counts_equal_brute_force(spark):
    table = rows()
    found = outliers.judge(docs(spark, table)).collect()
    key = lambda r: (repr(r[0]), r[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=key)
    assert got == sorted(((r[0], *base(r[1])) for r in table), key=key)
    assert not any(r.kept for r in found if r.base_failed)


def test_distances_equal_a_plain_estimate(spark):
    rng = random.Random(5)
    table = [(k, prose(k, rng.randint(20, 80)) + rng.choice(["", ".", "!", " A B.", " 12"]), "en", "s") for k in range(200)]
    table += [(900 + k, " ".join(w + "&&&" for w in prose(k, 40).split()), "en", "s") for k in range(8)]
    data = docs(spark, table)
    x = np.array([[r[c] for c in outliers.NAMES] for r in outliers.statistics(data).orderBy("doc_id").collect()])
    floor = np.diag([v ** 2 for v in outliers.FEATURES.values()])
    lower = lambda v, q: np.sort(v, axis=0)[math.ceil(q * len(v)) - 1]
    centre = lower(x, 0.5)
    cov = np.diag((1.4826 * lower(np.abs(x - centre), 0.5)) ** 2) + floor
    for _ in range(outliers.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        near = x[d2 <= lower(d2, outliers.SUBSET)]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.CONSISTENCY + floor
    d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    found = outliers.judge(data).orderBy("doc_id").collect()
    assert np.allclose([r.distance2 for r in found], d2, rtol=1e-6)
    assert [r.kept for r in found] == [bool(v <= outliers.CUTOFF) for v in d2]
    assert not any(r.kept for r in found if r.doc_id >= 900) and all(r.kept for r in found if r.doc_id < 200)


def test_chi_square_values():
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(outliers.chi_square_cdf(2.0, 2) - (1 - math.exp(-1))) < 1e-12


def test_empty_table_and_plan_without_python(spark):
    assert outliers.judge(docs(spark, [])).count() == 0
    plan = outliers.judge(docs(spark, rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

def test_short_clean_documents_stay_and_rare_symbol_tables_go(spark):
    rng = random.Random(9)
    table = [(k, prose(k, rng.choice([20, 25, 40, 200, 400])), "en", "s") for k in range(400)]
    # Every sixth word is followed by a bar: about 2.5 per cent of the characters are symbols.
    table += [(900 + k, " ".join(w + (" |" if i % 6 == 5 else "") for i, w in enumerate(prose(700 + k, 300).split())), "en", "s") for k in range(8)]
    found = {r.doc_id: r.kept for r in outliers.judge(docs(spark, table)).collect()}
    assert not any(found[900 + k] for k in range(8))
    assert sum(not found[k] for k in range(400)) <= 1


def test_words_said_many_times_in_a_row_go(spark):
    rng = random.Random(11)
    table = [(k, prose(k, rng.randint(30, 120)), "en", "s") for k in range(200)]
    # Seven times each, so that no window of eight words is found twice.
    table += [(900 + k, " ".join(w for w in prose(800 + k, 8).split() for _ in range(7)), "en", "s") for k in range(8)]
    found = {r.doc_id: r for r in outliers.judge(docs(spark, table)).collect()}
    assert not any(found[900 + k].base_failed or found[900 + k].kept for k in range(8))
    assert sum(not found[k].kept for k in range(200)) <= 1
