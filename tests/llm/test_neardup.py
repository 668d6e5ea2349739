"""Operator 1 against brute force over all pairs."""
import random
from collections import Counter

import numpy as np
import pytest

from duelframe.llm import neardup as N
from llm_helpers import empty, llm, make_docs, odd, sentence  # noqa: F401

VOCABULARY = [f"w{i}" for i in range(400)]


def windows(text):
    w = text.encode().split()
    k = min(5, len(w))
    seen, out = Counter(), []
    for i in range(len(w) - k + 1 if w else 0):
        g = tuple(w[i:i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    a, b = windows(a), windows(b)
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) if a and b else 0.0


def brute(texts):
    """Class id (smallest row number) of each text; nulls alone."""
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, t in enumerate(texts):
        for j in range(i):
            if t is None or texts[j] is None or find(i) == find(j):
                continue
            if t == texts[j] or similarity(t, texts[j]) >= 0.8:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rnd.randrange(len(w))
        action = rnd.randrange(3)
        if action == 0:
            w[k] = rnd.choice(VOCABULARY)
        elif action == 1:
            w.insert(k, rnd.choice(VOCABULARY))
        else:
            del w[k]
    return " ".join(w)


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", "", "  ", "one two", "one  two", "one two three", None]
    for _ in range(12):
        base = sentence(rnd, rnd.randint(30, 160), VOCABULARY)
        texts += [base] * rnd.randint(1, 3) + [edited(rnd, base, rnd.randint(1, 4)) for _ in range(3)]
    chain = sentence(rnd, 150, VOCABULARY)          # a drifts: neighbours are alike, the ends are not
    for _ in range(8):
        texts.append(chain)
        chain = edited(rnd, chain, 3)
    shared = sentence(rnd, 25, VOCABULARY)          # one passage in many unlike texts
    texts += [sentence(rnd, 40, VOCABULARY) + " " + shared for _ in range(20)]
    rnd.shuffle(texts)
    return texts


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(60):
        a = sentence(rnd, rnd.randint(1, 60), VOCABULARY[:rnd.choice([3, 50, 400])])
        b = edited(rnd, a, rnd.randint(0, 3)) if rnd.random() < .8 else sentence(rnd, 20, VOCABULARY)
        s = similarity(a, b)
        got = N.alignment_similarity(N.kmers(a), N.kmers(b))
        assert got == pytest.approx(s if s >= 0.8 else 0.0)
    x = np.arange(100, dtype=np.uint64)
    moved = np.concatenate([x[40:], x[:40]])        # the same set in another order is not alike
    assert N.alignment_similarity(x, moved) == 0


def test_kmers_are_distinct_and_blockwise_sketch_is_the_same(monkeypatch):
    text = "a b c d e " * 300
    x = N.kmers(text)
    assert len(set(x.tolist())) == len(x) == 1496
    whole = N.order_minhash(x)
    monkeypatch.setattr(N, "BLOCK", 7)
    assert (N.order_minhash(x) == whole).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(llm, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: r["class_id"] for r in N.assign(make_docs(llm, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_large_group_of_near_copies_is_one_class(llm):
    rnd = random.Random(3)
    base = sentence(rnd, 120, VOCABULARY)
    texts = [edited(rnd, base, 1) for _ in range(300)] + [base] * 100
    assert {r["class_id"] for r in N.assign(make_docs(llm, texts)).collect()} == {0}


def test_odd_rows(odd, empty):
    rows = N.assign(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[6] == 5 and by_id[0] == 0 and by_id[1] == 1      # copies; null and empty texts alone
    assert all(r["class_id"] is None for r in rows if r["doc_id"] is None)
    assert N.assign(empty).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(3) == 1 and 6 not in ids and ids.count(None) == 2
    assert N.keep_one(empty).count() == 0
