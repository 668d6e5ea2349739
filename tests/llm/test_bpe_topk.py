"""Operators 8 and 7: encoding against tiktoken, search against brute force, odd rows."""
import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from duelframe.llm import bpe as B
from duelframe.llm import queries as Q
from duelframe.llm import topk as K
from llm_helpers import empty, llm, make_docs, odd  # noqa: F401

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return B.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(vocabulary)})


def test_merge_of_long_pieces(vocabulary, library):
    ranks, rnd = {t: i for i, t in enumerate(vocabulary)}, random.Random(1)
    for alphabet in ("a", "ab", "abcdefgh", "é日x"):
        for n in (1, 2, 3, 50, 2000):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            assert B.merge(word.encode(), ranks) == library.encode_ordinary(word)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 99), (37, 9)])
def test_stitched_chunks_equal_the_library(llm, vocabulary, library, chunk, overlap):
    rnd = random.Random(chunk)
    texts = [None, "", "a"]
    for alphabet in ("ab 'srevl\n", "  \t\nx'", "é日本 ña🙂1", "aaaa", "0123 "):
        for n in (30, chunk, chunk + 1, 300, 1500):
            texts += ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(4)]
    texts += ["a" * 2000, " " * 2000, "x" * 300 + " " * 500 + "'ve" * 200, texts[-1]]
    rows = B.decode(B.encode(make_docs(llm, texts), vocabulary, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap),
                    vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()


def test_query_equals_the_library(llm, library):
    rows = {r["doc_id"]: r for r in Q.op8_byte_bpe(llm, SF01).collect()}
    docs = llm.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = np.array(library.encode_ordinary(d["text"] or ""), "<u4"), rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_bpe_odd_rows(odd, empty, vocabulary, library):
    got = B.decode(B.encode(odd, vocabulary, public_tokenizers.PATTERN), vocabulary)
    rows = got.collect()
    assert len(rows) == odd.count() and sorted(got.columns) == sorted(odd.columns)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert B.decode(B.encode(empty, vocabulary, public_tokenizers.PATTERN), vocabulary).count() == 0


def brute(rows, k, asks):
    """(query, rank, id, score) by plain loops over rows (id, vector), told apart by their place."""
    out = []
    for n, (q, v) in enumerate(rows):
        if asks(q):
            s = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n))[:k]
            out += [(q, r, None if null else i, -x) for r, (x, null, i) in enumerate(s, 1)]
    return sorted(out, key=in_order)


def in_order(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("rows,shard,block", [(300, 64, 8), (300, 1000, 1000), (300, 20, 7), (15, 4, 2)])
def test_search_equals_brute_force(llm, rows, shard, block):
    rnd = np.random.RandomState(rows)
    vectors = np.round(rnd.randn(rows, 6), 1)
    vectors[rows // 2:] = vectors[:rows - rows // 2]               # ties
    ids = [None if i % 29 == 0 else i if i % 3 else i // 30 * 30 for i in range(rows)]      # repeated and null ids
    df = llm.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    got = K.search(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=shard, block=block)
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in zip(ids, vectors)]
    assert sorted(map(tuple, got.collect()), key=in_order) == brute(whole, 7, lambda i: i is not None and i % 5 == 0)


def test_bounds_cut_work():
    rnd = np.random.RandomState(1)
    centres = rnd.randn(20, 8) * 200
    v = np.floor(centres[rnd.randint(0, 20, 4000)] + rnd.randn(4000, 8))
    tree = K.BallTree(np.arange(4000), v, 64)
    s, order, work = tree.search(v[:50], np.arange(50), 5, np.full(50, -np.inf))
    assert work < 50 * 4000 / 2
    full = v[:50] @ v.T
    full[np.arange(50), np.arange(50)] = -np.inf
    assert (np.sort(full, axis=1)[:, ::-1][:, :5] == s).all()
    assert (np.take_along_axis(full, order, 1) == s).all()
    _, _, again = tree.search(v[:50], np.arange(50), 5, s[:, -1])
    assert again <= work                                          # a shared k-th score cuts more


def test_search_odd_rows(llm):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (20, None), (40, [None, 1.0]), (60, [nan, 1.0]), (80, [inf, 1.0]),
            (None, [1.0, 1.0]), (1, [1.0]), (2, []), (3, [0.0, 0.0]), (4, [-1.0, -1.0, 5.0])]
    df = llm.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, score string, id string, at string")
    fine = [(i, [math.floor(64 * x) for x in v] + [0] * (3 - len(v))) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = brute(fine, 20, lambda i: i is not None and i % 20 == 0)
    assert sorted(map(tuple, K.search(df, F.col("vec_id") % 20 == 0).collect()), key=in_order) == want
    assert K.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert K.search(df.where("vec_id = 1"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        K.search(llm.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), F.lit(True))


def test_rows_of_one_id_are_queries_and_candidates_of_each_other(llm, tmp_path):
    """Two query rows of one id have two rankings, and each is a candidate of the other."""
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [0.1, 0.0])]
    got = K.search(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 20, 2048), (20, 1, 20, 2048), (20, 2, 1, 192), (20, 2, 1, 384)]
    rnd = np.random.RandomState(3)
    rows = [(int(i), np.round(rnd.randn(5), 1).tolist()) for i in rnd.randint(0, 60, 300)]
    rows += [(20, [0.5] * 5)] * 30 + rows[:40] + [(None, [0.5] * 5)] * 3
    llm.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in Q.op7_ball_tree(llm, str(tmp_path)).collect()]
    assert sorted(got, key=in_order) == sorted(con.sql(Q.OP7_SQL).fetchall(), key=in_order)


def test_query_equals_sql(llm):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in Q.op7_ball_tree(llm, SF001).collect())
    assert got == sorted(con.sql(Q.OP7_SQL).fetchall())
