"""Operators 11 to 13: against brute force and SQL, odd rows, hot rows."""
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import bond as B
from duelframe.llm import merkle as M
from duelframe.llm import mixing as X
from duelframe.llm import queries as Q
from llm_helpers import DOCS, empty, llm, make_docs, odd  # noqa: F401

SF001 = "/root/testdata/sf0.001"


def against_sql(df, sql, table, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in df.collect()]
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)
    assert got


# ---------------------------------------------------------------- 11

def brute_negatives(rows, positives, negatives, low=30, high=90):
    """Loops over (id, vector, label); rows are told apart by their place."""
    def first(scored, k):
        return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    out = []
    for i, (aid, a, al) in enumerate(rows):
        if aid is None or aid % 10:
            continue
        s = [(sum(x * y for x, y in zip(a, v)), vid, vl) for j, (vid, v, vl) in enumerate(rows) if j != i]
        for p, (ps, pid, _) in enumerate(first([x for x in s if x[2] == al], positives), 1):
            fits = [x for x in s if x[2] != al and low * ps <= 100 * x[0] <= high * ps]
            out += [(aid, pid, p, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(first(fits, negatives), 1)]
    return out


def as_rows(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key), key


@pytest.mark.parametrize("n,shard,block", [(400, 64, 4), (400, 10, 7), (60, 1000, 1000)])
def test_mining_equals_brute_force(llm, n, shard, block):
    rnd = np.random.RandomState(n + shard)
    v = np.round(rnd.randn(n, 6) + rnd.randint(0, 2, (n, 1)), 1)
    v[n // 2:] = v[:n - n // 2]                                     # equal scores
    ids = [None if i % 31 == 0 else int(i // 2 * 2 if i % 5 else i) for i in range(n)]     # repeated and null ids
    labels = [int(x) for x in rnd.randint(0, 3, n)]
    df = llm.createDataFrame([(i, x.tolist(), c) for i, x, c in zip(ids, v, labels)], "vec_id long, embedding array<float>, label int")
    got, key = as_rows(B.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), shard_rows=shard, block=block))
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in r], c) for i, r, c in zip(ids, v, labels)]
    assert got == sorted(brute_negatives(whole, 5, 10), key=key)


def test_scan_reads_few_columns_and_loses_nothing():
    rnd = np.random.RandomState(2)
    n, dim = 3000, 64
    weight = 0.8 ** np.arange(dim)
    v = np.floor(rnd.randn(dim, n) * 200 * weight[:, None])
    least, greatest = v.min(axis=1), v.max(axis=1)
    for i in range(20):
        a = v[:, i]
        alive = np.ones(n, bool)
        alive[i] = False
        exact = a @ v
        top = np.sort(exact[alive])[::-1]
        low, high = np.array([-np.inf, top[500]]), np.array([np.inf, top[400]])
        rows, score, work = B.scan(a, v, least, greatest, alive, low, high, np.full(2, -np.inf), 10)
        assert work < n * dim / 2
        assert (score == exact[rows]).all()
        assert set(np.flatnonzero(alive & (exact >= top[9]))) <= set(rows)
        inside = np.sort(exact[alive & (exact <= high[1])])[::-1][9]
        assert set(np.flatnonzero(alive & (exact <= high[1]) & (exact >= max(low[1], inside)))) <= set(rows)
        _, _, again = B.scan(a, v, least, greatest, alive, low[:1], high[:1], np.array([top[9]]), 10)
        assert again <= work                                        # a shared k-th score cuts more


def test_mining_odd_rows(llm):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 2), (3, [0.5, 0.5], 2), (None, [0.4, 0.5], 2), (4, [0.3], None),
            (10, None, 1), (20, [None, 1.0], 1), (30, [nan], 1), (40, [inf], 1), (50, [-1.0, -1.0, 9.0], 2), (60, [0.0, 0.0], 3)]
    df = llm.createDataFrame([(*r, "x", "y", "z") for r in rows],
                             "vec_id long, embedding array<double>, label int, row string, score string, id string")
    fine = [(i, [math.floor(256 * x) for x in v] + [0] * (3 - len(v)), c) for i, v, c in rows
            if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    got, key = as_rows(B.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), low=0, high=100))
    assert got == sorted(brute_negatives(fine, 5, 10, 0, 100), key=key) and got
    assert B.mine(df.where("false"), F.lit(True), F.col("label")).count() == 0
    assert B.mine(df.where("vec_id = 60"), F.lit(True), F.col("label")).count() == 0
    with pytest.raises(ValueError):
        B.mine(llm.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True), F.col("label"))


def test_bond_query_equals_sql(llm):
    against_sql(Q.op11_bond(llm, SF001), Q.OP11_SQL, "embeddings", f"{SF001}/embeddings.parquet")


# ---------------------------------------------------------------- 12

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """(last node, siblings of every node as (left, right), level by level)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1:run + 16])))
            at[k] = i // 16
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    subroots, held = [], []
    for name in names:
        docs = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], r[3], r[2], r[4], r[1]))))
        subroot, paths = tree([leaf((r[0], r[3], r[2], r[4], r[1])) for r in docs])
        subroots.append(subroot)
        held.append((docs, paths))
    root, tops = tree(subroots)
    out = []
    for (docs, paths), subroot, top in zip(held, subroots, tops):
        for r, path in zip(docs, paths):
            fields = [r[0], r[3], r[2], r[4], r[1]]
            own = leaf(fields)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                fields[4] = re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            node = leaf(fields)
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return out


def manifest_rows(llm, rows, folder, extra=False):
    df = llm.createDataFrame(rows, DOCS)
    if extra:
        for c in ("id", "leaf", "rank", "group", "n", "word", "bit", "path", "members", "_m"):
            df = df.withColumn(c, F.lit("mine"))
    df.write.parquet(f"{folder}/documents.parquet")
    return Q.op12_merkle(llm, str(folder))


def equal(df, want):
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_manifest_equals_brute_force(llm, tmp_path):
    rnd = random.Random(4)
    ids = rnd.sample(range(-5000, 5000), 700) + [2 ** 62, -2 ** 63, 2 ** 63 - 1, 63, 64, -64, -65]
    sizes = {"a": 300, "b": 17, "B": 16, "": 1, None: 33, "é": 257}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, rnd.choice(["Some Text", None, "", "ÄÖ x", "lower", "UP é日"]), rnd.choice(["en", None]), s, rnd.choice([3, None, 12]))
            for i, s in zip(ids, names)]
    rows += [(None, f"Null id {k % 5}", None, "a", 1) for k in range(40)]           # equal rows among them
    rows += [(7000, f"Copy {k % 30}", "en", "b", None) for k in range(90)] + rows[:20] + [(None, None, None, None, None)] * 3
    equal(manifest_rows(llm, rows, tmp_path, extra=True), brute_manifest(rows))


@pytest.mark.parametrize("n,sources", [(1, 1), (16, 1), (17, 1), (1, 17), (0, 0), (2, 300)])
def test_manifest_of_other_shapes(llm, tmp_path, n, sources):
    rows = [(s * n + k, f"Text {s} {k}", "en", f"s{s}", 5) for s in range(sources) for k in range(n)]
    equal(manifest_rows(llm, rows, tmp_path), brute_manifest(rows) if rows else [])


def test_directory_levels_and_shared_ids(llm, monkeypatch):
    """Many words in a group, with a directory of several levels, and one id with a third of all
    rows, many of them equal, ranked by ranges and unfolded in steps."""
    monkeypatch.setattr(M, "DIRECTORY", 4)
    monkeypatch.setattr(M, "TIE_ROWS", 8)
    monkeypatch.setattr(M, "COPIES", 3)
    rnd = random.Random(9)
    keys = [(rnd.choice("xy"), rnd.randrange(-10 ** 6, 10 ** 6) if k % 3 else 77, sha(str(k % 500))) for k in range(2000)]
    df = llm.createDataFrame(keys, "group string, id long, leaf string")
    got = M.rank_leaves(df, top_blocks=3).collect()
    want = []
    for g in "xy":
        own = sorted((i, h) for s, i, h in keys if s == g)
        want += [(g, i, h, r) for r, (i, h) in enumerate(own)]
    assert sorted((r["group"], r["id"], r["leaf"], r["rank"]) for r in got) == sorted(want)


def test_merkle_query_equals_sql(llm):
    against_sql(Q.op12_merkle(llm, SF001), Q.OP12_SQL, "documents", f"{SF001}/documents.parquet")


# ---------------------------------------------------------------- 13

def plain_targets(sizes, weights, share, most):
    """Reshare the excess, round after round."""
    stopped, out = set(), []
    while True:
        rest = share * sum(sizes) - sum(most * sizes[i] for i in stopped)
        total = sum(w for i, w in enumerate(weights) if i not in stopped)
        out = [most * s if i in stopped else rest * weights[i] / total for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in stopped and out[i] > most * s}
        if not over:
            return out
        stopped |= over


def test_targets_equal_resharing():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 12)
        sizes = [rnd.choice([0, 1, rnd.randint(0, 50), rnd.randint(0, 10 ** 6)]) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        want = plain_targets([Fraction(s) for s in sizes], weights, Fraction(3, 2), 2)
        assert X.targets(sizes, weights) == want


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutations(n):
    p, q = X.Permutation(n, 5, 1, 0), X.Permutation(n, 5, 1, 1)
    assert sorted(p(np.arange(n))) == list(range(n))
    assert (p(p(np.arange(n)), back=True) == np.arange(n)).all()
    assert n < 100 or (p(np.arange(n)) != q(np.arange(n))).mean() > 0.9


def test_shard_counts_are_a_multinomial_draw():
    totals = np.array([100_000, 0, 7, 3 * 10 ** 15])
    for shards in (1, 3, 64):
        got = [X.shard_counts(k, shards, totals, 1) for k in range(shards)]
        at = np.zeros(len(totals), np.int64)
        for first, n in got:
            assert (first == at).all() and (n >= 0).all()
            at = at + n
        assert (at == totals).all()
        assert abs(np.array([n[0] for _, n in got]) - 100_000 / shards).max() <= 6 * math.sqrt(100_000 / shards)


def check_mix(docs, rows, block, **more):
    """Per source and document, and every slot's words against the source's axis."""
    mix = X.plan(docs, block=block, **more)
    got = X.taken(mix).collect()
    assert sorted(((r["id"] is None, r["id"] or 0, r["size"]) for r in got)) == sorted((i is None, i or 0, len(words(t))) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t)) for _, t, s in rows if s == n) for n in names]
    want = plain_targets([Fraction(s) for s in sizes], [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3, 2), 2) if names else []
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_target = {}
    for r in got:
        key = (r["source_size"], r["target"])
        by_target[key] = by_target.get(key, 0) + r["taken"]
    expect = {}
    for s, t in zip(sizes, want):
        expect[(s, float(t))] = expect.get((s, float(t)), 0) + math.floor(t)
    assert by_target == expect
    # the axis of every source, from the documents' places
    axis = {}
    by_hash = {(r["i"], r["h"]): r["t"] for r in docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.col("text").alias("t")).collect()}
    for r in sorted(X.documents(mix).where("size > 0").collect(), key=lambda r: r["start"]):
        line = axis.setdefault(r["source_no"], [])
        assert len(line) == r["start"]
        line += words(by_hash[(r["id"], r["text_hash"])])
    assert [len(axis.get(i, [])) for i in range(len(names))] == sizes
    drawn = {(r["shard"], r["slot"]): r for r in X.draws(docs.sparkSession, mix).collect()}
    out = {(r["shard"], r["slot"]): r["text"] for r in X.texts(mix, docs).collect()}
    assert set(out) == set(drawn)
    seen = set()
    for k, d in drawn.items():
        assert words(out[k]) == axis[d["source_no"]][d["block"] * block:][:block][:d["words"]]
        assert (d["source_no"], d["pass"], d["block"]) not in seen                  # once in a pass
        seen.add((d["source_no"], d["pass"], d["block"]))
    return sorted(map(tuple, got), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mix_rows(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = "big" if i % 3 == 0 else rnd.choice(["a", "b", "é", "Z", None, "one"])
        rows.append((rnd.choice([i, i, None, 5]), " ".join(rnd.choice("abcdef") + str(k) for k in range(rnd.choice([0, 1, 7, 40, 300]))), s))
    return rows + [(1, None, "a"), (2, "", "empty"), (3, "only", "tiny")]


@pytest.mark.parametrize("block,slots,group", [(16, 8, 10), (512, 4096, 16_384), (1, 50, 3)])
def test_mix_against_the_axis(llm, block, slots, group):
    rows = mix_rows(block) + [(9, "equal rows with five words", "big")] * 60          # one row many times
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    first = check_mix(docs, rows, block, shard_slots=slots, group_rows=group)
    again = X.taken(X.plan(docs.repartition(7), block=block, shard_slots=slots, group_rows=group)).collect()
    assert sorted(map(tuple, again), key=str) == first                              # reruns agree


def test_copies_unfold_in_steps(llm, monkeypatch):
    monkeypatch.setattr(X, "COPIES", 7)
    rows = [(9, "a b c", "s")] * 100 + [(1, "x y", "t")] * 3 + [(2, "", "t")] * 20
    check_mix(llm.createDataFrame(rows, "doc_id long, text string, source string"), rows, 16)


def test_mix_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.select("doc_id", "text", "source").collect()]
    check_mix(odd, rows, 512)
    assert X.taken(X.plan(empty)).count() == 0
    nothing = empty.sparkSession.createDataFrame([(1, None, None, None, None), (2, " ", "en", "s", 1)], DOCS)
    assert [(r["taken"], r["target"]) for r in X.taken(X.plan(nothing)).collect()] == [(0, 0.0), (0, 0.0)]


def test_mixing_query(llm):
    rows = Q.op13_mixing(llm, SF001).collect()
    docs = llm.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {d["doc_id"]: len(words(d["text"])) for d in docs}
    assert {r["doc_id"]: r["size"] for r in rows} == size and len(rows) == len(docs)
    source = {d["doc_id"]: d["source"] for d in docs}
    got, want = {}, {}
    for r in rows:
        got[source[r["doc_id"]]] = got.get(source[r["doc_id"]], 0) + r["taken"]
        want[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(0 <= want[s] - got[s] < 1 for s in want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))
