"""Substring dedup, the conversation trie and whitening against slow versions and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from auditloom.llm import prefix_trie, substring_dedup, whitening
from auditloom.llm import queries as training_data
from auditloom.llm._common import join_counted

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def duck(name, sql, columns):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return sorted(map(str, con.execute(f"select {columns} from ({sql})").fetchall()))


# ---------------------------------------------------------------- substring dedup


def slow_repeats(texts, stretch):
    words = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + stretch]) for w in words for i in range(len(w) - stretch + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - stretch + 1) if starts[tuple(w[i : i + stretch])] > 1 for k in range(stretch)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages():
    r = random.Random(5)
    word = lambda n=400: "w" + str(r.randrange(n))
    text = lambda n, k=400: " ".join(word(k) for _ in range(n))
    shared, long = text(12), text(90)
    texts = [None, "", " \t\n", "one", shared, text(9), text(10)]
    texts += [f"{text(r.randrange(6))} {shared} {text(r.randrange(30))}" for _ in range(40)]  # one passage, different surroundings
    texts += [long] * 5 + [long + " more", "x" + long, long.replace("w1", "W1")]  # copies and near copies
    texts += ["a " * 60, "a b " * 40, text(300, 2), text(300, 3)]  # repeats within a text
    texts += [f"é ü {long[: 20 * k]}\x0bend" for k in range(1, 9)]  # shared beginnings of growing length
    texts += [text(r.randrange(1, 80), 9) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("stretch", "gram"), [(10, 4), (10, 10), (7, 1), (35, 8)])
def test_repeats_are_the_slow_ones(spark, stretch, gram):
    texts = passages()
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, words string, ka long")
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, stretch, gram).collect()}
    expected = slow_repeats(texts, stretch)
    assert len(rows) == len(texts)
    for i, e in enumerate(expected):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256, rows[i].text) == e, texts[i]
        assert sum(x.length for x in rows[i].repeats) == e[1] and all(x.length >= stretch for x in rows[i].repeats)
    assert sum(e[1] for e in expected)


def test_repeats_of_awkward_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 4, 2).collect()]
    assert sorted(rows, key=str) == sorted([(None, 6, 6), (1, 6, 6), (1, 6, 6), (2, 0, 0), (None, 0, 0)], key=str)
    assert substring_dedup.remove_repeats(docs.where("false"), 4, 2).count() == 0
    with pytest.raises(ValueError, match="anchor"):
        substring_dedup.remove_repeats(docs, 4, 5)


def test_repeats_equal_sql(spark):
    got = training_data.op11_substring_dedup(spark, SF).collect()
    assert sorted(str(tuple(r)) for r in got) == duck("documents", substring_dedup.ORACLE_SQL, "doc_id, n_words, n_removed, kept_sha256")


def test_first_least_places():
    values = np.array([3, 1, 1, 2, 0, 0, 5, 0, 9, 9, 9, 4], dtype=np.uint64)
    for width in range(1, 13):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert substring_dedup._least_places(values, width).tolist() == expected


def test_counted_joins_give_frequent_keys_by_broadcast(spark):
    rows = spark.createDataFrame([(k, i) for i in range(400) for k in ([1] if i % 2 else [2, i])] + [(None, 7)], "k long, i long")
    counts = rows.where("k is not null").groupBy("k").count().selectExpr("k", "count", "2 * k as twice")
    got = join_counted(rows, counts, ["k"], "count", ["twice"])
    assert sorted((r.k, r.i, r.twice) for r in got.collect()) == sorted((r.k, r.i, 2 * r.k) for r in rows.collect() if r.k is not None)
    assert got.columns == ["k", "i", "twice"] and join_counted(rows, counts.where("k > 5"), ["k"], "count", ["twice"], how="left").count() == rows.count()


# ---------------------------------------------------------------- conversation trie


def slow_trie(turns, base, head):
    own = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    built = {c: tuple(own.get(base(c), [])[: head(c)] + own[c][head(c) :]) for c in own}
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    rows = []
    for prefix, members in nodes.items():
        under = [p for p in nodes if p[: len(prefix)] == prefix]
        parents = {p[:-1] for p in nodes if p}
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(prefix))
        rows.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in under), sum(p not in parents for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


BASE, HEAD = (lambda c: c - c % 5), (lambda c: zlib.crc32(str(c).encode()) % 9)


def trie_of(spark, turns, **how):
    frame = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, node long, class string")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, **how).collect()), key=str)


def test_trie_is_the_slow_one(spark):
    r = random.Random(3)
    turns = [(c, t if r.random() < 0.97 or t else None, r.choice(["user", "assistant", None]), r.choice(["hi", "é", "", None, "yes"])) for c in range(40) for t in range(r.randrange(1, 7))]
    turns += [(c, t, "u", "same") for c in (50, 51, 52, 57) for t in range(3)]  # copies
    turns += [(63, 0, "u", "gone")] + [(60, t, "u", "long" + str(t // 7)) for t in range(40)]
    assert trie_of(spark, turns) == slow_trie(turns, BASE, HEAD)


def test_trie_of_other_bases_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN_BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 4)
    turns = [(c, t, "u", "abc"[t % 3] * (t + 1)) for c in (1, 2, 3, 10, 11, 12, 13) for t in range(9 if c > 9 else 2)] + [(None, 1, "u", "lost"), (4, None, None, None)]
    none = {"base": lambda c: c, "head": lambda c: c * 0}
    assert trie_of(spark, turns, **none) == slow_trie(turns, lambda c: c, lambda c: 0)
    # every conversation loses its turns: all end at the root
    assert trie_of(spark, turns, base=lambda c: c + 1000, head=lambda c: c * 0 + 9, most=9) == slow_trie(turns, lambda c: c + 1000, lambda c: 9)
    assert trie_of(spark, [(None, 1, "u", "x")]) == [] and trie_of(spark, []) == []


def test_trie_equals_sql(spark):
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    got = training_data.op12_prefix_trie(spark, SF).selectExpr(*columns.split(", ")).collect()
    assert sorted(str(tuple(r)) for r in got) == duck("conversations", prefix_trie.ORACLE_SQL, columns)


# ---------------------------------------------------------------- whitening


def slow_whitening(rows):
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(256 * np.float64(c))) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    y = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x]) @ vectors[:, :4] / np.sqrt(values[:4])
    return [i for i, _ in rows], n, deviation, y, values[:4] / values.sum()


def test_whitening_is_the_slow_one(spark):
    r = np.random.default_rng(4)
    vectors = (r.normal(0, 1, (300, 6)) * [5, 3, 2, 1.5, 1, 0.5] + [1000, -1000, 0, 3e4, 5, 7]).astype(np.float32).tolist()
    rows = list(enumerate(vectors + vectors[:5] + [vectors[0]] * 200))
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0, 3.0, float("inf"), 1.0, 1.0]), (904, []), (905, [1.0, 2.0]), (3, vectors[9])]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, x string")
    got = sorted(whitening.whiten(frame).collect(), key=lambda g: (g.component, g.vec_id, g.deviation))
    ids, n, deviation, y, explained = slow_whitening([x for x in rows if x[0] != 905])
    order = sorted(range(len(ids)), key=lambda i: (ids[i], deviation[i]))
    for k in range(4):
        own = [g for g in got if g.component == k + 1]
        assert [g.vec_id for g in own] == [ids[i] for i in order] and [g.deviation for g in own] == [deviation[i] for i in order]
        mine, slow = np.array([g.whitened for g in own]), y[order, k]
        assert min(abs(mine - slow).max(), abs(mine + slow).max()) < 1e-8
        assert {g.n for g in own} == {n} and abs(own[0].explained / explained[k] - 1) < 1e-9
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


def test_scatter_is_exact_for_any_integers():
    r = np.random.default_rng(8)
    x = r.integers(-(1 << 62), 1 << 62, (20, 3))
    x[0] = [-(1 << 63), (1 << 63) - 1, 0]
    moduli = whitening.primes(20 * (1 << 63) ** 2)
    found = whitening.remaindered([whitening.modular_scatter(x, p) for p in moduli], moduli)
    whole = x.astype(object)
    assert (found == whole.T @ whole).all()
    assert len(set(moduli)) == len(moduli) and all(p < 1 << whitening.PRIME_BITS for p in moduli)
    assert (whitening.BLOCK_ROWS * (1 << (whitening.PRIME_BITS - 1)) ** 2) <= 1 << 53


def test_vectors_as_bytes(spark):
    import pyarrow as pa

    x = np.array([[0, -1], [127, -128], [128, 0], [-129, 5], [40000, 1], [1 << 40, -(1 << 40)], [-(1 << 63), (1 << 63) - 1]])
    images = whitening.packed(x)
    assert [len(i) // 2 for i in images] == [1, 1, 2, 2, 4, 8, 8]
    assert (whitening.unpacked(pa.array(images, type=pa.binary()), 2) == x).all()
    assert (whitening.unpacked(pa.array(images, type=pa.binary()).slice(2, 3), 2) == x[2:5]).all()


def test_whitening_without_variance_and_huge_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and line[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, -4.0])], schema)).collect()
    assert len(huge) == 6 and {r.vec_id for r in huge if r.deviation is None} == {1, 2} and all(np.isfinite(r.whitened) for r in huge if r.component == 1)
