"""Merkle manifest, periodic runs and embedding near-dedup against brute force: nulls, ties, copies, long rows, clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentide.llm import embedding_dedup, merkle, period_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, place int, tree int, runs int, task int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(spark, tmp_path, rows, schema, name, files=3):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    proofs = []
    for k in range(len(leaves)):
        proof, at = [], k
        for level in levels[:-1]:
            low = at - at % arity
            proof.append((level[low:at], level[at + 1 : low + arity]))
            at //= arity
        proofs.append(proof)
    return levels[-1][0], proofs


def manifest_brute(rows, arity=3):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*(code(v) for v in (r[0], r[3], r[2], r[4], text)))
    groups = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {g: sorted((r for r in rows if r[3] == g), key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[1]))) for g in groups}
    trees = {g: tree([leaf(r, r[1]) for r in mine[g]], arity) for g in groups}
    root, above = tree([trees[g][0] for g in groups], arity)
    out = []
    for g, up in zip(groups, above, strict=True):
        for r, proof in zip(mine[g], trees[g][1], strict=True):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if hit else r[1])
            for before, after in [*proof, *up]:
                now = sha(*before, now, *after)
            out.append((r[0], leaf(r, r[1]), trees[g][0], root, sha(*(s for b, a in [*proof, *up] for s in b + a)), now, now == root))
    return sorted(out, key=str)


def documents(n, rng):
    rows = [(k if k % 7 else None, rng.choice([None, "", "a\nb\n", "Ä\n\n", "x", f"text {k}\n"]), rng.choice([None, "en"]), rng.choice([None, "a", "B", "ä", "z" * 40]), rng.choice([None, k]), "h", 1, 2, 3, 4) for k in range(n)]
    return rows + rows[:4] + [(500, "w " * 30_000 + "\n", "en", "one", 7, "h", 1, 2, 3, 4)]


@pytest.mark.parametrize("n", [0, 3, 40, 130])
def test_manifest_equals_brute_force(spark, tmp_path, n):
    rows = documents(n, random.Random(n))
    folder = written(spark, tmp_path, rows, SCHEMA, "documents")
    got = queries.op11_merkle(spark, folder)
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    want = manifest_brute(rows)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
    assert n < 40 or (any(not w[-1] for w in want) and any(w[-1] for w in want))


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_of_other_arity_folds_to_its_root(spark, arity, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 10)  # both ways to join levels
    monkeypatch.setattr(merkle, "SMALL_PATHS", 2)
    rows = [r for r in documents(60, random.Random(1)) if r[0] is not None]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), queries.FIELDS, arity=arity)
    got = merkle.verified(found.withColumn("given", F.lit(None).cast("string")), "given").collect()
    want = {w[1]: (w[2], w[3]) for w in manifest_brute(rows, arity)}
    assert len(got) == len(rows) and all(r["verified"] and (r["subroot"], r["root"]) == want[r["leaf"]] for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), queries.FIELDS).count() == 0


def test_queries_equal_sql(spark):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the given tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("op11_merkle", "op13_embedding_dedup"):
        got, want = queries.queries()[name](spark, data).toPandas(), con.execute(queries.oracle_sql()[name]).df()
        assert len(want) and sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()))


def runs_brute(x, shortest=12):
    found = {}
    for p in range(1, len(x) // 2 + 1):
        at = 0
        while at < len(x) - p:
            end = at
            while end < len(x) - p and x[end] == x[end + p]:
                end += 1
            if end - at + p >= max(shortest, 2 * p):
                found.setdefault((at, end + p), p)
            at = max(end, at + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def sequences(rng):
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    fixed = [[], [0] * 11, [0] * 12, [0] * 700, fib[-1], [0] * 300 + [1] + [0] * 300, ([0] * 100 + [1]) * 6, [0, 1] * 150 + [0] + [0, 1] * 150, ([0, 1, 2] * 40 + [5]) * 4, list(range(400)) * 2]
    made = []
    for _ in range(60):
        x = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.choice([5, 60, 300, 900]))]
        for _ in range(rng.randrange(5)):
            a, p = rng.randrange(len(x)), 1 + rng.randrange(max(1, len(x) // rng.choice([2, 3, 8])))
            for k in range(a + p, min(len(x), a + int(p * rng.choice([1.5, 2, 2.1, 3, 9])))):
                x[k] = x[k - p]
        made.append(x)
    return fixed + made


def test_runs_equal_brute_force():
    cases = sequences(random.Random(4))
    got = period_runs.find_runs([np.array(c, np.int64) for c in cases])
    assert [list(map(tuple, g.tolist())) for g in got] == [runs_brute(c) for c in cases]
    assert period_runs.find_runs([]) == []


def test_run_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(period_runs, "TOGETHER", 500)
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "Ä\tä", "lone line"] + [" ".join(f"w{v}" for v in c) for c in sequences(rng)] + ["x y z " * 9]
    rows = [(k if k != 3 else None, t, "en", "s", 1, "h", 1, 2, 3, 4) for k, t in enumerate(texts)]
    rows += rows[10:14] + [(1000 + k, " ".join(f"w{v}" for v in range(40 + k)), None, None, None, None, None, None, None, None) for k in range(40)]
    folder = written(spark, tmp_path, rows, SCHEMA, "documents")
    got = queries.op12_runs(spark, folder)
    want, planted = [], 0
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = runs_brute(words)
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in drop))))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(want, key=str)
    assert planted > 3 and sum(w[1] for w in want) > 100
    assert period_runs.run_digest(period_runs.periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def near_brute(rows, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if u else None for (_, v), u in zip(rows, usable, strict=True)]
    n = len(rows)
    link = [[a != b and usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold for b in range(n)] for a in range(n)]
    label = list(range(n))
    for a in range(n):
        stack, seen = [a], {a}
        while stack:
            x = stack.pop()
            for b in range(n):
                if link[x][b] and b not in seen:
                    seen.add(b)
                    stack.append(b)
        keys = [rows[k][0] for k in seen if rows[k][0] is not None]
        label[a] = min(keys, default=None)
    return sorted(((rows[a][0], sum(link[a]), label[a], rows[a][0] == label[a]) for a in range(n)), key=str)


def vectors(rng, n, d):
    base = rng.normal(size=(n, d))
    rows = [base[k] for k in range(n)]
    for k in range(n // 3):  # near copies on both sides of the threshold
        rows.append(base[k] / np.linalg.norm(base[k]) + rng.normal(size=d) / np.sqrt(d) * rng.choice([0.1, 0.25, 0.3, 0.33, 0.36]))
    centre = rng.normal(size=d)
    rows += [centre / np.linalg.norm(centre) + rng.normal(size=d) / np.sqrt(d) * s for s in rng.choice([0.05, 0.12, 0.2, 0.28], 70)]
    rows += [rows[0], rows[0], rows[1] * 3, rows[2] * 1e-30, rows[2] * 1e30]
    return [np.float32(r).tolist() for r in rows]


@pytest.mark.parametrize("dense", [8, 10_000])
def test_vectors_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    monkeypatch.setattr(embedding_dedup, "IN_CELL", 8)
    rng = np.random.default_rng(dense)
    rows = [(k * 3 if k % 11 else None, v) for k, v in enumerate(vectors(rng, 150, 12))]
    rows += [(1, None), (2, []), (4, [0.0] * 12), (5, [None, *([1.0] * 11)]), (7, [float("nan")] * 12), (8, [float("inf")] * 12), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]), (300, rows[3][1]), (300, rows[3][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cls int, links int").repartition(3)
    names = ["vec_id", "n_links", "component_id", "kept"]
    want = near_brute(rows)
    exact = embedding_dedup.near_vectors(table, recall=1.0)
    assert sorted((tuple(r[c] for c in names) for r in exact.collect()), key=str) == want
    found = embedding_dedup.near_vectors(table).collect()  # the calibrated walk
    assert sum(r["n_links"] for r in found) >= 0.98 * sum(w[1] for w in want) > 0
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_walk_is_in_the_order_of_its_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.MultiIndex(np.dtype(np.float32), 6, (x[:5, :3], x[5:9, 3:]), 0.95, 0.05, np.zeros((0, 6)), np.zeros(0, np.int64))
    parts = np.full(40, 6)
    rows, cells = index.walk(x, parts, np.full(40, -1))
    (one, two), _ = index.bounds(x)
    for k in range(40):
        need = {(6 * 5 + i) * 4 + j: one[k, i] + two[k, j] for i in range(5) for j in range(4)}
        walked = cells[rows == k].tolist()
        assert set(walked) == {c for c, v in need.items() if v <= 0.05} and [need[c] for c in walked] == sorted(need[c] for c in walked)
