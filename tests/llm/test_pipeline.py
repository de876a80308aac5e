"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline as pipeline
from tokentide.llm import near_copies
from tests.llm.test_corpus_operators import lines_brute, words


def shingles_brute(text, n=5):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_brute(texts, least=0.8):
    sets = {k: shingles_brute(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in sorted(texts):
        for b in (b for b in texts if b > a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    return root


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = ["\n".join(words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", words(rng, 5), "a b c " * 60, "", texts[2].upper()]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t) for t in texts]})
    at = tmp_path_factory.mktemp("corpus")
    docs.to_parquet(at / "documents.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "quality": 1, "toxic": 0}).to_parquet(at / "labels.parquet")
    return str(at), texts


def test_stages_against_brute_force(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        assert stage is pipeline.STAGES[-1][1] or set(docs.columns) == set(pipeline.COLUMNS)
        docs = pipeline.materialise(stage(spark, docs, at))
        seen[name] = docs.collect()
    good = [i for i, t in enumerate(texts) if len(t.split()) >= 50 and "a b c a b c" not in t]
    assert sorted(r["doc_id"] for r in seen["quality rules"]) == good
    lines = {i: t for i, (t, n) in zip(good, lines_brute([texts[i] for i in good], 10), strict=True) if t.strip()}
    assert {r["doc_id"]: r["text"] for r in seen["line dedup"]} == lines
    roots = similar_brute(lines)
    assert roots[45] == 2
    assert sorted(r["doc_id"] for r in seen["SimHash near-dedup"]) == sorted(set(roots.values()))
    copies = Counter(r["doc_id"] for r in seen["mixing sources to target weights"])
    assert set(copies) <= set(roots.values()) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in seen["BPE encoding and decoding"]) == copies
    again = pipeline.run(spark, at).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, seen["BPE encoding and decoding"]))


def test_near_copies_against_brute_force(spark):
    """Copies, loose and close near copies, a hot group, shared passages, nulls, empty and very short texts, keys that are missing."""
    rng = random.Random(6)
    texts = [None, "", " ", "one", "ONE", "one two", words(rng, 3000)]
    base = [words(rng, rng.randint(60, 300)) for _ in range(30)]
    for t in base:
        w = t.split()
        for edits in (1, 2, 4, 8):
            for at in rng.sample(range(len(w)), edits):
                w[at] = words(rng, 1)
            texts.append(" ".join(w))
    hot = words(rng, 200).split()
    for _ in range(300):
        w = list(hot)
        w[rng.randrange(200)] = words(rng, 1)
        texts.append(" ".join(w))
    passage = words(rng, 60)
    texts += [f"{passage} {words(rng, rng.randint(3, 60))}" for _ in range(60)] + base + [base[0].upper()]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "one", 1, 2, 3)], "doc_id long, text string, slot int, u int, digest int")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs.repartition(3)).collect()}
    assert got.pop(None) == 3
    assert got == similar_brute(dict(enumerate(texts)))
    assert near_copies.similar_documents(docs.where("doc_id < 0")).count() == 0


def test_trie_joins_the_closest_copies(spark, monkeypatch):
    """Without any slot, copies with one word of some thousands changed are still found, by their fingerprints; others are not joined."""
    rng = random.Random(8)
    texts = {i: words(rng, 3000) for i in range(8)}
    texts |= {i + 8: texts[i] + " end" for i in range(8)} | {16: "", 17: words(rng, 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    none = spark.createDataFrame([], "u long, v long, cut boolean")
    monkeypatch.setattr(near_copies, "candidates", lambda *_: none.select("u", "v"))
    monkeypatch.setattr(near_copies, "strangers", lambda *_: none)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs).collect()} == similar_brute(texts)


def test_blocks_find_what_slots_leave(spark, monkeypatch):
    rng = random.Random(7)
    passage = words(rng, 200)
    texts = {i: f"{passage} {words(rng, 30 + i // 2 % 3)}" for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs, similarity=0.7).collect()} == similar_brute(texts, 0.7)


def test_links_of_documents_set_aside(spark, monkeypatch):
    """Each of the last documents is a near copy of one member of a hot group only, and not of its smallest one."""
    rng = random.Random(9)
    hot = words(rng, 200).split()

    def edited(w, places):
        w = list(w)
        for at in places:
            w[at] = words(rng, 4).replace(" ", "")
        return w

    members = [edited(hot, [rng.randrange(5, 195)]) for _ in range(400)]
    hung = [edited(m, [20, 60, 100, 140]) for m in members[100:140]]
    texts = {i: " ".join(w) for i, w in enumerate(members + hung)}
    want = similar_brute(texts)
    assert sum(want[i] == 0 for i in range(400, 440)) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "FIRST_TRIES", 2)  # more rounds
    assert {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs).collect()} == want


def test_short_copies_of_one_text(spark):
    """Texts of some twenty words, each with one word changed: many pairs near the limit, and a few links between them."""
    rng = random.Random(10)
    base = [words(rng, 1) + str(i) for i in range(26)]
    texts = {}
    for i in range(260):
        w = list(base)
        w[rng.choice([0, 0, 0, 25, 25, 12, rng.randrange(26)])] = f"x{i % 90}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs).collect()} == similar_brute(texts)


def test_missing_and_repeated_doc_ids(spark, tmp_path):
    rng = random.Random(21)
    texts = [words(rng, 80) for _ in range(12)]
    ids = [None, None, None, 5, 5, 5, 6, 7, 8, 9, 10, 11]  # a missing and a repeated doc_id of different texts
    rows = [*zip(ids, texts, strict=True), (None, texts[0] + " end"), (5, texts[3]), (5, texts[3]), (3, texts[1] + " end"), (None, texts[6])]
    docs = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows], "lang": "en", "source": [f"s{k % 2}" for k in range(len(rows))], "n_chars": [len(t) for _, t in rows]})
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": [5, 6], "quality": 1, "toxic": 0}).to_parquet(tmp_path / "labels.parquet")
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    one = pipeline.materialise(pipeline.one_of_near_copies(spark, table, ""))
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert len(kept) == 12
    assert Counter(i for i, _ in kept) == Counter([None, None, 3, 5, 5, 5, 6, 7, 8, 9, 10, 11])
    assert (3, texts[1] + " end") in kept and (6, texts[6]) in kept and (5, texts[3]) in kept
    want = Counter()
    for r in pipeline.mixing.mix_sources(one).collect():
        want[r["source"]] += r["copies"]
    mixed = pipeline.mix(spark, one, "").collect()
    times = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert max(times.values()) <= 3 and Counter(r["source"] for r in mixed) == want
    assert any(i is None for i, _ in times)
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert any(r["doc_id"] is None for r in out) and sum(r["doc_id"] == 5 for r in out) <= 9
    assert sorted(map(str, out)) == sorted(map(str, pipeline.run(spark, str(tmp_path)).collect()))
