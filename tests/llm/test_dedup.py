import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup as E
from panelweave.llm import simhash as S
from panelweave.llm.components import connected_components
from panelweave.llm.scratch import Scratch

UP = str.maketrans(E.UPPER, E.UPPER.lower())
DOCS = "doc_id long, text string, kept string, name long"


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_dedup_against_brute_force(spark, block):
    rng = random.Random(block)
    texts = [None, "", "A", "a", "É", "é", "x" * 50, "X" * 50, "x" * 51, "ab" * 20 + "c", "ab" * 20 + "C", "\x00", " a"]
    texts += ["".join(rng.choice("abAB") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in E.exact_dedup(spark.createDataFrame(data, DOCS), block_bytes=block).collect()}
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[(t or "").translate(UP)].append(i)
    assert len(got) == len(data)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_tells_apart_blocks_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "abcd", "", 0), (2, "abcd", "", 0), (3, "abce", "", 0), (4, "zbcd", "", 0)], DOCS)
    got = {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(df, block_bytes=2).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}


def test_exact_dedup_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "", 0), (1, "A", "", 0), (1, "b", "", 0), (None, "b", "", 0), (None, "q", "", 0), (None, "q", "", 0)], DOCS)
    got = rows_of(E.exact_dedup(df).fillna(-1), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, 1, 2, False), (1, 1, 2, False), (1, 1, 2, True), (1, 1, 2, True)]
    assert E.exact_dedup(df.where("doc_id = 99")).count() == 0
    kept = E.keep_first(df)
    assert kept.columns == df.columns and kept.count() == 3


def brute_fingerprint(text, k=4):
    words = [w for w in (text or "").translate(UP).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "One two", "a b c d", "é\xa0x y z w", "a\x0bb\x0cc\rd e a b c d e"]
    texts += [" ".join(rng.choice(["Uno", "dos", "tres", "ÇA", "x"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for chunk in (3, S.CHUNK):
        monkeypatch.setattr(S, "CHUNK", chunk)
        for t in texts:
            assert S.fingerprint(t) == brute_fingerprint(t)


def components_of(fps, limit=4):
    p = list(range(len(fps)))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= limit):
            p[find(int(j) + i + 1)] = find(i)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("block", "bits", "cells", "ahead"), [(7, 4, S.CELLS, 1), (8192, 4, 64, 2), (9, 10, 64, 1), (8192, 1, S.CELLS, 1)])
def test_near_links_keep_every_component(spark, monkeypatch, block, bits, cells, ahead):
    monkeypatch.setattr(S, "CELLS", cells)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [0, 2**64 - 1, 2**63, *map(int, base)]
    for b in base:
        x = int(b)
        for _ in range(rng.integers(0, 12)):
            y = x
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(bit)
            fps.append(y)
            x = y if rng.random() < 0.5 else x
    fps = np.unique(np.array(fps, np.uint64))
    scratch = Scratch(spark, "test")
    df = scratch.save(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "f0 long"))
    links = [tuple(r) for r in S.near_links(df, S.Scheme(4, bits, ahead=ahead), "f0", block).collect()]
    signed = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    assert all(bin(int(fps[signed[a]] ^ fps[signed[b]])).count("1") <= bits for a, b in links)
    p = list(range(len(fps)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        p[find(signed[a])] = find(signed[b])
    mine, true = [find(i) for i in range(len(fps))], components_of(fps, bits)
    assert len(set(zip(mine, true, strict=True))) == len(set(true)) == len(set(mine))


def test_simhash_dedup_edges(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all the other animals in the wood " * 20
    df = spark.createDataFrame([(5, base, "", 0), (3, base.upper(), "", 0), (9, base + "end", "", 0), (7, None, "", 0), (8, "", "", 0), (2, "quite another text of some words that is like no other here", "", 0), (2, "quite another text of some words that is like no other here", "", 0)], DOCS)
    got = rows_of(S.simhash_dedup(df), "doc_id", "fingerprint", "component_id")
    want = {5: 3, 3: 3, 7: 7, 8: 7, 2: 2}
    assert len(got) == 7 and all(c == want[d] for d, _, c in got if d in want)
    assert all(f == f"{brute_fingerprint(dict((r[0], r[1]) for r in df.collect())[d]):016x}" for d, f, _ in got)
    assert S.simhash_dedup(df.where("doc_id = 99")).count() == 0
    assert sorted(r["doc_id"] for r in S.keep_representatives(df).collect()) == [2, 3, 7]
    assert S.keep_representatives(df.where("doc_id = 99")).count() == 0


def test_simhash_stage_on_repeats_nulls_and_clashing_names(spark):
    long = "word" + " w%d" * 5000 % tuple(range(5000))
    schema = "doc_id long, text string, f0 string, k string, doc string, h long, n int, _keep long"
    data = [(1, "a b c d e f g", "x", "k", "d", 1, 2, 3)] * 3 + [(1, "quite another text that no other is like", "x", None, "d", 1, 2, 3), (None, long, "y", "k", "d", 1, 2, 3), (None, None, "z", "k", "d", 1, 2, 3), (4, " ", "z", "k", "d", 1, 2, 3)]
    df = spark.createDataFrame(data, schema)
    got = S.keep_representatives(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [data[0], data[3], data[4], data[6]]))


def brute_similar(texts, limit, bits):
    """Groups of texts by the fingerprints of four words over the distinct shingles of five words."""
    scheme = S.Scheme.similar(0.8)
    out = []
    for t in texts:
        w = t.encode().lower().split()
        grams = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        hs = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        words = [hs, *[S._mixed(hs, k) for k in range(1, scheme.words)]]
        out.append([sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x)) for x in words])
    assert out == [S.fingerprint_words(t, scheme) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            d = [(a ^ b).bit_count() for a, b in zip(out[i], out[j], strict=True)]
            if d[0] <= bits and sum(d) <= limit:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_simhash_stage_against_brute_force_and_similarity(spark):
    rng = random.Random(11)
    texts, of = [], []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 260))]
        texts.append(" ".join(base))
        of.append(g)
        for _ in range(6):
            other = list(base)
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(other))
            of.append(g)
    scheme = S.Scheme.similar(0.8)
    label = brute_similar(texts, scheme.total, scheme.bits)
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in S.keep_representatives(docs).collect()}
    assert kept == {min(i for i, x in enumerate(label) if x == y) for y in set(label)}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [label[i] == label[j] for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.9 * len(grams[i] | grams[j])]
    assert len(near) > 50 and sum(near) / len(near) > 0.9
    assert all(of[i] == of[j] for i in range(len(texts)) for j in range(i) if label[i] == label[j])


def test_components_random_and_hub(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, 1000 + i) for i in range(1, 80)] + [(i, i + 1) for i in range(2000, 2070)] + [(5, 5), (None, 4)]
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            p[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize(("bits", "ahead"), [(4, 1), (4, 2), (10, 1), (10, 2), (1, 1)])
def test_some_key_and_its_chains_hold_for_every_near_pair(bits, ahead):
    scheme = S.Scheme(4, bits, ahead=ahead)
    assert all(chains[-1] == ((1 << 64) - 1, bits) for _, chains in scheme.masks)
    rng = random.Random(bits)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(bits + 1)))
        assert any(diff & mask == 0 and all((diff & ring).bit_count() <= most for ring, most in chains) for mask, chains in scheme.masks)
