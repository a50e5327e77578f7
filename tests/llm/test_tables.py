import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import embedding_dedup as V
from panelweave.llm import mixing as M
from panelweave.llm import url_filter as U
from panelweave.llm import warc as W
from panelweave.llm.prefix import running_sums
from panelweave.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, size long"


def filled(sizes, weights, most=3):
    """Targets by filling in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
        free -= over
    return out


def test_mixing_targets_and_taken(spark):
    rng = random.Random(2)
    rows = []
    for k, (source, n) in enumerate([("b", 300), ("a", 8), (None, 40), ("É", 60), ("z", 3)]):
        rows += [(1000 * k + i, "w " * rng.randrange(0, 60), None, source, 0) for i in range(n)]
    rows += [(5000, "x " * 9000, None, "b", 0), (5001, None, None, "b", 0), (7, "same text here", None, "a", 0), (7, "same text here", None, "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = M.mix(df, block_words=8).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes, (1.0, 2.0, 3.0))
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.03 * want[s] + 40
    again = M.mix(df.repartition(7), block_words=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_edges(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    r = M.mix(spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, 0)], DOCS)).collect()
    assert [(x["size"], x["taken"], x["target"]) for x in r] == [(0, 0, 0.0)] * 2
    docs = spark.createDataFrame([(i, "a b c d e f g h", None, f"s{i % 2}", 0) for i in range(400)], DOCS)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["s0"] - 400 / 3) < 25 and abs(n["s1"] - 800 / 3) < 25


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r["g"], r["k"]): r["before"] for r in running_sums(df, ["g"], F.floor(F.col("k") / 100), F.floor(F.col("k") / 10), [F.col("k")], F.col("v"), "before").collect()}
    for g, k, _ in rows:
        assert got[g, k] == sum(v for x, j, v in rows if x == g and j < k)


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.Example.org/es/1", "http://example.org/en/17", "http://xexample.org/en/1", "http://borg/x", "x://m.example.com/fr/1?x=/de/", "ftp://com/de/#a", "http://com?/fr/", "http://a\nb.com/fr/\n#z", "http://x.net://y.org/es/", "http://É.com/de/"]
    urls += [f"http://s{i}.example.{t}/{lang}/{i}?a={i}" for i in range(12) for t in ("com", "org", "net") for lang in ("fr", "de", "en", "es")]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, verdict string, score double")
    got = {r["page_id"]: r for r in U.judge(df, trees=3).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule.text if rule else None), u
        assert got[i]["verdict"] == rule.verdict if rule else got[i]["verdict"] in ("allow", "block")
        assert 0 <= got[i]["score"] <= 1
    judged = [r for r in got.values() if r["rule"]]
    assert sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in judged) / len(judged) > 0.8


def brute_tree_scores(x, y, every, cuts, trees, depth, rate):
    """Scores of the rows ``every`` by trees grown row by row."""
    base = y.mean()
    margin, out = np.full(len(y), np.log(base / (1 - base))), np.full(len(every), np.log(base / (1 - base)))
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        add, add_out = np.zeros(len(y)), np.zeros(len(every))

        def grow(at, at_out, level, g=g, h=h, add=add, add_out=add_out):
            total, weight = g[at].sum(), h[at].sum()
            best = (1e-6, None)
            for j, own in enumerate(cuts) if level < depth else ():
                for cut in own:
                    left = at & (x[:, j] <= cut)
                    a, b = g[left].sum(), h[left].sum()
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, cut))
            if best[1] is None:
                add[at], add_out[at_out] = rate * total / (weight + 1), rate * total / (weight + 1)
                return
            j, cut = best[1]
            grow(at & (x[:, j] <= cut), at_out & (every[:, j] <= cut), level + 1)
            grow(at & (x[:, j] > cut), at_out & (every[:, j] > cut), level + 1)

        grow(np.ones(len(y), bool), np.ones(len(every), bool), 0)
        margin, out = margin + add, out + add_out
    return 1 / (1 + np.exp(-out))


def test_url_trees_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.example.org", "news.com", "x-y.shop.com", "plain.net", "deep.sub.site.io"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'p'])}/{'d' * rng.randrange(6)}{rng.randrange(10 ** rng.randrange(1, 7))}" + "".join(f"{'&' if k else '?'}q{k}={k}" for k in range(rng.randrange(4))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1)
    got = {r["page_id"]: (r["rule"], r["score"]) for r in U.judge(df, trees=3, bins=6).collect()}
    model = U.fit(df.select("url"), trees=3, bins=6)
    host, path = U.url_parts(F.col("url"))
    numbers = df.select("page_id", U.matched_rule(host, path, U.RULES)["verdict"].alias("y"), *[c.alias(k) for k, c in model.columns(F.col("url"), host, path).items()])
    labelled = numbers.where("y is not null")
    found = labelled.agg(*[F.percentile(k, F.array(*[F.lit(i / 6) for i in range(1, 6)])).alias(k) for k in model.names]).first()
    rows, mine = numbers.toPandas(), labelled.toPandas()
    want = brute_tree_scores(mine[model.names].to_numpy(float), (mine["y"] == "block").to_numpy(float), rows[model.names].to_numpy(float), [sorted(set(found[k])) for k in model.names], 3, 2, 0.4)
    assert len(set(np.round(want, 6))) > 3
    assert all(got[i][1] == pytest.approx(s, abs=1e-9) for i, s in zip(rows["page_id"], want, strict=True))


def test_the_first_of_equally_long_rules_wins(spark):
    rules = (U.Rule("a.org", "/b", "allow"), U.Rule("b.a.org", "", "block"), U.Rule("a.org", "/c", "block"), U.Rule("a.org", "/c", "allow"))
    df = spark.createDataFrame([("http://a.org/c/x",)], "url string")
    assert df.select(U.matched_rule(*U.url_parts(F.col("url")), rules).alias("m")).first()["m"]["verdict"] == "block"


def test_url_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None), (2, None)], "page_id long, url string")
    assert {(r["verdict"], r["score"]) for r in U.judge(df).collect()} == {("allow", None)}
    assert U.judge(df.where("page_id = 9")).count() == 0


def brute_links(rows, threshold=0.98):
    ids, n = [r[0] for r in rows], [0] * len(rows)
    p = list(range(len(rows)))

    def unit(v):
        a = np.array([np.nan if x is None else x for x in v], float) if v is not None else None
        return None if a is None or not len(a) or not np.isfinite(a).all() or not a.any() else a / np.linalg.norm(a)

    vs = [unit(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = i, j
                while p[a] != a:
                    a = p[a]
                while p[b] != b:
                    b = p[b]
                p[a] = b
    root = []
    for i in range(len(rows)):
        while p[i] != p[p[i]]:
            p[i] = p[p[i]]
        root.append(p[i])
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: (n[i], least[root[i]]) for i in range(len(rows))}


def test_embedding_recall_and_edges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # windows and groups that cross batches
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (1, 2, 3):
        for _ in range(60):
            c = rng.standard_normal(16)
            for _ in range(int(rng.choice([1, 1, 1, 3, 25]))):
                rows.append((k, [float(x) for x in (c + 0.02 * rng.standard_normal(16)).astype(np.float32)], label))
                k += 1
    rows += [(k + i, rows[0][1], 1) for i in range(30)] + [(k + 50, rows[0][1], None), (k + 51, None, 1), (k + 52, [0.0] * 16, 1), (k + 53, [float("nan")] * 16, 1), (k + 54, [float("inf")] + [0.0] * 15, 1), (k + 55, [None] + [1.0] * 15, 1), (k + 56, [], 1), (k + 57, [1.0, 2.0], 1), (k + 58, [1e-30] * 16, 2), (k + 59, [1e30] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    got = {r["vec_id"]: r for r in V.embedding_dedup(df, rounds=1).collect()}
    assert len(got) == len(rows)
    found, true = sum(min(got[i]["n_links"], n) for i, (n, _) in want.items()), sum(n for n, _ in want.values())
    assert found / true >= 0.95 and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    same = sum(got[i]["component_id"] == c for i, (_, c) in want.items())
    assert same / len(want) > 0.95
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert V.embedding_dedup(df.where("vec_id = -1")).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_embedding_links_between_dense_groups(spark):
    rng = np.random.default_rng(4)
    turn, rows = np.arccos(0.984), []
    for g in range(2):
        c = np.zeros(64)
        c[0], c[1] = np.cos(g * turn), np.sin(g * turn)
        for _ in range(60):
            noise = rng.standard_normal(64)
            noise[:2] = 0
            rows.append((len(rows), [float(x) for x in c + 0.03 * noise / np.linalg.norm(noise)], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_links(rows)
    assert len({c for _, c in want.values()}) == 1 and all(n == 119 for n, _ in want.values())
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.embedding_dedup(df).collect()}
    assert got == want


def test_embedding_widens_and_ends_exactly_under_target(spark):
    rng = np.random.default_rng(6)
    rows, side = [], np.sqrt(1 - 0.982**2)
    for i in range(300):
        a, b = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 64)))
        b = b - (a @ b) * a
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.982 * a + side * b / np.linalg.norm(b)).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.embedding_dedup(df, orders=1, reach=1, k=2, rounds=1, most_rounds=2, target_recall=1.1).collect()}
    assert got == {i: (1, i - i % 2) for i in range(600)}


def test_embedding_audit_shows_lost_small_groups(spark):
    vs = [[1.0, 0.0, 0.001 * i] for i in range(64)] + [[0.0, 1.0, 0.0], [0.0, 1.0, 0.1]]
    nodes = V._unit(V.valid_nodes(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label"))
    roots = spark.createDataFrame([(i, 0 if i < 64 else i) for i in range(66)], "node long, root long")
    assert V.audit_recall(nodes, roots, 0.98, 256) == 0.0
    assert V.audit_recall(nodes, roots.selectExpr("node", "if(node < 64, 0L, 64L) as root"), 0.98, 256) == 1.0


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_round_trip(spark, zipped):
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(i, f"http://a/{i}", "x" * (i % 7) + inner, 1) for i in range(60)] + [(300, None, None, 1), (301, "a\r\nb", "", 1), (302, "http://é/", "é\r\n\r\n" * 3, 1), (303, "u", "q" * 700_000, 1), (304, "u", "twice", 1), (304, "u", "twice", 1), (305, "http://a/" + "u" * 700_000, "long address", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = W.archive_and_read(df, compress=zipped).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    first = {}
    for i, b in html.items():
        first[b] = max(first.get(b, i), i)
    for r in got:
        b = html[r["page_id"]]
        lead = first[b] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if lead else ("revisit", first[b]))
    assert W.archive_and_read(df.where("page_id = -1")).count() == 0


def test_warc_small_payloads_are_responses_and_chunks_meet(spark):
    df = spark.createDataFrame([(i, "u", "ab" if i % 2 else "long enough " * 40) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "test")
    for zipped in (True, False):
        files = scratch.save(W.write_warc(df, f"{scratch.root}/w{zipped}", scratch, zipped, min_bytes=10))
        got = W.read_warc(files, scratch, chunk=100).collect()
        assert len(got) == 40 and all(r["agrees"] for r in got)
        assert sorted(r["page_id"] for r in got if r["record_type"] == "response") == [*range(1, 38, 2), 38, 39]


def test_warc_reads_few_bytes_twice_in_as_many_tasks_as_ranges(spark, tmp_path):
    rng = random.Random(9)
    for zipped in (True, False):
        path = tmp_path / ("a.warc" + ".gz" * zipped)
        data = b""
        for i in range(3000):
            one = W.record(i, f"http://a/{i}", rng.randbytes(rng.randrange(50, 900)), "X")
            z = W.zlib.compressobj(6, W.zlib.DEFLATED, 31)
            data += z.compress(one) + z.flush() if zipped else one
        path.write_bytes(data)
        held = []

        class Counted(W._Window):
            def close(self):
                held.append(self.bytes_read)
                super().close()

        got = [c for lo in range(0, len(data), 1 << 20) for c in W.candidates_in(str(path.as_uri()), len(data), lo, min(lo + (1 << 20), len(data)), Counted)]
        assert len(got) >= 3000 and sum(held) < 2 * len(data)
        files = spark.createDataFrame([(path.as_uri(), len(data), 3000)], "path string, size long, records long")
        with pytest.raises(RuntimeError, match="whole"):  # the digests of these are no digests
            W.read_warc(files, Scratch(spark, "test"), chunk=1 << 18)


def test_warc_torn_archive_raises(spark):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    for zipped in (True, False):
        files = scratch.save(W.write_warc(df, f"{scratch.root}/t{zipped}", scratch, zipped))
        assert W.read_warc(files, scratch).count() == 30
        r = files.first()
        path = r["path"].removeprefix("file://")
        with open(path, "rb") as f:
            data = f.read()
        with open(path, "wb") as f:
            at = len(data) - 6 if zipped else data.index(b"page 17 ")  # in the check sum of the last member, or in a payload
            f.write(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(RuntimeError, match="whole"):
            W.read_warc(files, scratch)


def test_golden_points_past_the_ring(spark):
    slots = [0, 1, 65_535, 65_536, 3_474_701_532, 3_474_701_533, (1 << 32) - 1, 1 << 32, (1 << 32) + 7, 10**12 + 12_345]
    df = spark.createDataFrame([(k,) for k in slots], "k long")
    got = {r["k"]: r["u"] for r in df.select("k", M.golden_point(F.col("k")).alias("u")).collect()}
    assert got == {k: k * M.GOLDEN % (1 << 32) for k in slots}


def brute_mix(rows, block):
    """Words taken of (id, source, size, at): the schedule slot by slot, blocks laid out in the order of ``at``."""
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = filled(sizes, (1.0, 2.0, 3.0))
    order = sorted((s for s in sizes if sizes[s]), key=lambda s: (s is None, (s or "").encode()))
    need = {s: target[s] * -(-sizes[s] // block) / sizes[s] for s in order}
    total, edges, at = sum(need.values()), [], 0.0
    for s in order:
        at += need[s]
        edges.append((round(at / total * 2**32), s))
    times, seen = {}, dict.fromkeys(order, 0)
    for k in range(round(total)):
        u = k * M.GOLDEN % 2**32
        s = next(s for hi, s in edges if u < hi)
        rank, seen[s] = seen[s], seen[s] + 1
        blocks = -(-sizes[s] // block)
        if rank < 3 * blocks:
            times[s, rank % blocks] = times.get((s, rank % blocks), 0) + 1
    out, start = {}, dict.fromkeys(sizes, 0)
    for i, s, n, _ in sorted(rows, key=lambda r: (r[3] % 2**64, r[0])):
        lo, start[s] = start[s], start[s] + n
        out[i] = sum((min(lo + n, (b + 1) * block) - max(lo, b * block)) * times.get((s, b), 0) for b in range(lo // block, (lo + n - 1) // block + 1)) if n else 0
    return out, target, sizes


def test_mix_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "tiny"]) if i else "tiny", " ".join("w" * rng.randrange(0, 90))) for i in range(300)] + [(900, "one", "x y z"), (901, "none", " "), (902, "b", None)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], DOCS)
    got = {r["doc_id"]: r for r in M.mix(df, block_words=16).collect()}
    want, target, sizes = brute_mix([(i, s, len((t or "").split()), got[i]["at"]) for i, s, t in rows], 16)
    assert {i: r["taken"] for i, r in got.items()} == want
    for s in sizes:
        taken = sum(r["taken"] for r in got.values() if r["source"] == s)
        assert abs(taken - target[s]) <= 3 * 16 and taken <= 3 * sizes[s]


def test_mix_stage_with_clashing_names_and_repeats(spark):
    schema = "doc_id long, text string, source string, _times int, _nth int, _at2 string, t string, d string, at long"
    df = spark.createDataFrame([(1, "a b c", "s", 1, 2, "mine", "t", "d", 5)] * 2 + [(None, "x y", None, 1, 2, "mine", "t", "d", 5), (3, None, "s", 1, 2, "mine", "t", "d", 5)], schema)
    got = M.mixed_documents(df)
    assert got.columns == df.columns
    rows = list(map(tuple, got.collect()))
    assert rows and set(rows) <= set(map(tuple, df.where("text is not null").collect()))
