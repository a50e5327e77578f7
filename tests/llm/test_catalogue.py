import hashlib
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import catalogue
from panelweave.llm.scratch import Scratch
from panelweave.llm.simhash import Scheme
from tests.llm.test_dedup import brute_similar
from tests.llm.test_tables import brute_mix
from tests.llm.test_text import brute_language

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF), c.sql(catalogue.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.select(", ".join(cols)).fetchall())


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalogue.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in catalogue.queries()


def test_pipeline_against_brute_force(spark):
    """Every stage and the end result, on the whole small table and on rows without a language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "123 !!", "en", "src1", 6), (90_003, "½ ²", "en", "src1", 3)], docs.schema)
    scratch = Scratch(spark, "test")
    docs = scratch.save(docs.union(extra))
    before, stages = docs.columns, {}
    rows = {r["doc_id"]: r for r in docs.collect()}
    ats = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text")).collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF))
        assert name == "bpe" or docs.columns == before
        stages[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in stages[name])

    told = brute_language([(r["doc_id"], r["text"], r["lang"]) for r in rows.values()])
    assert all(abs(score - 0.5) > 1e-6 for _, score in told)
    kept = [i for i, (_, score) in zip(rows, told, strict=True) if score > 0.5]
    assert ids("language_id") == sorted(kept)

    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    last = {}
    for i in sorted(kept):
        last[rows[i]["text"].translate(upper)] = i
    assert ids("exact_dedup") == sorted(last.values())

    of = sorted(last.values())
    scheme = Scheme.similar(0.8)
    label = brute_similar([rows[i]["text"] for i in of], scheme.total, scheme.bits)
    first = sorted({min(i for i, x in zip(of, label, strict=True) if x == y) for y in set(label)})
    assert ids("simhash_dedup") == first

    sizes = {i: len(rows[i]["text"].encode().split()) for i in first}
    taken, _, _ = brute_mix([(i, rows[i]["source"], sizes[i], ats[i]) for i in first], 64)
    times = {i: int(Decimal(taken[i] / sizes[i]).quantize(0, ROUND_HALF_UP)) for i in first if sizes[i]}
    assert ids("mixing") == sorted(i for i, n in times.items() for _ in range(n))

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    for r in stages["bpe"]:
        coded = library.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(coded), hashlib.sha256(" ".join(map(str, coded)).encode()).hexdigest())
    assert ids("bpe") == ids("mixing")


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").save(stage(spark, docs, SF))
    assert docs.count() == 0
