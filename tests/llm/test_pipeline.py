import hashlib

import corpus_pipeline
from test_lines import windows  # noqa: F401
from test_near_duplicates import brute
from test_host_rules import brute as counts

from terracefold.llm import bpe

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    one = stage[names[0]](spark, docs, D)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def passes(t):
        w, _, _, _, rep = counts(t)
        return w >= 10 and 100 * rep <= 20 * w

    assert {r.doc_id for r in one.collect()} == {i for i, t in texts.items() if passes(t)}  # no host is rejected here
    two = stage[names[1]](spark, one, D)
    two_rows = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == docs.columns
    three = stage[names[2]](spark, two, D)
    want = brute(sorted(two_rows.items()))
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in want.items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    four = stage[names[3]](spark, three, D)
    three_rows = {r.doc_id: r.text for r in three.collect()}
    left = {r.doc_id for r in four.collect()}
    assert not any(any(i in t for i in items) for k, t in three_rows.items() if k in left)
    assert all(any(i in t for i in items) for k, t in three_rows.items() if k not in left)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert got.keys() == left
    coder = bpe.Coder.of(*bpe.public_vocabulary())
    for r in four.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert got[r.doc_id].n_tokens == len(coder.encode([r.text or ""])[0]) // 4


def test_odd_documents(spark, odd):
    docs = odd.withColumnRenamed("n_words", "n_chars").select("doc_id", "text", "lang", "source")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, D)
    assert docs.count() == 5 - 1
