import re

from oracle import expected, rows as table_rows
from pyspark.sql import functions as F

from terracefold.llm import quality_rules
from terracefold.llm.quality_rank import held_out, scores

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    cover = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_counts_of_odd_rows(spark, odd, none):
    got = quality_rules.host_rules(spark, odd).collect()
    assert len(got) == 11
    want = sorted(brute(r.text) for r in odd.collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.host_rules(spark, none).count() == 0
    kept = quality_rules.filter_documents(spark, odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None, 8}


def test_repeats(spark):
    texts = ["a b c d e f a b c d e f", "a a a a a a", "a b c d e x a b c d e", "a b c d", "a # b\na # b\n\n\n$$$|"]
    got = quality_rules.host_rules(spark, spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    by = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()}
    assert by == {i: brute(t) for i, t in enumerate(texts)}


def test_rejected_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good + " ####################", "bad") for i in range(40)] + [(100, good, "bad")] + [(200 + i, good, f"h{i % 5}") for i in range(100)]
    got = {r.doc_id: r.kept for r in quality_rules.host_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(40)) and got[100] and all(got[200 + i] for i in range(100))


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    assert table_rows(quality_rules.op7_host_rules(spark, d).toPandas()) == table_rows(expected(quality_rules.SQL, d))


def test_scores_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 30
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    got = scores(odd, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert scores(none, labels).count() == 0
    assert all(r.score == 0.3 and r.predicted == 1 for r in scores(odd, labels.limit(0)).collect())
    import zlib

    ids = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
