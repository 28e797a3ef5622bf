import json

from pyspark.sql import functions as F

from terracefold.functions import literals, remote


def test_remotes(spark):
    urls = ["git@github.com:a/b.git", "ssh://git@gitlab.org/a/b", "http://u:p@host.x/a.git/", "https://github.com/a/b/", "git://host/a"]
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(remote.normalize_remote(F.col("u")).alias("n")).select("n", remote.provider(F.col("n"))).collect()]
    assert got == [("https://github.com/a/b", "github"), ("https://gitlab.org/a/b", "gitlab"), ("https://host.x/a", None), ("https://github.com/a/b", "github"), ("https://host/a", None)]
    assert tuple(spark.range(1).select(remote.day(F.lit(86_400)), remote.percent(F.lit(0.1234))).first()) == ("1970-01-02", "12.3 %")


def test_literals(spark):
    value = {"kind": "annotation", "id": "j:A", "arguments": [{"name": "v", "value": {"kind": "array", "values": [{"kind": "string", "value": "x"}, {"kind": "type", "id": "j:B"}]}}, {"name": "n", "value": {"kind": "number", "value": "1.5"}}]}
    assert literals.render(value) == '@j:A(v=["x", j:B.class], n=1.5)'
    assert {i for _, i in literals.references(value)} == {"j:A", "j:B"}
    df = spark.createDataFrame([(json.dumps(value),), (None,)], "t string").select(literals.render_json("t").alias("r"), literals.references_json("t").alias("ids"))
    assert [(r.r is None, r.ids and len(r.ids)) for r in df.collect()] == [(False, 2), (True, None)]
    dec = spark.createDataFrame([("1",), ("1.50",), ("-0.5",), ("01",)], "t string").select(literals.is_canonical_decimal(F.col("t")))
    assert [r[0] for r in dec.collect()] == [True, False, True, False]
