import random

import duckdb
import pytest
from oracle import rows as table_rows

from terracefold.llm import decontaminate

ITEMS = [
    "Compute 12 34 56 78 90 11 22 33 44 55 66 77 88 99 now",
    "12 km 5 kg",
    "sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 is",
    "What is the capital city of France today?",
    "A shop sells 12 eggs to Maria Stone and 12 eggs to Peter Hill for 3.50 dollars each, and then Maria Stone pays 40 dollars in total",
    "There are 40 people in the first hall and 25 people in the other hall, how many people are there in both halls",
    "one two three",
    "",
    None,
]


def texts(seed):
    r = random.Random(seed)
    filler = lambda: " ".join(r.choice(["we", "asked", "them,", "Here is one:", "later", "7", "km", "Then", "Ann"]) for _ in range(r.randint(0, 30)))
    out = ["", None, "   "]
    for item in [x for x in ITEMS if x]:
        others = [item, item.lower(), item.replace(" ", "\n"), item.replace("12", "15", 1), item.replace("Maria Stone", "Eva Berg"), item.replace("40", "30").replace("25", "30"), item.replace("12", "17"), item[: len(item) // 2]]
        out += [f"{filler()} {x} {filler()}" for x in others]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql(spark, tmp_path, seed):
    docs = spark.createDataFrame(list(enumerate(texts(seed))), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(decontaminate.SQL).df()
    got = decontaminate.op10_decontaminate(spark, str(tmp_path)).toPandas()
    assert table_rows(got) == table_rows(want)
    assert len(got) > 30 and set(got.item_id) == set(range(7))


def test_verbatim_numbers_are_found(spark):
    docs = spark.createDataFrame([(k, f"Before it. {x} And after it.") for k, x in enumerate(ITEMS[:4])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(k, k) for k in range(4)}
