import hashlib
import random
from zlib import crc32

from oracle import expected, rows
from pyspark.sql import functions as F

from terracefold.llm import prefix_trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Trie rows of {conv: [(role, text)]}, node by node."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(paths[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def query(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return prefix_trie.op12_prefix_trie(spark, str(tmp_path))


def sample(seed, convs=150):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", "c😀 c", ""])) for c in range(-3, convs) for t in range(r.choice([1, 1, 2, 3, 7, 9]))]


def test_query_against_sql(spark):
    assert rows(prefix_trie.op12_prefix_trie(spark, SF).toPandas()) == rows(expected(prefix_trie.SQL, SF))


def test_against_brute_force(spark, tmp_path):
    found = sample(4)
    frame = spark.createDataFrame(found, "conv_id long, turn long, role string, text string").repartition(7)
    got = sorted((tuple(r) for r in query(spark, frame, tmp_path).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rebuilt(found))


def test_blocks_of_turns_and_ids(spark, tmp_path, monkeypatch):
    """A conversation over many blocks and ranges, a node where many end."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    found = [(7, t, "user", f"turn {t}") for t in range(300)] + [(107, t, "user", f"turn {t}") for t in range(200)]
    found += [(c, 0, "user", "hello") for c in range(200, 300)]
    frame = spark.createDataFrame(found, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted((tuple(r) for r in query(spark, frame, tmp_path).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rebuilt(found))


def test_odd_rows(spark, tmp_path):
    found = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "x"), (2, 3, "user", None), (None, 0, "user", "x"), (100, 0, None, "é" * 50_000), (101, 1, "user", "y")]
    frame = spark.createDataFrame(found, "conv_id long, turn long, role string, text string")
    frame = frame.select("*", F.lit(1).alias("conv"), F.lit(2).alias("place"), F.lit("z").alias("x1"), F.lit(0).alias("depth"))
    got = sorted((tuple(r) for r in query(spark, frame, tmp_path / "a").select(*COLUMNS).collect()), key=repr)
    assert got == brute(rebuilt(found))
    assert query(spark, frame.limit(0), tmp_path / "b").collect() == []


def test_owners_are_marked_before_the_shuffle(spark):
    """The window's group limit keeps a row per prefix and task, so a hot prefix does not travel whole."""
    occurrences = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0, 5)], "conv long, turns long, depth long, x1 long, x2 long, p1 long, p2 long, rest long")
    from pyspark.sql import Window

    marked = occurrences.withColumn("rank", F.row_number().over(Window.partitionBy(*prefix_trie.NODE).orderBy("conv"))).filter("rank = 1")
    assert "WindowGroupLimit" in marked._jdf.queryExecution().executedPlan().toString()
