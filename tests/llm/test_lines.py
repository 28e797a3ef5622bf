import random

from oracle import expected, rows as table_rows

from terracefold.llm import line_dedup


def windows(words_of, min_words):
    """Each run of lines with min_words words: the shortest from each start."""
    for i in range(len(words_of)):
        n = 0
        for j in range(i, len(words_of)):
            n += len(words_of[j])
            if n >= min_words:
                yield tuple(tuple(w) for w in words_of[i : j + 1])
                break


def test_no_window_stays_twice(spark):
    r = random.Random(5)
    lines = [" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(r.randint(1, 30))) for _ in range(60)]
    runs = [r.sample(lines, r.randint(2, 6)) for _ in range(8)]
    docs = []
    for i in range(40):
        t = []
        for _ in range(r.randint(1, 4)):
            t += r.choice(runs) if r.random() < 0.6 else [f"own {i} {r.random()} " + " ".join(r.choice(lines).split())]
            t += [""] * (r.random() < 0.2)
        docs.append((i, "\n".join(t)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    gone = {r.did: set(r.gone) for r in line_dedup.repeated_lines(frame, 20).collect()}
    seqs = {i: [(k, tuple(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    seen = set()
    for i, seq in seqs.items():
        for k, w in enumerate(windows([x for _, x in seq], 20)):
            if w in seen:  # a window that occurs earlier goes as a whole
                assert {p for p, _ in seq[k : k + len(w)]} <= gone.get(i, set())
            seen.add(w)
    allowed = {}  # lines of runs with 20 words that occur earlier, by any alignment
    for i, seq in seqs.items():
        for j, src in seqs.items():
            for shift in range(-len(src), len(seq)):
                if j > i or j == i and shift <= 0:
                    continue
                run = []
                for k in range(len(seq) + 1):
                    if k < len(seq) and 0 <= k - shift < len(src) and src[k - shift][1] == seq[k][1]:
                        run.append(k)
                        continue
                    if sum(len(seq[x][1]) for x in run) >= 20:
                        allowed.setdefault(i, set()).update(seq[x][0] for x in run)
                    run = []
    assert gone and all(g <= allowed.get(i, set()) for i, g in gone.items())


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    assert table_rows(line_dedup.op4_line_dedup(spark, d).toPandas()) == table_rows(expected(line_dedup.SQL, d))


def test_odd_rows(spark, odd, none):
    out, n = line_dedup.dedup_lines(odd, 5)
    got = {(r.doc_id, r.text): r[n] for r in out.collect()}
    assert out.columns[:-1] == odd.columns and len(out.collect()) == 11
    assert got[(None, "")] == 1 and got[(4, None)] == 0 and got[(3, "")] == 0 and got[(6, "one two")] == 0
    assert line_dedup.dedup_stage(spark, none).count() == 0
    stage = line_dedup.dedup_stage(spark, odd)
    assert stage.columns == odd.columns and stage.count() == 11


def test_repeats_inside_one_document(spark):
    text = "\n".join(["a b c d e f g"] * 40 + ["tail"])
    out, n = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), 14)
    row = out.first()
    assert row.text.split("\n")[-1] == "tail" and row[n] >= 38
