import random
import re

import pytest

from terracefold.operators import profiles, spans

SPACE = "file string, space string, parent string, depth int, start int, `end` int, kind string"
ENTITY = "file string, id string, depth int, start int, `end` int, category string, implicit boolean"
KINDS = ["function", "function", "class", "struct", "namespace", "unknown"]


def fits(category, kind):
    if category in spans.COMPATIBLE:
        return kind in spans.COMPATIBLE[category]
    return kind not in spans.NOT_COMPATIBLE[category]


def may_stand(gap):
    depth = 0
    for text in gap:
        text = text.lstrip()
        comment = text.startswith(("//", "/*", "*", "#"))
        if depth == 0 and not (not text or comment or text[0] in "@["):
            return False
        if not comment:
            bare = re.sub(r'"(\\.|[^"\\])*("|\\?$)|' + r"'(\\.|[^'\\])*('|\\?$)", "", text)
            depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
    return depth == 0


def brute(spaces, entities, lines):
    """The three joins of one file, one entity after another."""
    s = {x[1]: dict(zip(["file", "space", "parent", "depth", "start", "end", "kind"], x)) for x in spaces}
    e = {x[1]: dict(zip(["file", "id", "depth", "start", "end", "category", "implicit"], x)) for x in entities}
    owner, how = {}, {}
    for span in {(x["start"], x["end"]) for x in e.values()}:
        ms = sorted((i for i, x in e.items() if (x["start"], x["end"]) == span), key=lambda i: (e[i]["depth"], i))
        cs = sorted((i for i, x in s.items() if (x["start"], x["end"]) == span), key=lambda i: (s[i]["depth"], i))
        if not cs:
            continue
        for category, kinds in spans.NATURAL.items():
            m, c = [i for i in ms if e[i]["category"] == category], [i for i in cs if s[i]["kind"] in kinds]
            if m and len(m) == len(c):
                for a, b in zip(m, c):
                    owner[b], how[a] = a, "exact"
                ms, cs = [i for i in ms if i not in m], [i for i in cs if i not in c]
        if not ms or not cs:
            continue
        if len(ms) >= len(cs) and all(fits(e[a]["category"], s[b]["kind"]) for a, b in zip(ms, cs)):
            for a, b in zip(ms, cs):
                owner[b], how[a] = a, "exact"
        elif len(ms) == 1 and len({s[b]["depth"] for b in cs}) == 1 and all(fits(e[ms[0]]["category"], s[b]["kind"]) for b in cs):
            for b in cs:
                owner[b] = ms[0]
            how[ms[0]] = "contained"
        else:
            for a in ms:
                how[a] = "ambiguous"
    for i in sorted((i for i in e if i not in how), key=lambda i: (e[i]["start"] - e[i]["end"], e[i]["depth"], i)):
        x = e[i]
        near = [(abs(y["start"] - x["start"]), k) for k, y in s.items() if y["end"] == x["end"] and y["start"] != x["start"] and fits(x["category"], y["kind"]) and may_stand(lines[min(x["start"], y["start"]) - 1 : max(x["start"], y["start"]) - 1])]
        if near and min(near)[1] not in owner:
            owner[min(near)[1]], how[i] = i, "leading"
    for i in sorted((i for i in e if i not in how and not e[i]["implicit"]), key=lambda i: (e[i]["end"] - e[i]["start"], -e[i]["depth"], i)):
        x = e[i]
        inside = lambda k: k is not None and x["start"] <= s[k]["start"] and s[k]["end"] <= x["end"]  # noqa: E731, B023
        for k in sorted(s, key=lambda k: s[k]["depth"]):
            if k in owner or not inside(k) or not fits(x["category"], s[k]["kind"]):
                continue
            p, closed = s[k]["parent"], False
            while inside(p) and not closed:
                closed, p = p in owner, s[p]["parent"]
            if not closed:
                owner[k], how[i] = i, "contained"
    return owner, how


def nested(r, file, n):
    """Spaces nested at random in n lines, entities at and around their spans, and lines that are often blank or marked."""
    spaces, entities = [(file, f"{file}.0", None, 0, 1, n, "unit")], [(file, f"{file}-unit", 0, 1, n, "unit", False)]

    def inside(parent, depth, lo, hi):
        at = lo
        while at <= hi and depth < 5 and len(spaces) < 40:
            start = r.randint(at, hi)
            end = r.randint(start, hi)
            name = f"{file}.{len(spaces)}"
            spaces.append((file, name, parent, depth, start, end, r.choice(KINDS)))
            for _ in range(r.choice([0, 1, 1, 2])):
                category = r.choice(["type", "invocable", "invocable", "other"])
                a, b = r.choice([(start, end), (start, end), (max(1, start - r.randint(1, 3)), end), (max(1, start - 2), min(n, end + 2)), (start + 1, end)])
                if a <= b:
                    entities.append((file, f"{file}-e{len(entities)}", depth, a, b, category, r.random() < 0.1))
            if r.random() < 0.6:
                inside(name, depth + 1, start, end)
            at = end + 1 if r.random() < 0.7 else start + (end - start) + 2

    inside(f"{file}.0", 1, 1, n)
    texts = [r.choice(["", "  ", "// note", "@Tag(", "  )", "@Other(\"(\")", "[attr]", "# x", "code();", "* doc {"]) for _ in range(n)]
    return spaces, entities, texts


@pytest.mark.parametrize("seed", range(3))
def test_against_one_entity_after_another(spark, seed):
    r = random.Random(seed)
    spaces, entities, lines, expected = [], [], [], set()
    owners = {}
    for f in range(25):
        s, e, texts = nested(r, f"f{f}", r.randint(5, 90))
        owner, how = brute(s, e, texts)
        owners |= owner
        expected |= {(k, i, how[i]) for k, i in owner.items()} | {(None, i, "ambiguous") for i, h in how.items() if h == "ambiguous"}
        spaces, entities, lines = spaces + s, entities + e, lines + [(f"f{f}", k, t) for k, t in enumerate(texts, 1)]
    frames = spark.createDataFrame(spaces, SPACE), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(lines, "file string, line int, text string")
    joined = spans.spans(*frames)
    got = [(x.space, x.id, x.how) for x in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {h for *_, h in expected} == {"exact", "leading", "contained", "ambiguous"}
    up = {x[1]: x[2] for x in spaces}
    sums = {}
    for k in up:
        at = k
        while at is not None and at not in owners:
            at = up[at]
        if at is not None:
            sums[owners[at]] = sums.get(owners[at], 0) + 1
    measures = frames[0].selectExpr("space", "'n' AS key", "1 AS value")
    assert {x.id: x.value for x in spans.charge(measures, frames[0], joined).collect()} == sums


def test_gaps_of_any_length(spark):
    """Annotations over 200 lines still lead; one line of code does not."""
    for text, expected in (("@A", [("s", "e", "leading")]), ("x;", [])):
        lines = [("f", k, "" if k != 100 else text) for k in range(1, 251)]
        s, e = [("f", "s", None, 0, 221, 250, "function")], [("f", "e", 0, 2, 250, "invocable", True)]
        got = spans.spans(spark.createDataFrame(s, SPACE), spark.createDataFrame(e, ENTITY), spark.createDataFrame(lines, "file string, line int, text string")).collect()
        assert [(x.space, x.id, x.how) for x in got] == expected


def test_profiles(spark):
    assert profiles.profile("cobol") is None and "record" in profiles.profile("java")["kinds"]
    e = spark.createDataFrame([("java", "embedding"), ("java", "import"), ("cobol", "embedding")], "lang string, edge string")
    assert [(r.lang, r.edge, r.n) for r in profiles.unlicensed(e).collect()] == [("java", "embedding", 1)]
    assert profiles.issues({"class": ["TType", "TOdd"]}, ["import", "odd"]) == ["class: unknown trait TOdd", "unknown edge kind odd"]
