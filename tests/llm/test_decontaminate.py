import random
import re

import pytest

from spindle.llm import decontaminate
from tests.conftest import SMALL, duck, same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for item, body in items:
            b = words(body)
            k = min(len(b), window)
            wanted = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if wanted and tuple(w[j : j + k]) in wanted:
                    hit.update(range(j, j + k))
                    named.add(str(item))
        out.append((i, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(docs, items):
    return sorted((tuple(r) for r in decontaminate.contamination(docs, "doc_id", "text", items, "item_id", "text").select("id", "n_words", "n_hit", "items", "contaminated").collect()), key=repr)


def test_sql(spark):
    same_rows(decontaminate.op8_decontaminate(spark, SMALL), duck(SMALL, decontaminate.OP8_SQL))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, awkward, monkeypatch, limit):
    """Few words, short items, equal items, nulls; with and without broadcasts."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcDÉ") + rng.choice([" ", ", ", "--"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 4, 5, 12, 13, 14, 30, 30])] + [(50, text(20)), (7, None), (8, "..."), (None, "q w e r t y")]
    items += [(51, items[-4][1])]
    docs = [*awkward, *((100 + i, text(rng.randrange(60)) + rng.choice(items[5:11])[1] + text(rng.randrange(60))) for i in range(30)), (200, "q w e r t y")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, words int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int")
    want = [(a, n, h, [x for x in names if x != "None"], c) for a, n, h, names, c in brute(docs, items)]
    assert found(d, b) == sorted(want, key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, item_id long, text string")
    assert found(none, one) == []
    assert found(one, none) == [(1, 3, 0, [], False)]


def test_no_python_in_the_plan(spark):
    plan = decontaminate.op8_decontaminate(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
