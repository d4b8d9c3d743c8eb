import hashlib
import random

import pytest

from spindle.llm import substring
from tests.conftest import SMALL, duck, same_rows


def brute(rows, length):
    """Rows with different ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def found(df, length):
    return {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), bytes(r["kept"])) for r in substring.dedup(df, "doc_id", "text", length).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    """Few different words, so that windows repeat within and across texts in many ways."""
    rng = random.Random(seed)
    base = [rng.choice("abcdef" if seed % 2 else "ab") for _ in range(300)]
    rows = [(None, " ".join(base[:60])), (90, None), (91, "")]
    for i in range(25):
        a, b = sorted(rng.randrange(300) for _ in range(2))
        words = base[a:b] + [rng.choice("abxyz") for _ in range(rng.randrange(30))] + base[b : b + rng.randrange(60)]
        if words:
            words[rng.randrange(len(words))] = "new"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    length = 20 if seed < 2 else 9
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), length) == brute(rows, length)


def test_sql(spark):
    from spindle.llm.substring import OP2_SQL, op2_substring_dedup

    same_rows(op2_substring_dedup(spark, SMALL), duck(SMALL, OP2_SQL))


def test_awkward_rows(spark, awkward):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in awkward], "doc_id long, text string, place string, th int")
    got = substring.dedup(df, "doc_id", "text").collect()
    assert len(got) == len(awkward)
    one = next(r for r in got if r["doc_id"] == 8)
    assert one["n_words"] == 9000 * 7 and not one["removed"]
    # A text that repeats itself keeps its first window; equal rows are at one place and do not repeat each other.
    assert [len(r["kept"].split()) for r in got if r["doc_id"] == 6] == [20 + 27 % 20 - 4, 20 + 27 % 20 - 4] or [(r["n_words"], r["removed"][0]["start"]) for r in got if r["doc_id"] == 6] == [(27, 3)] * 2
    assert hashlib.sha256(next(r for r in got if r["doc_id"] == 2)["kept"]).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
