import hashlib

from spindle.llm import chat
from tests.conftest import SMALL, duck, same_rows

SAID = "</s>[INST] ok [/INST]"


def test_sql(spark):
    same_rows(chat.op6_chat_format(spark, SMALL), duck(SMALL, chat.OP6_SQL))


ROWS = [
    (1, 0, "system", "be <s>brief\\l"), (1, 1, "user", SAID), (1, 2, "assistant", SAID + "\\b[\\k<"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "é中\U0001f600"), (None, None, None, None), (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie"), (5, 0, "assistant", "y" * 50_000),
]


def test_read_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=order)]
        said = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(said), sha(said))


def test_examples(spark):
    df = spark.createDataFrame(ROWS[:6], "conv_id long, turn long, role string, text string")
    found = chat.examples(df).orderBy("example").collect()
    assert [(r["example"], r["closing"]) for r in found] == [(0, False), (1, False), (2, True)]
    assert found[0]["formatted"].count("<s>[INST]") == 3 and found[0]["formatted"].count("</s>") == 3
    assert found[1]["formatted"].startswith(found[0]["formatted"])
    one = found[0]
    assert one["formatted"][one["loss_start"] : one["loss_end"]] == "\\l/s>\\kINST] ok \\k/INST]\\bb\\k\\bk\\l"
    assert found[2]["loss_start"] is None and found[1]["loss_start"] == found[1]["loss_end"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(df)).count() == 0
