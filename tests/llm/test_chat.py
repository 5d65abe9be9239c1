import hashlib
import random

from pyspark.sql import functions as F

from sorrel.llm import chat


def plain(rows):
    """Digests of each conversation, straight from its rows."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def rows():
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", "\\", "$1", "<", "[", "é🙂", "\n", " ok ", "s>", "INST]", "assistant"]
    out = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "user", None), (3, 5, None, ""),
           (4, 0, "assistant", None), (4, 0, "assistant", ""), (4, None, "user", "x"), (None, 1, "[INST]\n", "</s>"), (None, 2, "assistant", "<s>" * 5)]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool<s>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    return out + out[-4:]


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.expand(df)).collect()}
    assert got == plain(data)


def test_examples(spark):
    data = [(1, 0, "system", "S"), (1, 1, "user", "a</s>"), (1, 2, "assistant", "B"), (1, 3, "user", "c"), (1, 4, "assistant", ""), (1, 5, "user", "d"), (2, 0, "user", "u")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["example"]): r for r in chat.expand(df).collect()}
    assert len(got) == 4
    first = "<s>[INST]system[/INST]S</s><s>[INST]user[/INST]a<\\/s></s><s>[INST]assistant[/INST]B</s>"
    assert got[1, 0]["formatted"] == first
    assert first[got[1, 0]["loss_start"] - 1:][:got[1, 0]["loss_length"]] == "B"
    assert got[1, 1]["formatted"] == first + "<s>[INST]user[/INST]c</s><s>[INST]assistant[/INST]</s>" and got[1, 1]["loss_length"] == 0
    assert got[1, 2]["formatted"].startswith(got[1, 1]["formatted"]) and got[1, 2]["loss_length"] == 0
    assert got[2, 0]["formatted"] == "<s>[INST]user[/INST]u</s>"
    assert chat.digests(chat.expand(df.limit(0))).count() == 0


def test_escape_is_reversible_and_hides_every_control(spark):
    texts = [r[3] for r in rows() if r[3]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))
