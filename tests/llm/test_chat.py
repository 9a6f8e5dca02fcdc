import hashlib

import duckdb
from pyspark.sql import functions as F

from corpusloom.llm import chat
from corpusloom.llm.queries import OP6_SQL, PROBE_TEXT, op6_chat_format
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def read(df):
    return df.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), "loss").collect()


def test_round_trip(spark):
    texts = ["", "a", PROBE_TEXT, "\\", "\\h", "### user: ", "</turn>\n### x: y", "a:b #<>\\l", "\n\n", "жé 🙂", "x" * 20000]
    rows = [(c, t, r, x) for c, shift in enumerate(range(4)) for t, x in enumerate(texts) for r in [("user", "assistant", "assistant", "tool: #1")[(t + shift) % 4]]]
    rows += [(9, 0, None, None), (9, None, "user", "first"), (9, 0, "assistant", "b"), (9, 0, "assistant", "a"), (None, 1, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", formatted int").select("conv_id", "turn", "role", "text", "formatted")
    got = {r["conv_id"]: r for r in read(chat.format_conversations(df))}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss"] == "".join(x for role, x in want if role == "assistant")
        runs = sum(i == 0 or want[i - 1][0] != w[0] for i, w in enumerate(want))
        assert got[c]["formatted"].count("### ") == runs  # adjacent turns of a role are one block
    assert read(chat.format_conversations(spark.createDataFrame([], SCHEMA))) == []


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = op6_chat_format(spark, SF)
    theirs = con.execute(OP6_SQL)
    assert df.columns == [d[0] for d in theirs.description]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(theirs.fetchall())
    probe = next(r for r in rows if r[0] == -7)
    assert probe[1] == 2 and probe[3] == len(PROBE_TEXT) and probe[4] == hashlib.sha256(PROBE_TEXT.encode()).hexdigest()
