"""Character errors against a plain edit distance over code points."""

from lorekeep.functions.text import normalize_exact
from lorekeep.plans import catalog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_accents_and_tables(spark, sf, tmp_path):
    made = [(1, 0, "user", "Perché no, caffè"), (1, 1, "bot", "perchè no caffè"), (1, 2, "user", "日本語 \U0001f600"), (1, 3, "bot", "日本 \U0001f601"), (2, 0, "user", "")]
    made = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("length(text) < 300")
    made.unionByName(rows.selectExpr("conv_id + 10 AS conv_id", "CAST(turn AS long) AS turn", "role", "text")).write.parquet(f"{tmp_path}/conversations.parquet")
    texts = {}
    for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect():
        texts.setdefault(r.conv_id, []).append((r.turn, r.role, normalize_exact(r.text)))
    want = [(c, x[0], distance(x[2], y[2]), len(x[2])) for c, t in texts.items() for x, y in zip(sorted(t), sorted(t)[1:])]
    got = sorted(map(tuple, catalog.queries()["j3_cer_turns"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and (1, 0, 1, 15) in got and (1, 2, 2, 5) in got
