"""Linked mails: groups against union-find, and the splits' shares."""

import random
from collections import defaultdict

from pauta.llm.grouped_splits import group_pairs, grouped_splits, label_shares, mailbox, processes, split_check, split_report
from pyspark.sql import functions as F

SCHEMA = "id bigint, sender_email string, body string, label string, group_id bigint"


def test_mailboxes(spark):
    same = ["ana.x1@a.example", " ANA.X1@A.example ", "mailto:ana.x1@a.example", "Ana X <ana.x1@a.example>", '"X, Ana" <Ana.X1@a.EXAMPLE>', "<ana.x1+lista@a.example>", "ana.x1+2026@a.example"]
    rows = [(x,) for x in [*same, "ana.x1@b.example", "", None, "sem arroba"]]
    got = [r["m"] for r in spark.createDataFrame(rows, "e string").select(mailbox(F.col("e")).alias("m")).collect()]
    assert got == ["ana.x1@a.example"] * len(same) + ["ana.x1@b.example", None, None, None]


def test_processes(spark):
    texts = ["Ref.: processo n.º 2024/0000146", "PROC-2024-146.", "(ver P.º 2024/146)", "proc 2024 / 0000146 falta", "Processo 2024.0000146", "processo nº 2024-146", "proc. 2024/146", "pr\u043ecess\u043e n.º 2024/146", "Proc.º 146/2024", "PROCESSO N.º 2024/146"]
    df = spark.createDataFrame([(t,) for t in [*texts, "n.º 11, 2024/94", "", "processo 12/34", None]], "t string").select(processes(F.col("t")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert got == [["2024/146"]] * len(texts) + [[], [], [], None]


def test_groups_against_union_find(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        box = None if rng.random() < 0.1 else f"p{rng.randrange(120) if rng.random() > 0.3 else 0}@a.example"
        body = f"Ref.: processo n.º 2024/{rng.randrange(90)}" if rng.random() < 0.4 else None
        rows.append((i, box, body, rng.choice(["a", "b", "c", None]), 7))
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = defaultdict(list)
    for i, box, body, *_ in rows:
        if box:
            keys[box].append(i)
        if body:
            keys[body].append(i)
    for v in keys.values():
        for x in v[1:]:
            a, b = sorted((find(x), find(v[0])))
            up[b] = a
    groups = defaultdict(list)
    for i in range(400):
        groups[find(i)].append(i)
    want = {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    df = spark.createDataFrame([*rows, *rows[:30]], SCHEMA)
    assert {tuple(r) for r in group_pairs(df).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    out = grouped_splits(df, targets).collect()
    assert len(out) == 400 and all(r["split"] for r in out)
    by = defaultdict(set)
    for r in out:
        by[r["group_id"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    assert group_pairs(df.limit(0)).collect() == []


def test_shares_are_met(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("u"), (F.col("id") % 1700).cast("string"), F.lit("@a.example")).alias("sender_email"), F.lit("x").alias("body"), F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("label"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    assigned = grouped_splits(df, targets)
    r = {x["split"]: x["share"] for x in split_report(assigned, targets).collect()}
    assert abs(r["train"] - 0.8) < 0.01 and abs(r["validation"] - 0.1) < 0.01 and abs(r["test"] - 0.1) < 0.01
    for x in label_shares(assigned, df, targets).collect():
        assert abs(x["share"] - x["wanted"]) < 0.03
    assert [tuple(x) for x in split_check(assigned, targets).collect()] == [(5000, 0, True)]


def test_large_groups_and_rare_labels(spark):
    """One sender with a third of all mails, a rare label in small groups, more labels than have needs of their own."""
    rows = [(i, "hot@a.example" if i % 3 == 0 else f"u{i % 1500}@a.example", None, "rare" if i % 400 == 1 else f"l{i % 97}", 0) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    assigned = grouped_splits(df, targets)
    assert [tuple(x) for x in split_check(assigned, targets).collect()] == [(9000, 0, True)]
    r = {x["split"]: x["share"] for x in split_report(assigned, targets).collect()}
    assert abs(r["train"] - 0.8) < 0.02 and abs(r["test"] - 0.1) < 0.02
    assert grouped_splits(df.limit(0), targets).collect() == []
    assert {x["split"] for x in grouped_splits(df, targets.limit(0)).collect()} == {None}
