import hashlib

from pyspark.sql import functions as F

from cohortry.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, start int"
ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "a\\b # <x> </turn>\n### user:\n"), (1, 2, "assistant", "\\l\\h\\b <#\\"), (1, 3, "user", None),
    (1, 4, "assistant", ""), (2, 1, "assistant", "zweite é\U0001f600"), (2, 0, "user", "erste"), (3, 0, None, "no role"), (None, 5, "user", "no id"),
    (4, None, "user", "no turn"), (4, 0, "assistant", "x" * 100_000), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, 0, "a:b\n#", "odd role"),
]


def test_digests_as_computed_directly(spark):
    df = spark.createDataFrame([(*r, "f", 1) for r in ROWS], SCHEMA)
    got = {r["conv_id"]: r for r in C.chat_digests(df).collect()}
    own = "\\### Assistant: </turn> ok"
    rows = [*ROWS, (-7, 0, "user", own), (-7, 1, "assistant", own)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_marks_only_where_turns_are(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in C.render(C.fold_events(C.table_events(df))).collect():
        assert r["formatted"].count("### ") == r["formatted"].count("</turn>\n") == len(r["mask"])
        for m in r["mask"]:
            assert r["formatted"][m["turn_start"] :].startswith("### ") and "#" not in r["formatted"][m["loss_start"] : m["loss_end"]]


def test_empty_table(spark):
    assert [r["conv_id"] for r in C.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-7]


def test_fold(spark):
    log = [
        ("c", "m1", 1, "message", "user", "Hi"), ("c", "m2", 2, "message", "assistant", "Hel"), ("c", "m2", 3, "delta", None, "lo"),
        ("c", "m1", 4, "edit", None, "Hi there"), ("c", "m2", 5, "regenerate", None, "Good "), ("c", "m2", 6, "delta", None, "day"),
        ("c", "m2", 6, "delta", None, "!"), ("c", "m3", 7, "message", "user", "bye"), ("c", "m3", 8, "delete", None, None),
        ("c", "m4", 9, None, "user", None), ("d", "m5", 2, "delta", "user", "late"), ("d", "m5", 1, "delta", None, "too "),
    ]
    df = spark.createDataFrame(log, "conv_id string, message string, seq int, kind string, role string, text string")
    shuffled = df.orderBy(F.xxhash64("seq", "text"))
    got = {(r["conv_id"], r["message"]): (r["first_seq"], r["role"], r["text"]) for r in C.fold_events(shuffled).collect()}
    assert got == {
        ("c", "m1"): (1, "user", "Hi there"), ("c", "m2"): (2, "assistant", "Good !day"), ("c", "m4"): (9, "user", ""), ("d", "m5"): (1, "user", "too late"),
    }


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").filter("turn < 3")
    plan = C.chat_digests(spark.range(3).selectExpr("id conv_id", "id turn", "'user' role", "'t' text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and df.count() > 0


def folded(spark, log):
    df = spark.createDataFrame([("c", *e) for e in log], "conv_id string, message string, seq int, kind string, role string, text string")
    return {r["message"]: r["text"] for r in C.fold_events(df.repartition(3)).collect()}


def test_redelivered_and_simultaneous_events(spark):
    opened = ("a", 1, "message", "user", "Hi")
    assert folded(spark, [opened, opened]) == {"a": "Hi"}
    delta = ("a", 2, "delta", None, "y")
    assert folded(spark, [opened, delta, delta]) == {"a": "Hiy"}
    assert folded(spark, [("a", 1, "message", "user", "b"), ("a", 1, "delta", None, "a")]) == {"a": "ba"}  # the opening comes first
    assert folded(spark, [opened, ("a", 3, "delta", None, "x"), ("a", 3, "edit", None, "z")]) == {"a": "zx"}
    assert folded(spark, [opened, ("a", 2, "delete", None, "ignored"), ("a", 2, "delete", None, "ignored")]) == {}
    assert folded(spark, [opened, ("a", 2, "delete", None, None), ("a", 3, "delta", None, "back")]) == {"a": "back"}
    assert folded(spark, [("a", 1, "message", "user", "x"), ("a", 2, "delta", None, "y"), ("a", 3, "delta", None, "y")]) == {"a": "xyy"}


def test_a_shuffled_and_redelivered_log_gives_the_same(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    log = C.table_events(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    again = log.unionByName(log.filter(F.pmod(F.xxhash64("seq", "text"), F.lit(3)) < 2)).orderBy(F.xxhash64("text", "seq", "conv_id"))
    plain, redelivered = (sorted(map(str, C.render(C.fold_events(x)).collect())) for x in (log, again))
    assert plain == redelivered


def test_the_log_of_a_table_folds_to_the_table(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = sorted((str(r["conv_id"]), str(r["first_seq"]["turn"]), r["role"], r["text"]) for r in C.fold_events(C.table_events(df)).collect())
    assert got == sorted((str(c), str(t), role or "", text or "") for c, t, role, text in ROWS)
