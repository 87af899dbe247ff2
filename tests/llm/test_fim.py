import hashlib
import re

import pytest

from cohortry.llm import fim as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "two words", "a b c d", "é \U0001f600\U0001f600 x\r\n", "$1 \\2 {a} <P", "<P>x", "x<S>y z", "<M>",
    "< <P <<S M> P>", "line\nline\nline two\n", "\x0b\x0c\x1c\x85 odd", "word " * 3000, "x" * 50_000, " " * 50_000, "tab\tab " * 20_000,
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "s") for r in rows], "doc_id long, text string, n int, form string, source string")


def by_hand(id_, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (len(units), "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        return (len(units), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (len(units), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_as_by_hand(spark):
    rows = [(i * 100 + j, t) for i, t in enumerate(TEXTS) for j in range(12)] + [(None, "no id here"), (None, None), (7, "twice"), (7, "twice")]
    got = M.fim_digests(frame(spark, rows)).collect()
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    made = sorted((tuple(r) for r in got), key=str)
    assert made == sorted(((i, *by_hand(i, t)) for i, t in rows), key=str)


def test_round_trip_and_outputs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 5)]
    df = M.fill_in_middle(frame(spark, rows), rate=100, spm_share=50)
    got = df.select("*", M.restore(df["output"], df["form"]).alias("back")).collect()
    for r in got:
        assert r["back"] == r["source"] == (rows[r["doc_id"]][1] or "")
        if r["form"] != "plain":
            assert re.fullmatch(r"(?s)<[PS]>.*<[PS]>.*<M>.*", r["output"])
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_a_text_of_millions_of_units(spark):
    df = spark.sql("SELECT id AS doc_id, repeat('ab \U0001f600\\t', 1000000) AS text FROM range(8)")
    got = M.fim_digests(df).collect()
    assert {r["n"] for r in got} == {2_000_001} and {r["form"] for r in got} > {"plain"}
    assert len({r["restored_sha256"] for r in got}) == 1


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id string, text string"])
def test_empty_table(spark, columns):
    assert M.fim_digests(spark.createDataFrame([], columns)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = M.fim_digests(spark.range(3).selectExpr("id doc_id", "'t' text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))
