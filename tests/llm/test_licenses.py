import os
import textwrap

import duckdb
import pytest

from cohortry.llm import licenses as L

MIT = dict((n, t) for n, t in L.KNOWN if n == "MIT" and t.startswith("Permission"))["MIT"]
ROWS = [
    (1, "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace("\n", " \r\n")), (2, "© 2019, 2021 X\nAll rights reserved.\n" + MIT.replace("sublicense", "sub-license")),
    (3, MIT + "\nand one more condition"), (4, "Some text.\nReleased under the MIT Licence\nmore text\nRELEASED under the MIT license!!"), (5, "Released under the MIT License."),
    (6, None), (7, ""), (8, " \n?!\n"), (9, "prose only " * 20_000), (None, "a\nLicensed under CC BY-NC 4.0"), (10, "x\nlicensed under cc-by-nc 4.0"), (10, "x\nlicensed under cc-by-nc 4.0"),
    (11, "copyright 2020 me"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, license int, digest int")


def test_hits(spark):
    got = sorted(((r["doc_id"] or -1, r["license"], r["scope"], r["hits"]) for r in L.license_hits(frame(spark)).collect()))
    assert got == sorted(
        [
            (1, "MIT", "text", 1), (2, "MIT", "text", 1), (4, "MIT", "line", 2), (5, "MIT", "text", 1), (-1, "CC-BY-NC-4.0", "line", 1), (10, "CC-BY-NC-4.0", "line", 2),
        ]
    )


def test_known_digests_tell_licences_apart(spark):
    rows = L.known_digests(spark).collect()
    assert len({r["digest"] for r in rows}) == len(rows) and {r["license"] for r in rows} == {n for n, _ in [*L.KNOWN, *L.KNOWN_DIGESTS]}


def test_empty_table(spark):
    assert L.license_hits(frame(spark, [])).count() == 0


TEXTS = {n: max((t for m, t in L.KNOWN if m == n), key=len) for n in ("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "GPL-3.0", "MPL-2.0")}
HEADS = ["", "Copyright (c) 2020 Somebody\n", "Copyright 2019-2021 A, B and others. All rights reserved.\n\n", "(c) 2011 X\n", "Copyright: 2020 Y\nAll rights reserved.\n", "Copyright (C) The Z Authors\n"]


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n") for line in textwrap.wrap(part, width, break_on_hyphens=False))


def usual_forms(text):
    for width in (60, 72, 79, 100):
        yield wrapped(text, width)
        yield wrapped(text, width, "// ")
        yield wrapped(text, width, "# ")
        yield "/*\n" + wrapped(text, width, " * ") + "\n */"
    yield " ".join(text.split())
    yield text.upper()


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_usual_wrappings(spark, name):
    texts = [head + form for form in usual_forms(TEXTS[name]) for head in HEADS]
    texts += [("Copyright (c) 2020 Somebody. " if i else "Copyright 2020, Some Body. All rights reserved. ") + " ".join(TEXTS[name].split()) for i in (0, 1) if not TEXTS[name].startswith(("BSD", "Boost", "MIT N", "zlib", "ISC L", "The MIT", "Zero", "BSD Z", "MIT L"))]
    got = {(r["doc_id"], r["license"]) for r in L.license_hits(frame(spark, list(enumerate(texts)))).filter("scope = 'text'").collect()}
    assert got == {(i, name) for i in range(len(texts))}


def test_notice_on_the_line_of_the_licence(spark):
    rows = [(1, "Copyright 2020 X. " + MIT), (2, "MIT License Copyright (c) 2020 X " + " ".join(MIT.split())), (3, "x\n(c) 2020 X. Released under the MIT License.\ny")]
    assert {(r["doc_id"], r["scope"]) for r in L.license_hits(frame(spark, rows)).collect()} == {(1, "text"), (2, "text"), (3, "line")}


@pytest.mark.parametrize("marks", [("1.", "2.", "3."), ("*", "*", "*"), ("-", "-", "-"), ("(1)", "(2)", "(3)"), ("a)", "b)", "c)"), ("•", "•", "•")])
def test_list_marks(spark, marks):
    for name in ("BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        text = TEXTS[name]
        for i, mark in enumerate(marks, 1):
            text = text.replace(f"\n{i}. ", f"\n  {mark} ")
        rows = [(1, text), (2, " ".join(text.split()))]
        assert {(r["doc_id"], r["license"]) for r in L.license_hits(frame(spark, rows)).collect() if r["scope"] == "text"} == {(1, name), (2, name)}


def test_versions_are_not_list_marks(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 2."), (2, "This work is licensed under the GNU General Public License, version 3.")]
    assert [(r["doc_id"], r["license"]) for r in L.license_hits(frame(spark, rows)).collect()] == [(2, "GPL-3.0")]


PUBLISHED = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not all(os.path.exists(f"{FOLDER}/{f}") for f in PUBLISHED.values()), reason="needs the licence texts")
def test_long_texts_by_digest(spark):
    texts = {n: open(f"{FOLDER}/{f}").read() for n, f in PUBLISHED.items()}
    rows, want = [], set()
    for n, t in texts.items():
        for form in (t, t.lower().replace("\n", "\r\n"), "\n".join("# " + line for line in t.split("\n"))):
            want.add((len(rows), n))
            rows.append((len(rows), form))
        rows.append((len(rows), t[: len(t) // 2]))
    got = {(r["doc_id"], r["license"]) for r in L.license_hits(frame(spark, rows)).filter("scope = 'text'").collect()}
    assert got == want


def test_sql_agrees_on_the_odd_forms(spark):
    rows = [*ROWS, *[(100 + i, h + f) for i, (h, f) in enumerate((h, f) for n in ("ISC", "BSD-2-Clause") for f in list(usual_forms(TEXTS[n]))[::3] for h in HEADS)]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    key = lambda r: str(r)
    want = sorted(con.execute(L.SQL).fetchall(), key=key)
    got = sorted(((r["doc_id"], r["license"], r["scope"], r["hits"]) for r in L.license_hits(frame(spark, rows)).collect()), key=key)
    assert got == want
