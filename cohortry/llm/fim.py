"""Fill-in-middle transformation by a counted-quantifier regular expression, with DataFrame functions only.

``regexp_count`` counts a text's units (a word with the white space before it, or the white space at the end). Two cut points
a <= b come from a hash of the document's id, and a pattern of the row's own, ``(unit{a})(unit{b-a})(rest)``, captures prefix,
middle and suffix in one match and puts them in the order of the form. All quantifiers are possessive, which the matcher runs as
plain loops: no recursion and no backtracking, so a text of millions of units costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import free_name

# A unit of text (as the contract words it, and the same language without backtracking), marks, shares in percent.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
POSSESSIVE_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SPM_SHARE = 80
HASH_DIGITS = 8


def draw(id_: Column, seed: int, i: int) -> Column:
    """The i-th 32-bit number of a row: a group of eight digits of the sha256 of seed and id. A null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + HASH_DIGITS * i, HASH_DIGITS), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """``id_col, source, n, form, output``, one row per document: its text, its number of units, and the transformed text.

    ``rate`` percent of the documents are transformed, ``spm_share`` percent of these with the suffix first (``spm``), the others with
    the prefix first (``psm``); the rest is ``plain`` and unchanged, as is every text that is empty or holds one of the marks. A null
    text is empty. The choice depends on id and seed alone, so rows of one id are cut alike wherever they lie, and rows
    without an id share the empty id's draws. Other columns are not read. A document is a single value of a row; no row moves.
    """
    text, id_ = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (draw(id_, seed, 2) % 100 >= rate), "plain")
        .when(draw(id_, seed, 3) % 100 < spm_share, "spm")
        .otherwise("psm")
    )
    own = free_name([id_col], "source")
    counted = docs.select(
        id_.alias(id_col),
        text.alias(own),
        F.regexp_count(text, F.lit(POSSESSIVE_UNIT)).cast("long").alias("n"),
        form.alias("form"),
        draw(id_, seed, 0).alias("_h1"),
        draw(id_, seed, 1).alias("_h2"),
    )
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    cut = counted.select("*", F.least(one, two).alias("_a"), F.abs(one - two).alias("_more"))

    def units(n: str) -> Column:
        return F.concat(F.lit(f"((?:{POSSESSIVE_UNIT}){{"), F.col(n).cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"(?s)\A"), units("_a"), units("_more"), F.lit(r"(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col(own)).otherwise(F.regexp_replace(F.col(own), pattern, order))
    return cut.select(id_col, own, "n", "form", output.alias("output"))


def parts(output: Column, form: Column) -> dict[str, Column]:
    """Prefix, middle and suffix read back from an output; null for a plain one.

    A transformed text held no mark, and no mark can arise where text and mark meet, so the marks found are those put in.
    """
    found = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.when(form != "plain", F.get(found, F.lit(i))) for i in (1, 2, 3))
    spm = form == "spm"
    return {"prefix": F.when(spm, second).otherwise(first), "middle": middle, "suffix": F.when(spm, first).otherwise(second)}


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    p = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fim_digests(docs: DataFrame) -> DataFrame:
    """The transformed documents as digests, lengths and the digest of the text restored from output and form alone."""
    made = fill_in_middle(docs).select("doc_id", "n", "form", "output")
    p = parts(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length(p["prefix"]).cast("long").alias("prefix_chars"),
        F.length(p["middle"]).cast("long").alias("middle_chars"),
        _sha(F.col("output")).alias("output_sha256"),
        _sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


# Written apart from the code: cuts the text into a list of its units and joins slices of the list.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
  coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
