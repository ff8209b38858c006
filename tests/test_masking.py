import pytest
from pyspark.sql import functions as F

from textloom.operators import masking as M

CITED = [
    ("The study [1] confirms the hypothesis.", 1),
    ("Multiple references [1, 2, 3] support this claim.", 1),
    ("Prior work [1-5] established the baseline.", 1),
    ("As shown by Smith et al. (2023) in their analysis.", 0),
    ("Studies (Jones, 2021) and (Lee & Park, 2022) confirm this.", 2),
    ("The result [Smith & Jones, 2024] is significant.", 1),
    ("Research [1, 2] and (Brown et al., 2023) plus [Jones, 2022] agree.", 3),
    ("See [1] and also [1] and again [1].", 1),
    ("This sentence has no citations at all.", 0),
    ("Models [1, 2] and (Vaswani et al., 2017), by [Jones & Lee, 2022] and Brown (2021). $E=mc^2$ stays [3].", 4),
    ("Notes [iv], [B] and x\u00b2\u2075.", 3),
]
FORMULAS = [
    ("The formula $E = mc^2$ defines energy.", 0, 1),
    ("Defined as:\n$$P(W) = \\sqrt[N]{x}$$\nwhere N is length.", 1, 0),
    ("We compute:\n$$\n\\sigma_L\n$$\nas the variance.", 1, 0),
    ("Given $x > 0$ and $y < 1$, the equation $$z = x/y$$ holds.", 1, 2),
    ("The alignment:\n\\begin{align}\nB &= 1 \\\\\n\\end{align}\nwhere.", 1, 0),
    ("Note that \\(a^2 + b^2\\) is known.", 0, 1),
    ("Euler:\n\\[\ne^{i\\pi} + 1 = 0\n\\]\nremarkable.", 1, 0),
    ("See $x^2$ twice: also $x^2$ is the same.", 0, 1),
    ("No notation, only 5$ and 6$ apart\nby lines $", 0, 1),
    ("Nothing here.", 0, 0),
    ("Display: $$\\int_0 dx = 1$$ one token.", 1, 0),
]


@pytest.mark.parametrize(("text", "n"), CITED)
def test_citation_counts_and_roundtrip(spark, text, n):
    row = M.mask_citations(spark.createDataFrame([(text,)], "text string")).withColumn(
        "back", M.unmask_citations(F.col("masked"), F.col("citation_map"))
    ).first()
    assert len(row.citation_map) == n
    assert row.back["text"] == text and row.back["error"] is None


@pytest.mark.parametrize(("text", "blocks", "inlines"), FORMULAS)
def test_formula_counts_and_roundtrip(spark, text, blocks, inlines):
    row = M.mask_math(spark.createDataFrame([(text,)], "text string")).withColumn(
        "back", M.unmask_math(F.col("masked"), F.col("math_map"))
    ).first()
    kinds = [k.split("_")[3] for k in row.math_map]
    assert (kinds.count("BLOCK"), kinds.count("INLINE")) == (blocks, inlines)
    assert row.back["text"] == text


def test_numbers_follow_the_order_of_patterns(spark):
    row = M.mask_citations(spark.createDataFrame([("[1] then (Lee, 2020) then [1]",)], "text string")).first()
    assert row.masked == "__CITATION_1__ then __CITATION_0__ then __CITATION_1__"


def restore(spark, text, mapping, function):
    df = spark.createDataFrame([(text, mapping)], "t string, m map<string,string>")
    return df.select(function(F.col("t"), F.col("m")).alias("r")).first()["r"]


def test_strict_restore_reports_unknown_tokens(spark):
    for function, name in ((M.unmask_citations, "CITATION"), (M.unmask_math, "MATH_BLOCK")):
        bad = restore(spark, f"a __{name}_99__", {f"__{name}_0__": "x"}, function)
        assert bad["text"] is None and "99" in bad["error"]
        assert restore(spark, f"a __{name}_99__", {}, function)["text"] == f"a __{name}_99__"


def test_general_restore(spark):
    names = {"__CITATION_1__": "[SMITH]", "__CITATION_10__": "[JONES]"}
    good = restore(spark, "Compare __CITATION_1__ and __CITATION_10__.", names, M.restore_tokens)
    assert good["text"] == "Compare [SMITH] and [JONES]."
    bad = restore(spark, "Compare __CITATION_1__ and __CITATION_2__.", names, M.restore_tokens)
    assert bad["text"] is None and "__CITATION_2__" in bad["error"]
    # inline tokens are not part of the check
    assert restore(spark, "__MATH_INLINE_3__", names, M.restore_tokens)["text"] == "__MATH_INLINE_3__"
    assert restore(spark, "x __CITATION_2__ __CITATION_1__", names, M.restore_soft) == "x __CITATION_2__ [SMITH]"


def test_nested_masks_are_flagged_and_exactly_undone(spark):
    text = "\\begin{align} $$a$$ \\end{align} and $b [1]$"
    audited = M.audit_roundtrip(spark.createDataFrame([(text,)], "text string"))
    exact = M.restore_nested(F.col("masked"), F.col("citation_map"), F.col("math_map"))
    row = audited.withColumn("exact", exact).first()
    assert not row.intact and row.exact["text"] == text


def test_later_map_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert df.select(M.merge_maps(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": "1", "b": "3"}


def test_masks_preserved(spark):
    df = spark.createDataFrame(
        [("a __CITATION_0__", "b __CITATION_0__"), ("a __CITATION_0__", "b"), ("a", "b")], "s string, c string"
    )
    assert [r[0] for r in df.select(M.masks_preserved(F.col("s"), F.col("c"))).collect()] == [True, False, True]


def test_filter_on_masked_text_stays_small(spark):
    """A filter pushed below the masking must not multiply the expression."""
    df = M.mask_all(spark.createDataFrame([("x [1] $y$",)], "text string")).filter(F.size("citation_map") > 0)
    assert df.count() == 1
