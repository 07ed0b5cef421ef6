"""Goldens of the order-dependent rules, and Spark text expressions against them."""

import pytest

from quiresmith.functions import folds, noise
from quiresmith.functions import text as T

KNOWN = {"tablespoons": 3.0, "medium-low": 2.5, "oz": 4.2, "add": 5.5, "to": 7.0, "the": 7.5, "pan": 4.4, "day": 6.0, "or": 7.0, "chicken": 4.5, "soup": 4.2, "with": 7.0, "rice": 4.4}


def test_joins_of_wrapped_words():
    assert folds.join_two("table-", "spoons of salt", KNOWN) == "tablespoons of salt"
    assert folds.join_two("medium-", "low heat", KNOWN) == "medium-low heat"
    assert folds.join_two("zz-", "qq", {}) == "zz-qq"
    assert folds.join_two("one-", "Two", {}) == "one- Two"
    assert folds.join_two("left ", "  ", {}) == "left"
    assert folds.join_all(["a-", "b-", "c"], {"abc": 3.0, "ab": 3.0}) == "abc"
    assert {"abc", "ab-c", "bc"} <= folds.asked(["a-", "b-", "c"])


def test_paragraphs_break_after_long_sentences_only():
    assert folds.paragraphs(["This is a rather long line.", "Next one", "goes on. Short.", "Then"], {}) == "This is a rather long line.\n\nNext one goes on. Short. Then"
    assert folds.paragraphs([], {}) == ""


def test_blocks():
    assert folds.block(["**Title here**"], {}) == "### Title here"
    assert folds.block(["only"], {}) == "only"
    assert folds.block(["Mix:", "1 cup flour", "and sifted", "Salt", "Then bake it until it is done."], {}) == "Mix:\n\n- 1 cup flour and sifted\n- Salt\n\nThen bake it until it is done."
    assert folds.block(["Bake it for", "12 minutes. Add the salt", "and stir."], {}) == "Bake it for 12 minutes. Add the salt and stir."
    assert folds.block(["- tip one", "goes on", "**H**", "1 cup a", "2 cups b"], {}) == "- tip one goes on\n\n### H\n\n- 1 cup a\n- 2 cups b"
    assert folds.simple_list(["You need:", "1 cup flour", "and salt", "Then you bake it all for an hour in the oven.", "Done"], {}) == "You need:\n\n- 1 cup flour and salt\n\nThen you bake it all for an hour in the oven.\n\nDone"


def noise_of(spark, f, *texts, known=KNOWN):
    """What f makes of each text."""
    rows = spark.createDataFrame([(t, known) for t in texts], "t string, known map<string,double>")
    return [r.o for r in rows.select(f(rows.t, rows.known).alias("o")).collect()]


def test_margins_and_garbage(spark):
    assert noise_of(spark, noise.trim_margins, "| Add to the pan:", "day or |", "-- . Add to", "", " x  y ") == ["Add to the pan:", "day or", "Add to", "", ""]
    lines = ("Ho HE", "a uA", "BEANE NRA RENE NERA", "EEE HEHE", "½ cup", "Notes", "1 tsp", "*** --- ***", "HE")
    assert all(noise_of(spark, noise.garbage, *lines))
    assert not any(noise_of(spark, noise.garbage, "4 oz", "", "  ", "add the chicken to the pan"))
    assert noise_of(spark, noise.garbage, "4 oz", "word here", known=None) == [True, True]


def test_headings(spark):
    mark = lambda t: noise_of(spark, noise.mark_headings, t)[0]
    assert mark("\nChicken Soup\n\nadd the rice to the pan") == "## Chicken Soup\n\nadd the rice to the pan"
    assert mark("text here\n\nChicken Soup").endswith("Chicken Soup")
    assert "##" not in mark("\nCHICKEN SOUP\n\nadd the rice to it")
    assert mark("") == "" and mark("\n \n") == ""


@pytest.mark.parametrize(
    ("line", "clean"),
    [
        ("11⁄2 cups", "1½ cups"),
        ("23⁄4 cups", "2¾ cups"),
        ("1 1/2 cups", "1½ cups"),
        ("11/25", "1½5"),
        ("12/31/24", "1⅔1/24"),
        ("92/71/2", "92/71/2"),
        ("13⁄46⁄7 and 1⁄2, 3⁄7", "1¾6⁄7 and ½, 3⁄7"),
        (r"a <math>\frac{1}{2}</math> b", "a ½ b"),
        (r"<math>\frac{7}{13} \alpha x</math>", "7/13 x"),
        ("<b>Bold</b> <i>it</i> <u>u</u>", "**Bold** *it* u"),
        ("•  tip\t here ", "- tip here"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_line(spark, line, clean):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(T.clean_line(df.t)).first()[0] == clean


def test_expressions_agree_with_folds(spark):
    from pyspark.sql import functions as F

    rows = ["1 cup flour", "½ cup", "1/2 cup", "1.5 kg", "½ - ¾ cup", "Salt", "Salted", "x½", "(aside)", "lower", "A full sentence here.", "Short", "", " ", "12 minutes. Add", "3-½ x", "30 ML NASAL", "5 gx", "5 g", "Eggs and more"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select("t", T.quantity_start(F.col("t")), T.seasoning_item(F.col("t")), T.continuation(F.col("t")), T.looks_like_prose(F.col("t")), T.data_label(F.col("t"))).collect()
    for t, a, b, c, p, q in got:
        assert a == folds.is_amount(t), t
        assert (a or b) == folds.is_item(t), t
        assert c == folds.runs_on(t), t
        assert p == folds.prose_like(t), t
        assert q == bool(folds.DATA.match(t)), t


def test_fixups_keep_their_known_quirks(spark):
    from pyspark.sql import functions as F

    cases = {"50% of": "50½ of", "1 1/2 cups": "1 ½ cups", "Ys cup": "¼ cup", "¥% x": "½ x", "\n\n% cup": "½ cup", "1/4 cupboard": "¼ cupboard", "2% milk": "2½ milk", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", T.fraction_fixups(F.col("t")).alias("o")).collect():
        assert r.o == cases[r.t], r.t
