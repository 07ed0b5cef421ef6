"""Page and line queries made where a page lies: results on odd inputs, and plans that move no lines."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quiresmith.functions import noise, pages
from quiresmith.functions import text as T
from quiresmith.plans import queries as Q

ODD = [
    "", " ", "one", "a b c d e f", " lead and trail ", "tab\there  nbsp x   y\rz \x1c q", "İstanbul ΣΑΣ straße ǅ ① ² x", "Salt 2 1/2 cups and 1⁄2 x 11/2 99/9 • item",
    "<b>bold\tx</b> <i>it</i> <math>\\frac{1}{2} x</math> <math>open </b> • z", "% cup 1% cup Ys cup ¥% '/2 cup Y=} -1 cup 2» cup 4% tsp y. tsp", "| a |  b | HARISSA miso tahini .,; (x) __ 12/31/24 3 1/4 cups", "Head of a Title Words", "some plain prose of it, going on.",
]


def _same(spark, folder, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(Q.ORACLES[name])
    cols = want.columns
    got = [tuple(r) for r in Q.QUERIES[name](spark, folder).select(*cols).collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted(got, key=key), sorted(want.fetchall(), key=key)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents with odd texts, repeated and negative ids and a null text."""
    rows = [(i, t * (1 + i % 3)) for i, t in enumerate(ODD * 8)] + [(3, "again here of the same id-"), (3, "again here of the same id-"), (-5, " ".join(ODD)), (-28, " ".join(ODD * 3)), (500, None), (501, "the " * 300)]
    folder = str(tmp_path_factory.mktemp("odd"))
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows)}), f"{folder}/documents.parquet")
    return folder


def test_garbage_lines_over_repeated_ids_equal_sql(spark, odd):
    """It failed where an id repeats: a map of words met the same word twice."""
    got, want = ([r for r in x if r[2].isascii()] for x in _same(spark, odd, "garbage_lines"))  # SQL's trim knows fewer kinds of white space
    assert got == want and len(got) > 0


def test_rules_in_python_equal_expressions(spark):
    known = {w: 5.0 for w in "the and of it plain prose head title words some going on again here same lead trail bold item cup".split()}
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("known", F.create_map(*(F.lit(x) for kv in known.items() for x in kv)))
    c, k = F.col("t"), F.col("known")
    row = df.select(c, T.clean_line(c).alias("clean"), T.unit_fractions(c).alias("unit"), T.fraction_fixups(c).alias("fix"), noise.trim_margins(c, k).alias("trim"), noise.garbage(c, k).alias("garbage"), noise.mark_headings(F.concat(c, F.lit("\n\nmore of it\n"), c, F.lit("\nfooter")), k).alias("marked")).collect()
    rules = pages.Noise(known)
    for r in row:
        t = r["t"]
        got = (pages.clean_line(t), pages.unit_fractions(t), pages.fraction_fixups(t), rules.trim_margins(t), rules.garbage(t), rules.mark_headings(f"{t}\n\nmore of it\n{t}\nfooter"))
        assert got == (r.clean, r.unit, r.fix, r.trim, r.garbage, r.marked), t


@pytest.mark.parametrize("name", ["clean_pages", "heading_candidates", "garbage_lines"])
def test_lines_meet_no_join(spark, odd, name):
    """Lines were joined with their words and grouped again, which moved every word."""
    plan = Q.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_a_long_list_of_words_is_met_by_joins(spark, odd, monkeypatch):
    from quiresmith.operators import formatting

    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(ODD)], "page_id long, line_idx long, text string")
    lexicon = spark.createDataFrame([("the", 5, 100), ("of", 7, 100), ("plain", 3, 100), ("prose", 2, 100)], "token string, cnt long, total long")
    texts = lines.groupBy("page_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    both = []
    for most in (formatting.FREQUENT, 2):
        monkeypatch.setattr(formatting, "FREQUENT", most)
        both.append((sorted(map(tuple, formatting.garbage_lines(lines, lexicon).collect())), formatting.clean_pages(texts, lexicon).collect()))
    assert both[0] == both[1] and both[0][0]


@pytest.mark.parametrize("name", ["mean_line_confidence", "lines_mode", "whole_line_bold"])
def test_cleaning_runs_once(spark, odd, name):
    """The filter on the cleaned text repeated all of its patterns."""
    plan = Q.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("frac") == 0


def test_listed_words_are_no_words_by_frequency(spark, tmp_path):
    """looks_like_word took words of the cleanup's lists for words; its SQL goes by spelling and frequency alone."""
    texts = [("en", "one common thing, one common thing. " * 50), ("es", "miso total (tahini) harissa! 3x bcdfg")]
    pq.write_table(pa.table({"doc_id": [0, 9], "text": [t for _, t in texts], "lang": [x for x, _ in texts]}), f"{tmp_path}/documents.parquet")
    got, want = _same(spark, str(tmp_path), "looks_like_word")
    assert got == want and ("miso", False) in got and ("common", True) in got


@pytest.mark.parametrize("name", ["words_to_lines", "psm_race", "variant_choice"])
def test_words_stay_where_their_page_lies(spark, odd, name):
    """Every word of four modes was shuffled; now only raw texts are. Repeated ids are one page."""
    got, want = _same(spark, odd, name)
    assert got == want and len(got) > 0
    plan = Q.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


@pytest.mark.parametrize("name", ["raster_level", "raster_column_ink", "raster_column_ranges"])
def test_images_come_a_few_at_a_time(spark, name):
    """Up to 10,000 images were drawn at once."""
    from quiresmith.plans import fixtures as fx

    drawn = list(fx.raster_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64())], ["doc_id"])])))
    assert max(b.num_rows for b in drawn) <= 256 and sum(b.num_rows for b in drawn) == 1000
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan


def test_ranges_of_a_page_equal_those_of_tables(spark):
    import random

    import numpy as np

    from quiresmith.operators import profile

    r = random.Random(3)
    made = [(p, w, 100, [0.0 if r.random() < 0.02 else 200.0 for _ in range(w)]) for p, w in enumerate([300, 600, 1500, 7])]
    made += [(9, 600, 1000, [0.0] * 600), (10, 600, 1000, [0.0 if x < 40 or 100 < x < 130 or 300 < x < 320 or x > 560 else 200.0 for x in range(600)]), (11, 500, 1000, [300.0] * 500)]
    rows = [(p, x, v, w, h) for p, w, h, ink in made for x, v in enumerate(ink)]
    table = profile.column_ranges(profile.boundaries(profile.smooth(spark.createDataFrame(rows, "page_id long, x long, ink double, w long, h long"))))
    got = [(p, k, a, b) for p, w, h, ink in made for k, (a, b) in enumerate(profile.page_ranges(np.array(ink), w, h))]
    assert sorted(map(tuple, table.collect())) == got


@pytest.mark.parametrize("name", ["column_clusters", "banner_sections", "paragraph_joins", "format_mixed", "assemble_markdown"])
def test_pages_are_laid_out_where_they_lie(spark, odd, name):
    """Windows sorted the lines of many pages in a task, and lines were joined with the words they ask about."""
    plan = Q.QUERIES[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Aggregate") == 1


def test_pages_in_memory_equal_tables(spark, monkeypatch):
    """Fewer words than are asked about may be sent: then lines meet them by joins, as before."""
    from quiresmith.operators import formatting

    folder = "/root/testdata/sf0.001"
    for name in ("column_clusters", "banner_sections"):
        got, want = _same(spark, folder, name)
        assert got == want and len(got) > 0
    for name in ("paragraph_joins", "format_mixed", "assemble_markdown"):
        sent = sorted(map(tuple, Q.QUERIES[name](spark, folder).collect()))
        with monkeypatch.context() as m:
            m.setattr(formatting, "known_words", lambda *_: None)
            assert sorted(map(tuple, Q.QUERIES[name](spark, folder).collect())) == sent


def test_long_joins_take_linear_time():
    """Each hyphen at a break read all of the text before it."""
    import random
    import time

    from quiresmith.functions import folds

    r = random.Random(1)
    lines = [r.choice(["ab-", "cd ef-", " gh", "", "I-", "xyz", "-", "tail ", "Über-", "é"]) for _ in range(500)]
    one = lines[0].strip()
    for x in lines[1:]:
        one = folds.join_two(one, x, {"abgh": 3.0, "cdgh": 1.0})
    assert folds.join_all(lines, {"abgh": 3.0, "cdgh": 1.0}) == one
    many = ["some words of prose and table-", "spoons of it that go on and-"] * 20_000
    began = time.time()
    folds.join_all(many, {})
    assert time.time() - began < 5
