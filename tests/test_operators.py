"""Operators over small hand-made pages, and a sample of registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quiresmith.operators import formatting, geometry, layout, profile, selection
from quiresmith.plans import queries as Q
from quiresmith.sources import books
from quiresmith.sources.engines import PipelineConfig

LINE = "page_id long, line_idx long, text string, x0 double, y0 double, x1 double, y1 double, line_conf double"
BLOCK = "page_id long, block_idx long, position long, label string, x0 double, y0 double, x1 double, y1 double"
WHERE = "/root/testdata/sf0.001"


def test_first_block_wins_and_edges_count(spark):
    lines = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, "edge", 22.0, 0.0, 30.0, 10.0, 0.9), (1, 2, "out", 90.0, 0.0, 99.0, 10.0, 0.9), (2, 0, "no blocks", 0.0, 0.0, 1.0, 1.0, 0.5)], LINE)
    blocks = spark.createDataFrame([(1, 0, 1, "Text", 0.0, 0.0, 20.0, 20.0), (1, 1, 0, "Table", 0.0, 0.0, 20.0, 20.0)], BLOCK)
    got = {(r.page_id, r.line_idx): r.block_idx for r in geometry.assign_to_blocks(lines, blocks).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): None, (2, 0): None}


def test_caption_goes_to_the_nearest_figure_and_the_last_wins(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "Picture", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "Caption", 0.0, 10.0, 10.0, 20.0), (1, 2, 2, "Caption", 0.0, 20.0, 10.0, 30.0), (2, 0, 0, "Caption", 0.0, 0.0, 1.0, 1.0)], BLOCK)
    assert [tuple(r) for r in layout.caption_of_figure(blocks).collect()] == [(1, 0, 2)]
    assert {(r.page_id, r.caption_idx): r.figure_idx for r in geometry.nearest_figure(blocks).collect()}[2, 0] is None


def test_page_assembly(spark):
    lines = spark.createDataFrame([(1, 0, "Head", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, "table-", 0.0, 20.0, 10.0, 30.0, 0.9), (1, 2, "spoons", 0.0, 30.0, 10.0, 40.0, 0.9), (1, 3, "lost", 500.0, 0.0, 510.0, 10.0, 0.3), (1, 4, "pic", 0.0, 50.0, 10.0, 60.0, 0.5), (1, 5, "cap", 0.0, 70.0, 10.0, 80.0, 0.5), (1, 6, "page 3", 0.0, 90.0, 10.0, 99.0, 0.5)], LINE)
    blocks = spark.createDataFrame([(1, 0, 0, "SectionHeader", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "Text", 0.0, 20.0, 10.0, 40.0), (1, 2, 2, "Picture", 0.0, 50.0, 10.0, 60.0), (1, 3, 3, "Caption", 0.0, 70.0, 10.0, 80.0), (1, 4, 4, "PageFooter", 0.0, 90.0, 10.0, 99.0)], BLOCK)
    lexicon = spark.createDataFrame([("tablespoons", 5, 1000)], "token string, cnt long, total long")
    r = layout.layout_markdown(lines, blocks, lexicon).first()
    assert r.layout_class == "illustration_bleed"
    assert r.orphan_count == 1 and r.low_confidence and r.dropped_footers == ["page 3"]
    want = ["<!-- BEGIN USER REVIEW NEEDED: low OCR confidence (64.3) -->", "### Head", "tablespoons", "<!-- figure p0001-1 -->\npic\n<!-- /figure -->", "<!-- caption -->\ncap\n<!-- /caption -->", "<!-- BEGIN USER REVIEW NEEDED: orphan OCR lines -->", "lost", "<!-- END USER REVIEW NEEDED -->", "<!-- END USER REVIEW NEEDED -->"]
    assert r.markdown.split("\n\n") == want
    assert r.mode == "surya-layout/illustration_bleed+orphans:1+low_conf"


def test_table_rows_follow_a_running_mean(spark):
    rows = [(1, i, f"c{i}", float(100 - i), float(y), 0.0, float(y), 0.9) for i, y in enumerate([0, 10, 20, 31, 60])]
    got = geometry.table_rows(spark.createDataFrame(rows, LINE), ["page_id"]).first().rows
    assert [[c.text for c in r] for r in got] == [["c1", "c0"], ["c3", "c2"], ["c4"]]


def test_hyphen_runs_fire_every_other_time(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a-", "b-", "c-", "d", "E-", "F"])], "page_id long, line_idx long, text string")
    assert [r.text for r in formatting.unwrap_hyphens(df).orderBy("line_idx").collect()] == ["ab-", "cd", "E-", "F"]


def test_dropped_column_ranges_are_lost(spark):
    ink = spark.range(600).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("x"), F.when((F.col("id") < 40) | F.col("id").between(100, 130) | (F.col("id") > 560), 0.0).otherwise(200.0).alias("ink"), F.lit(600).alias("w"), F.lit(1000).alias("h"))
    got = profile.column_ranges(profile.boundaries(profile.smooth(ink, 5))).collect()
    assert len(got) == 1 and got[0].x_start > 100
    blank = ink.withColumn("ink", F.lit(0.0))
    assert [tuple(r)[2:] for r in profile.column_ranges(profile.boundaries(profile.smooth(blank, 5))).collect()] == [(0, 600)]


def test_columns_are_padded_and_race_in_both_forms(spark):
    ranges = spark.createDataFrame([(1, 0, 30, 500), (1, 1, 520, 990), (2, 0, 100, 2000), (2, 1, 2100, 3960)], "page_id long, ord long, x_start long, x_end long")
    widths = spark.createDataFrame([(1, 1000), (2, 4000)], "page_id long, w long")
    assert sorted(map(tuple, profile.pad_columns(ranges, widths).collect())) == [(1, 0, 0, 540), (1, 1, 480, 1000), (2, 0, 20, 2080), (2, 1, 2020, 4000)]
    rows = [
        (1, 0, 4, False, 70.0, "four"), (1, 0, 6, False, 70.0, "sixx"), (1, 0, 6, True, 70.0, "hard, longer"), (1, 0, 3, True, 99.0, "not tried"),
        (1, 1, 1, False, 60.0, "one"), (1, 1, 4, True, 61.0, "hard"), (1, 1, 6, True, None, "none"), (2, 0, 1, True, 50.0, "alone"),
    ]
    df = spark.createDataFrame(rows, "page_id long, col long, psm int, hard boolean, conf double, text string")
    assert sorted(map(tuple, selection.column_race(df).collect())) == [(1, 0, 70.0, "sixx"), (1, 1, 61.0, "hard"), (2, 0, 50.0, "alone")]


def test_race_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 1, 50.0, "ab"), (1, 3, 50.0, "cd"), (1, 4, 49.0, "longer")], "page_id long, psm long, conf double, text string")
    assert selection.race(df, ["page_id"], "psm").first().psm == 1


def test_checkpoints_skip_what_is_not_json(spark):
    rows = spark.createDataFrame([("b", '{"page": 3, "conf": 1.5}'), ("b", "{broken"), ("b", '{"page": 2}'), ("c", "nope")], "book string, value string")
    total = spark.createDataFrame([("b", 4), ("c", 2)], "book string, page_count long")
    got = books.parse_checkpoints(rows)
    assert {tuple(r) for r in books.last_page(total, got).collect()} == {("b", 3), ("c", 0)}
    assert {tuple(r) for r in books.resume(total, got).collect()} == {("b", 1), ("b", 4), ("c", 1), ("c", 2)}


def test_checkpoints_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a: b", 1, 50.0, "m", 3), ("c", 2, 1.5, "m", 4)], "book string, page int, conf double, mode string, chars int")
    for _ in range(2):
        books.append_checkpoints(rows, str(tmp_path / "cp"))
    (tmp_path / "cp" / "old.jsonl").write_text('{"page": 7, "conf": 2.0}\nbroken\n')
    got = sorted({(r.book, r.page, r.mode) for r in books.read_checkpoints(spark, str(tmp_path / "cp")).collect()})
    assert got == [("a: b", 1, "m"), ("c", 2, "m"), ("old", 7, None)]


def test_books_are_replaced_one_by_one(spark, tmp_path):
    to = str(tmp_path / "out")
    make = lambda *rows: spark.createDataFrame(rows, "book string, markdown string")
    books.write_books(make(("a", "one"), ("b", "two")), to)
    books.write_books(make(("c", "three")), to)
    with pytest.raises(FileExistsError):
        books.write_books(make(("a", "again")), to)
    books.write_books(make(("a", "again")), to, force=True)
    assert {(r.book, r.value) for r in spark.read.text(to).collect()} == {("a", "again"), ("b", "two"), ("c", "three")}
    head = spark.range(1).select(books.header(F.lit("x"), F.lit("x.pdf"), F.lit(3), "surya")).first()[0]
    assert head == "# x\n\n*OCR transcription of `x.pdf` (3 pages). Engine: surya.*\n\n---\n"


def test_streaming_commits_what_has_arrived(spark, tmp_path):
    from quiresmith.streaming.pages import page_stream, run_available

    rows = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book string, page long, text string")
    for k in range(2):
        rows.where(F.col("page") == k + 1).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(page_stream(spark, str(tmp_path / "in"), rows.schema), lambda b: b.withColumn("markdown", F.upper("text")), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1


def test_engines_report_a_failing_page(spark):
    from quiresmith.sources.engines import recognize

    class Fake:
        def recognize(self, content, page):
            if page == 2:
                raise ValueError("bad")
            return [{"line_idx": 0, "text": content.decode(), "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "line_conf": 0.5}], []

    pages = spark.createDataFrame([("b", 1, b"hi"), ("b", 2, b"no")], "book string, page long, content binary")
    got = {r.page: r for r in recognize(pages, Fake).collect()}
    assert got[1].lines[0].text == "hi" and got[2].error == "ValueError: bad"
    with pytest.raises(ValueError):
        PipelineConfig(engine="none")


@pytest.mark.parametrize("name", ["words_to_lines", "psm_race", "line_block_range_join", "nearest_figure", "banner_sections", "block_segments", "table_rows", "column_ranges", "clean_markup", "hyphen_wrap", "looks_like_word", "resume_states"])
def test_query_equals_sql(spark, name):
    for t in ("documents", "conversations", "events", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    want = duckdb.sql(Q.ORACLES[name])
    cols = sorted(want.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    rows = sorted(({c: v for c, v in zip(want.columns, r, strict=True)} for r in want.fetchall()), key=lambda r: key(r[c] for c in cols))
    got = sorted((r.asDict() for r in Q.QUERIES[name](spark, WHERE).collect()), key=lambda r: key(r[c] for c in cols))
    assert len(got) > 0 and got == rows
