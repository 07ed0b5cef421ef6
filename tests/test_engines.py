"""Recognition adapters with engines of the test's own."""

from quiresmith.sources import engines


def test_batches_fall_back_to_pages(spark):
    # defined here, so that workers get them by value
    class Batching:
        def recognize(self, content, page):
            if content == b"bad":
                raise ValueError("no page")
            return [{"line_idx": 0, "text": content.decode(), "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "line_conf": 0.5}], []

        def recognize_batch(self, contents, pages):
            assert len(contents) == len(pages) <= 2
            got = [self.recognize(c, p) for c, p in zip(contents, pages, strict=True)]
            for lines, _ in got:
                lines[0]["text"] += "!"
            return got

    class Single:
        recognize = Batching.recognize

    pages = spark.createDataFrame([("a", 1, b"one"), ("a", 2, b"two"), ("a", 3, b"bad"), ("a", 4, b"four"), ("b", 1, b"five")], "book string, page long, content binary").coalesce(1)
    got = {(r.book, r.page): (r.lines[0].text if r.lines else None, r.error) for r in engines.recognize(pages, Batching).collect()}
    assert got == {("a", 1): ("one!", None), ("a", 2): ("two!", None), ("a", 3): (None, "ValueError: no page"), ("a", 4): ("four", None), ("b", 1): ("five", None)}
    alone = {r.page: r.error for r in engines.recognize(pages, Single, 1).where("book = 'a'").collect()}
    assert alone == {1: None, 2: None, 3: "ValueError: no page", 4: None}
    assert engines.recognize(pages.limit(0), Single).count() == 0


def test_html_blocks_in_reading_order(spark):
    row = lambda order, html, skipped=False, error=False, conf=0.9: (1, order, html, skipped, error, 0.0, 0.0, 1.0, 1.0, conf)
    rows = [
        row(3, "<p>Salt &amp; <b>pepper</b></p><!-- note --><script>x</script>"), row(1, "<h1> Title </h1>", conf=None), row(2, "<p>gone</p>", skipped=True),
        row(0, "<p>broken</p>", error=True), row(4, "<p> </p>"), row(5, None), row(6, "a < b", skipped=None), row(7, "&amp;lt;"),
    ]
    blocks = spark.createDataFrame(rows, "page_id long, reading_order int, html string, skipped boolean, error boolean, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = [(r.line_idx, r.text, r.line_conf) for r in engines.lines_of_html(blocks).orderBy("line_idx").collect()]
    assert got == [(0, "Title", 0.0), (1, "Salt &\npepper", 0.9), (2, "a < b", 0.9), (3, "&lt;", 0.9)]
