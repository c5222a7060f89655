"""WARC: pages whose payload repeats, however often, and pages that do not."""

from pyspark.sql import functions as F

from tablewright.llm import warc


def _want(rows):
    first = {}
    for i, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    return sorted(((i, "revisit", first[html]) if first.get(html, i) != i and i is not None else (i, "response", None) for i, html in rows),
                  key=str)


def test_repeated_payloads_among_many_others(spark):
    hot, small, near = "<p>" + "h" * 300, "s" * 99, "n" * 100
    rows = [(i, hot if i % 3 == 0 else small if i % 7 == 0 else f"{i % 400} " * 40) for i in range(2, 2000)]
    rows += [(1, None), (0, near), (5000, near), (5001, near + "x"), (None, hot), (None, "lone" * 50)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string")
    got = warc.warc_query(pages).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == _want(rows)


def test_html_of_lone_pages_does_not_travel(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 200), F.col("id")).alias("html"))
    assert warc.warc_query(pages).where("record_type = 'response'").count() == 500
