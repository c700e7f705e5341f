from pyspark.sql import functions as F

from quillspark.operators import writes


def test_legs(spark):
    long, shell = "word " * 500, '<script id="__NEXT_DATA__"></script>'
    rows = [
        ("thin", "short text", long, None, None, None),
        ("shell", shell, long, None, None, None),
        ("mended", None, long, None, "HTTP 429 too many requests", None),
        ("final", None, long, None, "HTTP 404", None),
        ("none", shell, None, "thin", None, "timeout"),
        ("empty", None, "thin", None, None, None),
    ]
    legs = spark.createDataFrame(rows, "url string, primary string, reader string, scrape string, primary_error string, reader_error string")
    docs = legs.select("url", F.lit("old").alias("content"), F.lit("auto").alias("mode"))
    got = {r.url: (r.content, r.cause) for r in writes.choose_leg(docs, legs).collect()}
    assert got == {
        "thin": ("short text", None),
        "shell": (long, None),
        "mended": (long, None),
        "final": ("old", "primary: HTTP 404; reader: not tried; scrape: not tried"),
        "none": ("old", "primary: JS shell; reader: timeout; scrape: thin"),
        "empty": ("old", "primary: empty; reader: thin; scrape: empty"),
    }
    plain = legs.drop("primary_error", "reader_error")
    assert {r.url: r.content for r in writes.choose_leg(docs, plain).collect()}["shell"] == long
