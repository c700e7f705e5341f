import hashlib
import html
import uuid
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.functions.vocabulary import canonicalize_topics, vocabulary
from quillspark.plans.queries import limited, period_bounds


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Ex.Com/Path/A?q=1#f", "https://ex.com/Path/A"),
        ("https://ex.com", "https://ex.com"),
        ("https://ex.com/a b/é?x", "https://ex.com/a b/é"),
        ("/only/path?x=1", "/only/path"),
    ],
)
def test_canonicalize_url(spark, raw, want):
    assert one(spark, fn.canonicalize_url(F.col("u")), u=raw) == want


def test_text(spark):
    assert one(spark, fn.normalize_text(F.col("u")), u="  a \n b ") == "a b"
    assert one(spark, fn.strip_html(F.col("u")), u="<p>a &amp; b</p>c") == html.unescape("a &amp; b c")
    assert one(spark, fn.content_hash(F.col("a"), F.col("b")), a=" t ", b="x\n y") == hashlib.sha256(b"t\nx y").hexdigest()
    assert one(spark, fn.source_uuid(F.col("u")), u="Some Source") == str(uuid.uuid5(uuid.NAMESPACE_DNS, fn.SOURCE_KEY_PREFIX + "Some Source"))
    assert one(spark, fn.is_paywalled(F.col("u")), u="... Subscribe to READ ...") is True
    assert one(spark, fn.normalize_language(F.col("u")), u="pt-BR") == "pt"
    assert one(spark, fn.normalize_language(F.col("u")), u="klingon") == "en"
    assert one(spark, fn.canonical_post_url(F.col("u")), u="HTTPS://WWW.x.com/reel/AbC?y=1") == "https://www.x.com/p/AbC/"
    assert one(spark, fn.post_title(F.col("c"), F.col("h"), F.col("s")), c="\n  \nfirst  line\nnext", h="h", s="s") == "first line"
    assert one(spark, fn.post_title(F.col("c"), F.col("h"), F.col("s")), c="  ", h="h", s="s") == "@h — s"


@pytest.mark.parametrize("raw", ["caf&eacute; &#8217;x&#x2019; &amp;eacute; &nbsp;&hellip;", "no entity & here; &unknown; &#; &", "&lt;b&gt;&quot;&#39;&apos;", "&#128512;&#x1F600;", ""])
def test_unescape(spark, raw):
    assert one(spark, fn.unescape(F.col("u")), u=raw) == html.unescape(raw)


def test_as_utc(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),)], "t timestamp_ntz")
    assert [r[0] for r in d.select(fn.as_utc(F.col("t"))).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]


def test_snippet(spark):
    body = "x" * 200 + "NEEDLE" + "y" * 200
    assert one(spark, fn.snippet(F.col("c"), F.col("t"), "needle"), c=body, t="t") == "…" + "x" * 120 + "NEEDLE" + "y" * 120 + "…"
    assert one(spark, fn.snippet(F.col("c"), F.col("t"), "zz"), c=body, t="t") == body[:240] + "…"
    assert one(spark, fn.snippet(F.col("c"), F.col("t"), "tit"), c="", t="a title") == "a title"


@pytest.mark.parametrize(("flag", "capped", "score", "want"), [(None, False, 0.9, 0.9), ("thin", False, 0.9, 0.3), (None, True, 0.9, 0.3), ("thin", True, 0.1, 0.1), ("thin", False, None, None)])
def test_effective_score(spark, flag, capped, score, want):
    df = spark.createDataFrame([(flag, capped, score)], "f string, c boolean, s double")
    assert df.select(fn.effective_score(F.col("s"), F.col("f"), F.col("c"))).first()[0] == want


def test_vocabulary(spark):
    v = vocabulary(spark)
    assert v.count() == 42
    assert v.filter("retired_alias_of is null").groupBy("kind").count().orderBy("kind").collect() == [("content-type", 10), ("pillar", 18), ("region", 12)]
    tags = spark.createDataFrame([("Gen_Z",), (" consumer  TRENDS ",), ("GenAI",), ("unheard",), ("Q&A",)], "tag string")
    assert [r.slug for r in canonicalize_topics(tags, "tag").orderBy("tag").collect()] == ["consumer-behavior", "ai", "gen-z", "interview", None]


def test_period():
    assert period_bounds(date(2024, 1, 8), date(2024, 1, 9)) == (datetime(2024, 1, 8, 5), datetime(2024, 1, 10, 5))
    assert period_bounds(datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 9))[0] == datetime(2024, 1, 8)
    with pytest.raises(ValueError, match="period"):
        period_bounds(date(2024, 1, 9), date(2024, 1, 1))
    for bad in (0, 101, True, "5"):
        with pytest.raises(ValueError, match="limit"):
            limited(bad)
