"""Page extraction, topics, lexicon scoring."""
from pyspark.sql import functions as F

from quill.operators import features as FE
from quill.operators import sentiment as T
from quill.sources import pages as PG

PAGE = """<html lang="es"><head><meta name="title" content="Meta title">
<meta property="article:tag" content="a"><meta property="article:tag" content="b">
<meta property="article:tag" content="c"></head><body>
<h1 class="article-main__title"> First &amp; best </h1><h1 class="article-main__title">Second</h1>
<h2 class="article-main__description">Sub</h2>
<div class="article-author__name"><a href="/x"> Ana Pérez </a></div>
<div class="article-dates__detail"><time datetime="2024-01-05T10:00:00Z">5 Jan</time></div>
<div id="intext" class="article-main__content"><p> One. </p><p>Two</p></div><p>outside</p>
<div class="article__summary">Summary text</div></body></html>"""


def test_extract_articles(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", "<html><body>x</body></html>"), (3, "w", None)],
                                  "page_id long, url string, html string")
    r = {x.page_id: x for x in PG.extract_articles(pages).collect()}
    a = r[1]
    assert (a.Title, a.Subtitle, a.Author, str(a.Date), a.Content) == (
        "First & best", "Sub", "Ana Pérez", "2024-01-05", "One.\nTwo")
    assert r[2].Title is None and r[2].Content == ""
    assert r[3].Title is None and r[3].Content is None


def test_extract_meta(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", "<html></html>")], "page_id long, url string, html string")
    r = {x.page_id: x for x in PG.extract(pages, PG.BACKFILL_FIELDS).collect()}
    assert (r[1].Title, r[1].Subtitle, r[1].Tags) == ("Meta title", "Summary text", "a,b,c")
    assert r[2].Tags == "" and r[2].Title is None


def test_assign_topic_article_order(spark):
    df = spark.createDataFrame([(1, "a,RAE,b"), (2, "Ucrania,Fútbol"), (3, "")], "id int, tags string")
    out = FE.assign_topic(df, "tags", ["Fútbol", "Lengua", "Ucrania"], {"RAE": "Lengua"})
    got = {r.id: r.Topics for r in out.collect()}
    assert got == {1: "Lengua", 2: "Ucrania", 3: None}


def test_emotion_counts_repeats_and_nulls(spark):
    lex = spark.createDataFrame([("bad", "anger"), ("bad", "negative"), ("joy", "joy")], "word string, emotion string")
    df = spark.createDataFrame([(1, "Bad bad JOY zzz", "joy"), (2, None, "bad"), (3, "nothing", None)],
                               "id int, title string, content string")
    one = {r.id: r for r in T.emotion_counts(df, "id", "title", lex, "_title").collect()}
    assert (one[1].anger_title, one[1].negative_title, one[1].joy_title) == (2, 2, 1)
    assert one[2].anger_title == 0 and one[3].joy_title == 0
    both = {r.id: r for r in T.score_all(df, "id", ["title", "content"], lex).collect()}
    assert both[1].anger_title == 2 and both[1].joy_content == 1 and both[2].anger_content == 1


def test_split_sentences(spark):
    df = spark.createDataFrame([("Uno. Dos!  Tres? cuatro",)], "t string")
    assert df.select(T.split_sentences(F.col("t"))).first()[0] == ["Uno.", "Dos!", "Tres?", "cuatro"]


def test_salted_lexicon_path_matches_broadcast(spark, monkeypatch):
    import quill.operators.sentiment as S
    lex = spark.createDataFrame([("bad", "anger"), ("bad", "negative"), ("joy", "joy")], "word string, emotion string")
    df = spark.createDataFrame([(1, "Bad bad JOY zzz"), (2, None)], "id int, t string")
    fast = sorted(map(tuple, S.emotion_counts(df, "id", "t", lex).collect()))
    monkeypatch.setattr(S, "sized_broadcast", lambda d, max_bytes=0: d)  # force the salted shuffle join
    slow = sorted(map(tuple, S.emotion_counts(df, "id", "t", lex).collect()))
    assert fast == slow


def test_salted_join_spreads_hot_key(spark):
    from pyspark.sql import functions as F

    from quill.operators.joins import salted_join
    big = spark.range(0, 3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    out = salted_join(big, small, ["k"], buckets=8)
    assert out.count() == 3000 and out.where("k = 1 and v = 'b'").count() == 1000


def test_bad_selectors_raise_before_any_page(spark):
    import pytest
    with pytest.raises(ValueError, match="unsupported selector"):
        PG.Field("text", "h1:first-child")


def test_css_descendants_look_in_every_box(spark):
    page = '<div class="a"><b>x</b></div><div class="a"><p><span>Ana</span></p></div><span>no</span>'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    f = {"steps": PG.Field("text", ".a span"), "css": PG.Field("text", ".a span", css=True), "all": PG.Field("paragraphs", "div b", css=True)}
    r = PG.extract(pages, f).first()
    assert (r.steps, r.css, r["all"]) == (None, "Ana", "x")


def test_pages_from_another_working_directory(tmp_path):
    """Workers find the package although it is neither installed nor in their folder."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\nfrom pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('ROWS', e.queries()['page_titles'](s, '/root/testdata/sf0.001').count())" % root)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
