import uuid

from pyspark.sql import functions as F

from folivane.functions import text as T
from folivane.settings import POINT_NAMESPACE, Settings, or_default


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_tokens_and_words(spark):
    assert one(spark, T.tokens(F.col("t")), t="A bc_1 déjà-vu X9 b") == ["bc_1", "vu", "x9"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert one(spark, T.split_words(F.col("t")), t="  a b c d\x1ce ") == ["a", "b", "c", "d", "e"]


def test_point_id_is_uuid5(spark):
    for v in ("a", "doc:p1:t0", "größe", ""):
        assert one(spark, T.point_id(F.col("t")), t=v) == str(uuid.uuid5(uuid.UUID(POINT_NAMESPACE), v))


def test_slug_dot_retry_url(spark):
    assert one(spark, T.slug(F.col("t")), t="  My File (v2).x ") == "my-file-v2-x"
    assert one(spark, T.clean_dot(F.col("t")), t="```dot\ndigraph {a->b}\n```") == "digraph {a->b}"
    assert one(spark, T.looks_like_dot(F.col("t")), t="digraph {a{}") is False
    assert one(spark, T.looks_like_dot(F.col("t")), t=None) is False
    assert one(spark, T.looks_like_dot(F.col("t")), t="graph {}") is False
    assert one(spark, T.retry_seconds(F.col("t"), 7), t="please RETRY in 34.5 s") == 36.5
    assert one(spark, T.retry_seconds(F.col("t"), 7), t="retry in 500s") == 120
    assert one(spark, T.retry_seconds(F.col("t"), 7), t=None) == 7
    assert one(spark, T.artifact_url(F.col("t"), "/data/art"), t="/data/art/d\\p.png") == "/artifacts/d/p.png"
    assert one(spark, T.artifact_url(F.col("t"), "/data/art"), t="/etc/x") is None
    assert one(spark, T.artifact_url(F.col("t"), "/data/art"), t="/data/art/../x") is None


def test_embedding_and_figure_text(spark):
    assert one(spark, T.embedding_text(F.col("h"), F.col("t")), h=" A ", t="b") == "A\nb"
    assert one(spark, T.embedding_text(F.col("h"), F.col("t")), h=None, t="b") == "b"
    assert one(spark, T.figure_text(F.col("a"), F.col("b"), F.col("c")), a="", b="d", c="e") == "d\nText shown in the figure: e"
    assert one(spark, T.wants_drawing(F.col("t")), t="Please SKETCH it") is True
    assert one(spark, T.wants_drawing(F.col("t")), t="the paragraph") is False


def test_defaults(monkeypatch):
    assert or_default(0, 3) == or_default(None, 3) == 3 and or_default(2, 3) == 2
    monkeypatch.setenv("FOLIVANE_TOP_TEXT", "4")
    assert Settings.from_env().top_text == 4
