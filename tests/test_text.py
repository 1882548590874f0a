from pyspark.sql import functions as F

from chatlake.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_clean_deletes_rather_than_spaces(spark):
    s = "Привет, мир! re-use 42 don't\tёж: İx (File not included. Change data exporting settings to download.)"
    assert _one(spark, T.clean_text("t"), s) == "Привет мир reuse  dontёж: x "
    assert _one(spark, T.clean_text("t", keep_colon=False), "a:b c") == "ab c"


def test_tokenize_lowercase_two_letters(spark):
    assert _one(spark, T.tokenize(T.clean_text("t")), "Ёлка и Cat a BB") == ["ёлка", "cat", "bb"]


def test_words_count_like_python_split(spark):
    s = " a\tb c d\n\ne "
    assert _one(spark, T.words_count("t"), s) == len(s.split())
    assert _one(spark, T.words_count("t"), None) == 0


def test_sorted_words(spark):
    assert _one(spark, T.sorted_words("t"), "b a Б c") == " ".join(sorted("b a Б c".split()))


def test_preview_and_default_name(spark):
    assert _one(spark, T.preview("t"), "x" * 30) == "x" * 20
    assert _one(spark, T.name_or_default("t"), "") == "there"
    assert _one(spark, T.name_or_default("t"), None) == "there"


def test_newline_to_space(spark):
    assert _one(spark, T.newline_to_space("t"), "a\nb\n") == "a b "
    assert _one(spark, F.lit(1), "x") == 1


def test_terms_equal_clean_then_tokenize(spark):
    cases = ["Привет, мир! re-use 42 don't\tёж: İx", "a:b c", ":ab::cd  e: ЁЖ ёж", "", "   ", "x", "abc123def"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for keep in (True, False):
        rows = df.select(T.terms("t", keep).alias("a"), T.tokenize(T.clean_text("t", keep)).alias("b")).collect()
        assert all(r.a == r.b for r in rows), rows


def test_iso_forms_equal_the_standard_library(spark):
    import datetime as dt

    from chatlake.functions.text import iso_datetime
    texts = ["2024-01-31", "20240131", "2024-01-31T10", "2024-01-31T10:11", "2024-01-31 10:11:12", "2024-01-31T10:11:12.5", "2024-01-31T10:11:12,123456",
             "2024-01-31x10:11:12.1234567", "20240131T101112", "2024-01-31T10:11:12Z", "2024-01-31T10:11:12+05:30", "2024-01-31T10:11:12-0030",
             "2024-01-31T10:11:12+01:02:03", "2024-02-30", "2024-01-31T25:00", "2024-01-31T10:60", "2024-01-31T10:11:60", "0001-01-01", "9999-12-31T23:59:59.999999",
             "", "no date", "2024", "2024-1-3", "2024-01-31T", "2024-13-01", "{\"k\": 1}", "2024-01-31T10:11:12+24:00", "tomorrow 2024-01-31", "2024-01-31\n"]
    got = {r.t: r.p for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", iso_datetime("t").alias("p")).collect()}
    for t in texts:
        try:
            want = dt.datetime.fromisoformat(t)
        except ValueError:
            want = None
        seen = got[t] and (got[t].at, got[t].offset)
        assert seen == (want and (want.replace(tzinfo=None), None if want.tzinfo is None else int(want.utcoffset().total_seconds()))), t
    assert got[None] is None
