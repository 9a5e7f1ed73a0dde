import pytest

EXTRA = ("size", "key", "score", "id", "n", "shard", "slot", "range", "block", "cluster", "host", "__text_")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def with_extra(df):
    """Columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("x") for name in EXTRA})


@pytest.fixture
def odd(spark):
    """Null and empty values in every column, a long text, ties and repeated rows, names that clash."""
    long = "alpha beta gamma delta " * 40_000
    rows = [
        (1, "One small text of a few words here.", "en", "a", 35), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, "   \n\t ", None, None, 6), (5, long, "en", "b", len(long)),
        (6, "One small text of a few words here.", "en", "b", 35), (6, "One small text of a few words here.", "en", "b", 35), (None, "No id at all in this one, it seems.", None, "c", 1), (None, None, None, None, None),
        (7, "Ünïcödé 文字 \U0001f600 mixed", "de", "", 20), (8, "x" * 30_000, "de", "c", 30_000), (9, "123 456 !!! ???", "fr", "c", 15),
    ]
    return with_extra(documents(spark, rows))


@pytest.fixture
def none(odd):
    return odd.limit(0)
