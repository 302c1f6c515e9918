import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomdex.functions import stem as S
from fathomdex.functions import text as T


def one(spark, c, *values):
    names = [f"v{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values)], kinds).select(c(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["Hello, wörld 42!", "", "  ", "a_b-c", "L'été d'or"])
def test_query_and_column_tokens_agree(spark, text):
    assert one(spark, T.cased_tokens, text) == T.query_tokens(text)


def test_null_text_has_no_tokens(spark):
    assert one(spark, T.tokens, None) == []


def test_cjk_runs(spark):
    assert one(spark, T.universal_tokens, "ab 漢字文 c") == ["ab", "0漢", "漢", "漢字", "字", "字文", "文", "文0", "c"]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("formalize", "formal"), ("electrical", "electr"), ("allowance", "allow"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_porter(word, stem):
    assert S.porter(word) == stem


def test_variants_keep_case_and_leave_out_the_word():
    assert "Boxes" in S.variants("Box") and "Box" not in S.variants("Box")
    assert "CATS" in S.variants("CAT")
    assert {"city", "cities"} <= {*S.variants("cities"), "cities"}
    assert S.Sequenced(S.Combined(), S.Morphology("es")).variants_of("gato")


def test_dates(spark):
    for text, want in (("08/17/2007", dt.datetime(2007, 8, 17)), ("08/17/2007 15:00:00", dt.datetime(2007, 8, 17, 15)), ("2007-08-17", dt.datetime(2007, 8, 17)), ("never", dt.datetime(1970, 1, 1)), ("junk", None)):
        assert one(spark, T.parse_date, text) == want
    assert one(spark, lambda c: T.parse_date(c, F.lit(dt.datetime(2020, 1, 5))), "-2") == dt.datetime(2020, 1, 3)


def test_wildcards_escape_everything_else():
    import re

    assert re.match(T.wildcard("a.*?"), "a.xyz") and not re.match(T.wildcard("a.?"), "abc")


def test_pipelines(spark):
    assert one(spark, lambda c: T.pipeline(c, "lc_stop"), "The running 4x dogs of war") == ["running", "dogs", "war"]
    assert one(spark, lambda c: T.pipeline(c, "lc_stem"), "Running dogs") == ["run", "dog"]
    assert one(spark, lambda c: T.drop_numbers(T.tokens(c)), "a 12 b3") == ["a", "b3"]
    assert one(spark, lambda c: T.replace_tokens(T.tokens(c), {"a": "z"}), "a b") == ["z", "b"]
    assert one(spark, T.questions, "Well. What is this? No. How, then?") == ["What is this?", "How, then?"]


def test_escapes_and_ratio(spark):
    assert one(spark, T.html_encode, '<a b="c">&') == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert one(spark, T.string_escape, 'a"\\\n') == 'a\\"\\\\\\n'
    assert one(spark, lambda c: T.stem_ratio(c, "other"), "others") == pytest.approx(5 / 6)
    assert one(spark, T.bigrams, "abab") == ["ab", "ba"]
