from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_mixed_query_tokens(spark):
    got = one(spark, lambda c: T.query_tokens(c), "QuayLanternDriver.build 现金流审批")
    assert {"quaylanterndriver.build", "quay", "lantern", "driver", "现金流审批", "现金流", "审批"} <= set(got)
    assert got == sorted(set(got))
    assert "QuayLanternDriver.build" in one(spark, T.symbol_terms, "QuayLanternDriver.build 现金流审批")


def test_segmentation_is_by_words():
    got = T.Segmenter().text("现金流审批状态流转和资金安全风险点")
    assert {"状态流转", "状态", "流转", "资金安全", "风险点"} <= set(got)
    assert "流审" not in got


def test_unknown_spans_become_grams():
    assert T.Segmenter().run("甲乙丙丁戊") == ["甲乙丙丁戊", "甲乙丙丁", "乙丙丁戊", "甲乙丙", "乙丙丁", "丙丁戊", "甲乙", "乙丙", "丙丁", "丁戊"]
    assert T.Segmenter().run("如何") == []
    # once as a domain term, once in the run
    assert T.Segmenter(("甲乙",)).text("x甲乙") == ["甲乙", "甲乙"]


def test_separators_and_repeats(spark):
    assert one(spark, lambda c: F.array_sort(T.ascii_tokens(c)), "mooring_rope a mooring_rope") == ["mooring", "mooring", "mooring.rope", "mooring.rope", "rope", "rope"]
    assert one(spark, lambda c: F.array_sort(T.ascii_tokens(c)), "a-b12 HTTPServer.x") == ["a.b12", "b12", "http", "httpserver", "httpserver.x", "server"]
    assert one(spark, T.ascii_tokens, None) == [] and one(spark, T.ascii_tokens, "") == []


def test_driver_side_pieces_agree(spark):
    for word in ("QuayLanternDriver.build", "x:Y", "HTTPServer2Go", "a.b.c"):
        assert sorted(one(spark, lambda c: T.split_token(c), word)) == T.ascii_pieces(word)


def test_token_cost(spark):
    assert one(spark, lambda c: T.token_cost(c), "") == 1
    assert one(spark, lambda c: T.token_cost(c), "abcdefgh审批流") == 3
    assert one(spark, lambda c: T.token_cost(c, c), "😀😀😀") == 3


def test_globs():
    import re

    hit = lambda p, x: bool(re.search(T.glob_regex(p), x))
    assert hit("**/*.java", "a/b.java") and not hit("**/*.java", "b.java") and hit("*.java", "a/b.java")
    assert hit("a?[bc]", "axb") and not hit("a?[!bc]", "axb") and not hit("*.java", "x.JAVA") and hit("a+b", "a+b")
