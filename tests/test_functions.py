"""Predicates and rules on single values."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import match, rules


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "pattern", "found"),
    [("Handler", "hand", True), ("Handler", "", True), ("Handler", "*", True), ("my_name", "my_name", True), ("xmy_name", "my_name", False), ("a*b", "a*b", True), ("aXb", "a*b", False), ("É", "é", False), ("a\\b", "a\\b", True), ("100%", "100%", True), ("abc", "a_c", True)],
)
def test_like_folds_ascii_and_has_no_escape(spark, text, pattern, found):
    assert value(spark, match.like(F.lit(text), pattern)) is found


@pytest.mark.parametrize(
    ("text", "pattern", "found"),
    [("getUser", "get|set", True), ("putUser", "get|set", False), ("a1c", "a(1|2)c", True), ("a3c", "a(1|2)c", False), ("abc", "^abc$", True), ("abcd", "^abc$", False), ("xxabcxx", "^.*abc.*$", True), ("ab", "a.*b", True), ("a1b", "a.*b", False), ("x", "(a|(x|y))", True)],
)
def test_regexish(spark, text, pattern, found):
    assert value(spark, match.regexish(F.lit(text), pattern)) is found


@pytest.mark.parametrize(("text", "pattern", "found"), [("src/a.py", "*.py", True), ("src/a.py", "src/*", True), ("src/a.py", "*a*", True), ("src/a.py", "src/*.py", True), ("a.py", "a.pya*a.py", False), ("a", "b", False)])
def test_glob(spark, text, pattern, found):
    assert value(spark, match.glob(F.lit(text), pattern)) is found


@pytest.mark.parametrize(("text", "op", "literal", "found"), [("10", ">", "9", True), (" 7 ", ">", "1", False), ("1.0", ">=", "1", False), ("99999999999999999999", ">", "1", False), ("-3", "<", "0", True), ("x", "<", "y", False), ("1.00", "=", "1.0", False), ("ab%", "LIKE", "%b%", True), ("abc", "LIKE", "a%", True), ("Abc", "LIKE", "a%", False), ("a_c", "LIKE", "a_c", True), ("abc", "LIKE", "a_c", False)])
def test_comparisons(spark, text, op, literal, found):
    assert value(spark, match.compare(F.lit(text), op, literal)) is found


@pytest.mark.parametrize(("path", "found"), [("a/test_x.py", True), ("x_test.go", True), ("src/x.spec.ts", True), ("tests/x.py", True), ("a/tests/b.c", True), ("src/contest.py", False), ("FooTest.java", True), ("latest.py", False)])
def test_test_paths(spark, path, found):
    assert value(spark, rules.is_test_path(F.lit(path))) is found


@pytest.mark.parametrize(("path", "made"), [("a/x_test.go", "a/x.go"), ("b/test_x.py", "b/x.py"), ("x.test.ts", "x.ts"), ("c/x.spec.js", "c/x.js"), ("x.py", None)])
def test_tested_paths(spark, path, made):
    assert value(spark, rules.tested_path(F.lit(path))) == made


@pytest.mark.parametrize(("name", "found"), [("TestX", True), ("Testing", False), ("test_a", True), ("testA", True), ("testa", False), ("describe", True), ("Example", True)])
def test_test_names(spark, name, found):
    assert value(spark, rules.is_test_function(F.lit(name))) is found


@pytest.mark.parametrize(("name", "made"), [("api-base-url", "api.base.url"), ("apiBaseUrl", "api.base.url"), ("API_KEY", "api.key")])
def test_config_names(spark, name, made):
    assert value(spark, rules.config_name(F.lit(name))) == made


@pytest.mark.parametrize(("name", "kind", "method", "broker"), [("gin.GET", "route_registration", "GET", None), ("requests.post", "http_client", "POST", None), ("my.Kafka.send", "async_broker", None, "kafka"), ("amqp.forget", "async_broker", None, "rabbitmq"), ("math.floor", None, None, None)])
def test_services(spark, name, kind, method, broker):
    assert [value(spark, f(F.lit(name))) for f in (rules.service_kind, rules.http_method, rules.broker)] == [kind, method, broker]
