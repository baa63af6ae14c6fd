import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import urls
from lectern.functions.markdown import normalize_markdown
from lectern.functions.model_json import parse_checkpoint, parse_plan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_terms(spark):
    assert one(spark, T.token_set(F.lit("Foo foo-bar é 中文字"))) == ["foo", "foo-bar", "中文字", "中文", "文字"]
    assert one(spark, T.retrieval_terms(F.lit("What is the Index index of 中文"))) == ["index", "index", "中文"]
    assert one(spark, T.clean(F.lit(" a \n b "))) == "a b"


def test_literals_are_longest_first(spark):
    got = one(spark, T.exact_literals(F.lit('why does `foo_bar` and "some words" fail')))
    assert got[0] == "some words" and "foo_bar" in got and "why" not in got


def test_even_indexes(spark):
    assert one(spark, T.even_indexes(F.lit(5), F.lit(3))) == [0, 2, 4]
    assert one(spark, T.even_indexes(F.lit(5), F.lit(1))) == [0]


def test_whole_questions(spark):
    for text, whole in (("Summarize the whole page", True), ("请总结全文", True), ("summarise this paragraph", False), ("what is this article about?", True)):
        assert one(spark, T.is_whole_article_question(F.lit(text))) is whole


def test_urls(spark):
    cases = {
        "https://garden.test/beds/roses/?UTM_Medium=mail&bed=4&fbclid=zz#pruning": "https://garden.test/beds/roses?bed=4",
        "http://Garden.TEST:80/a/./b/../c/": "http://garden.test/a/c",
        "https://garden.test:443": "https://garden.test/",
        "https://garden.test:8443/x?b=2&a=9&a=1&b": "https://garden.test:8443/x?a=1&a=9&b=&b=2",
        "https://ann:pw@garden.test/seed list/ä?q=red+rose&r=a%2Fb&s=50%": "https://ann:pw@garden.test/seed%20list/%C3%A4?q=red+rose&r=a%2Fb&s=50%25",
        "https://garden.test/app/#!/beds/4": "https://garden.test/app#!/beds/4",
        "https://garden.test/app#/beds/4?x=1": "https://garden.test/app#/beds/4?x=1",
        " https:\\\\garden.test\\up\\%2e%2E\\down#top ": "https://garden.test/down",
        "mailto:ann@garden.test": None,
        "https://": None,
        None: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, wanted string").select("*", urls.normalize_page_url(F.col("url")).alias("got"))
    for r in rows.select("*", urls.normalize_page_url(F.col("got")).alias("again")).collect():
        assert r["got"] == r["wanted"] == r["again"], r


def test_markdown():
    assert normalize_markdown("a\r\n\r\n\r\nb  \n\n") == "a\n\nb  "
    assert normalize_markdown("1.\n\n   first\n\n2. second") == "1. first\n2. second"
    assert normalize_markdown("```\n\n\nx\n```") == "```\n\n\nx\n```"


def test_plans_and_checkpoints():
    plan = parse_plan('```json\n{"rewrittenQuestion": " q ", "queries": ["A", "a", "b"], "coverage": "multi-section", "useConversation": true}\n```')
    assert plan["queries"] == ["A", "b"] and len(plan["evidence_needs"]) == 2 and plan["use_conversation"]
    assert parse_plan("no json") is None
    good = '{"goal": "g", "activeTopic": "t", "items": [{"text": "x", "status": "active"}], "decisions": [], "userConstraints": [], "unresolvedReferences": []}'
    assert parse_checkpoint(good)["goal"] == "g"
    assert parse_checkpoint(good.replace("active\"", "odd\"")) is None
    assert parse_checkpoint(good.replace('"g"', '"' + "g" * 601 + '"')) is None


def test_white_space_of_all_kinds(spark):
    every = " \t\n\x0b\f\r\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    row = spark.createDataFrame([(f"{every}a{every}b{every}",)], "t string").select(T.clean(F.col("t")).alias("c"), T.normalize_literal(F.col("t")).alias("n")).first()
    assert tuple(row) == ("a b", "a b")


def test_hosts_in_ascii(spark):
    """The coding of host names against Python's own, on names of many scripts."""
    rng = random.Random(7)
    alphabet = "abcxyz019-äöüßéñøç\u0430\u0431\u0436\u4e2d\u6587\u7f51\ud55c\uad6d\u0939\u093f\u0645\u0635\u0631\U0001d11e\U00020000"
    labels = ["bücher", "müller", "例え", "ü", "aü", "üü", "пример", "한국", "a", "中中中", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    rows = spark.createDataFrame([(x, f"{x}.example:8080") for x in labels], "label string, host string").select("label", urls.ascii_host(F.col("host")).alias("got")).collect()
    for r in rows:
        own = r["label"] if r["label"].isascii() else "xn--" + r["label"].encode("punycode").decode()
        assert r["got"] == f"{own}.example:8080", r["label"]
    page = spark.createDataFrame([("https://Bücher.example/a/?utm_x=1",)], "u string").select(urls.normalize_page_url(F.col("u")).alias("n")).first()["n"]
    assert page == "https://xn--bcher-kva.example/a"
