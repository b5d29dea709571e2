"""The rules of op9_urls, word by word as its contract lists them."""

from tallyframe.llm.op9_urls import RULES, judge

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_each_rule_has_its_word(spark):
    assert [" ".join(r) for r in RULES] == CONTRACT.split(", ")
    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://casino-slots.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://m.example.net/de/81": ("example.net/de/8", "block"), "http://library.example.org/es/1": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge(pages).orderBy("page_id").collect()] == list(urls.values())
