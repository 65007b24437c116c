from scriptorium.llm import urlrules
from scriptorium.llm.queries import RULES


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_judge(spark):
    urls = ["http://Example.ORG/es/x?y", "https://a.b.example.org/en/17#z", "http://example.org", "http://x.com/fr/1", "http://x.com/de/", "ftp://com/de/1", "nothing", None, "", "http://", "http://xorg/", "a://b://c/d", "http://.org/", "http://example.org?/es/", "http://é.org/es/", "http://x.org:80/"] * 2
    pages = spark.createDataFrame([(i // 2 if i < 6 else i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, urlrules.judge(pages, urlrules.rule_table(spark, RULES)).collect()), key=str)
    assert got == sorted(((i // 2 if i < 6 else i, *brute(u)) for i, u in enumerate(urls)), key=str)


def test_conflicts_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = urlrules.rule_table(spark, [("ORG", "/", "allow"), ("org", "/", "block")])
    assert urlrules.judge(pages, rules).first().verdict == "block"
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert urlrules.judge(pages, rules.limit(0)).first().rule is None
