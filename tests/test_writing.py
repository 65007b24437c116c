"""Structure plans, rendering, schema, masks, translation and the smaller text functions, on literals."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import scripts
from scriptorium.functions import text as T
from scriptorium.operators import answers, findings, integrity, performance, scoring, translating

SCHEMA = "id int, title string, meta_description string, author string, author_credentials string, published string, source_url string, text string, blocks array<struct<type:string,text:string>>, images array<struct<src:string,alt:string>>, faqs array<struct<q:string,a:string>>"


def article(spark, **of):
    row = {"id": 1, "title": 'A "T"', "meta_description": "D", "author": "Ann Lee", "author_credentials": "", "published": "", "source_url": "https://h.org/p/x", "text": "one two", "blocks": [("h2", "1) Why?"), ("p", "a < b"), ("li", "x"), ("li", "y"), ("tldr", "z"), ("quote", "q")], "images": [("/a.png", "")], "faqs": [("Q?", "A.")]} | of
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def test_structure_plan(spark):
    plan = "id int, title string, meta_description string, tldr array<string>, tldr_heading string, answers map<string,string>, blocks array<struct<type:string,text:string>>, faqs array<struct<q:string,a:string>>, images_alt map<string,string>"
    plans = spark.createDataFrame([(1, " New ", None, [" s ", ""], None, {"1) Why? ": "So."}, None, [("", "x")], {"/a.png": "alt"})], plan)
    rows = article(spark).unionByName(article(spark, id=2))
    one, two = answers.apply_structure(rows, plans, "id").orderBy("id").collect()
    assert (one.title, one.meta_description, [(b.type, b.text) for b in one.blocks[:4]]) == ("New", "D", [("h2", "TL;DR"), ("tldr", "s"), ("h2", "1) Why?"), ("answer", "So.")])
    assert [tuple(i) for i in one.images] == [("/a.png", "alt")] and [tuple(f) for f in one.faqs] == [("Q?", "A.")]
    assert two.title == 'A "T"' and len(two.blocks) == 6


def test_rendering(spark):
    got = answers.render_html(article(spark)).first().html
    assert '<title>A &quot;T&quot;</title>' in got and "  <p>a &lt; b</p>\n  <ul>\n    <li>x</li>\n    <li>y</li>\n  </ul>\n  <aside class=\"tldr\"><ul>\n    <li>z</li>\n  </ul></aside>\n  <blockquote>q</blockquote>" in got
    assert answers.render_markdown(article(spark)).first().markdown == '# A "T"\n\n> D\n\n## 1) Why?\n\na < b\n\n- x\n- y\n- z\n\n> q\n\n\n## FAQ\n\n### Q?\n\nA.\n\n'


def test_schema_and_hreflang(spark):
    graph = json.loads(answers.with_schema(article(spark), "2026-02-03", "Brand").first().schema)["@graph"]
    assert [g["@type"] for g in graph] == ["Article", "Organization", "FAQPage", "BreadcrumbList"]
    assert graph[0]["datePublished"] == "2026-02-03" and graph[0]["author"] == {"@type": "Person", "name": "Ann Lee"} and graph[0]["about"] == [{"@type": "Thing", "name": "Brand"}, {"@type": "Thing", "name": "Why"}]
    assert graph[3]["itemListElement"][0]["item"] == "https://h.org/p" and graph[2]["mainEntity"][0]["acceptedAnswer"]["text"] == "A."
    none = json.loads(answers.with_schema(article(spark, faqs=[], images=[]), "2026-02-03", health=True).first().schema)["@graph"]
    assert len(none) == 3 and "image" not in none[0] and none[0]["@type"] == "MedicalWebPage" and none[0]["reviewedBy"]["jobTitle"] == "Reviewed by the medical team"
    urls = spark.createDataFrame([(1, "hi", "u/hi"), (1, "hinglish", "u/x"), (1, "en", "u/en")], "id int, lang string, url string")
    assert {(r.hreflang, r.href) for r in answers.hreflang(urls, "id").collect()} == {("hi-IN", "u/hi"), ("hi-Latn-IN", "u/x"), ("en", "u/en"), ("x-default", "u/en")}


def test_masks_and_spans(spark):
    text = "Mail a.b@c.org or see http://x.org/5%. Rs. 1,000 for 500 mg (5 %), call 9876543210; ५ $1 \\ 12.5a"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    rows = {r.id: r for r in integrity.unmasked(integrity.masked(df, "t")).collect()}
    assert rows[1].held == ["a.b@c.org", "http://x.org/5%.", "Rs. 1,000", "500 mg", "5 %", "9876543210", "5", "1", "12"]
    assert "⦉0⦊ or see ⦉1⦊" in rows[1].masked and rows[1].unmasked == text.replace("५", "5")
    assert (rows[2].masked, rows[2].unmasked, rows[3].unmasked) == ("", "", "")
    kinds = [(r.kind, r.value) for r in integrity.protected_spans(df.filter("id = 1"), "t", ["id"]).collect()]
    assert kinds[:4] == [("email", "a.b@c.org"), ("url", "http://x.org/5%."), ("price_inr", "Rs. 1,000"), ("dosage", "500 mg")]
    audit = {r.value: r.context for r in integrity.claim_audit(df.filter("id = 1"), "id", "t").collect()}
    assert audit["500 mg"].startswith("1,000 for 500 mg")


def test_fidelity(spark):
    df = spark.createDataFrame([(1, "Take 500 mg under supervision and consult a doctor about kidney stones", "Take 500 mg under supervision and consult a doctor about kidney stones", "Take 50 mg, guaranteed"), (2, "five plain words stand here", None, "five plain words stand here")], "id int, s string, back string, t string")
    one, two = integrity.fidelity(df, "s", "back", [], "t").orderBy("id").collect()
    assert [f.kind for f in one.flags] == ["protected_span", "protected_span", "medical_claim", "hedge_lost"] and one.fidelity == 100 - 48
    assert two.fidelity == 100.0 and [f.kind for f in two.flags] == ["fidelity"]
    gate = spark.createDataFrame([(80.0, 80.0, 75.0, 10.0, []), (80.0, 80.0, 75.0, 10.0, [("hedge_lost", "error")])], "aeo double, burstiness double, native_review double, ai_likeness double, flags array<struct<kind:string,severity:string>>")
    assert sorted((r.draft_score, r.passed) for r in scoring.english_gate(gate).collect()) == [(78.8, False), (78.8, True)]


def test_translation(spark):
    rows = article(spark, blocks=[("h2", "One http://x.org/Y two"), ("p", "")], images=[("/a.png", "alt")])
    cache = spark.createDataFrame([], "key string, value string")
    out = translating.translate_articles(rows, "id", lambda texts: (t.replace("one", "EINS").replace("One", "Eins").replace("Q?", "F?") for t in texts), cache).first()
    assert (out.title, out.blocks[0].text, out.blocks[1].text, out.faqs[0].q, out.images[0].alt) == ('A "T"', "Eins http://x.org/Y two", "", "F?", "alt")
    parts = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((3, 4, 9, 2, 2))], "id int, pos int, text string")
    assert [r.batch for r in translating.batches(parts, "id", 7).orderBy("pos").collect()] == [0, 0, 1, 2, 2]

    def fails(texts):
        raise OSError

    ask = translating.chain([fails, lambda ts: [None if t == "b" else t.upper() for t in ts], lambda ts: [f"<{t}>" for t in ts]])
    assert list(ask(iter(["a", "b"]))) == ["A", "<b>"]


def test_small_functions(spark):
    df = spark.createDataFrame([("मधुमेह के लक्षण",), ("ગુજરાતી ભાષા",), ("Früh 12",)], "t string")
    assert [r.s for r in df.select(scripts.roman_slug(F.col("t")).alias("s")).collect()] == ["madhumeha-ke-laksana", "gujarati-bhasa", "fruh-12"]
    one = spark.createDataFrame([('say ```json\n{"a": {"b": 1}}\n``` end', "a🙂<b>&\"")], "j string, t string")
    r = one.select(T.json_part(F.col("j")).alias("j"), T.utf16_length(F.col("t")).alias("n"), T.escape_html(F.col("t")).alias("e")).first()
    assert (r.j, r.n, r.e) == ('{"a": {"b": 1}}', 8, "a🙂&lt;b&gt;&amp;&quot;")
    assert [T.column_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    vitals = spark.createDataFrame([("speed-index", 3400.0), ("speed-index", 3401.0), ("cumulative-layout-shift", 0.3), ("other", 1.0)], "metric string, value double")
    assert sorted(r.rating for r in performance.rated(vitals).collect()) == ["good", "needs work", "poor"]
    links = spark.createDataFrame([(1, "https://h.org/p", [("/a", "here"), ("http://gone.org", "x")])], "id int, source_url string, links array<struct<href:string,text:string>>")
    checked = spark.createDataFrame([("http://gone.org", 404)], "href string, status int")
    assert {(r.check, r.status) for r in findings.links(links, "id", checked).collect()} == {("internal", "pass"), ("external", "pass"), ("anchor_text", "warn"), ("broken", "fail")}


def brute_spans(text):
    """Every match of every kind, claimed character by character."""
    import regex

    taken, found = set(), []
    for kind, pattern in integrity._rules(integrity.PROTECTED):
        for m in regex.finditer(pattern, text):
            own = set(range(*m.span()))
            if own and not own & taken:
                taken |= own
                found.append((m.start(), kind, m.group().strip()))
    return [(k, v) for _, k, v in sorted(found)]


def test_spans_equal_brute_force_on_any_code_point(spark):
    import random

    rng = random.Random(8)
    pieces = ["http://a.b/5mg", "see@x.org", "9876543210", "+91 9876543210", "5 mg", "5,5ml", "₹ 1,200.50", "Rs.99", "INR5", "12 %", "3.5%", "42", "7 8", "a5", "5a", " ", ".", ",", "", "", "\U0001f600", "é", "-", "\n", "1)", "2 kg5", "INR 9876543210", "9876543210 mg", "x@y.z5%"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "x" * 100_000 + " 5 mg", "7 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: None if r.s is None else [(x.kind, x.value) for x in r.s] for r in df.select("id", integrity.spans(F.col("t")).alias("s")).collect()}
    assert got == {i: None if t is None else brute_spans(t) for i, t in enumerate(texts)}
    one = spark.createDataFrame([("INR 9876543210 mg, http://a.b/5% 5%",)], "t string").select(integrity.spans(F.col("t")).alias("s")).first().s
    assert [(x.kind, x.start, x.end) for x in one] == [("phone", 4, 14), ("url", 19, 32), ("percent", 33, 35)]  # no price or dose is left of the number
    back = integrity.unmasked(integrity.masked(df, "t")).collect()
    assert all(r.unmasked == (r.t or "") for r in back)
    own = spark.createDataFrame([(1, "⦉0⦊ and 5 mg, ⦉7⦊")], "id int, t string")
    assert integrity.unmasked(integrity.masked(own, "t")).first().unmasked == "⦉0⦊ and 5 mg, ⦉7⦊"


def test_bags_of_many_spans(spark):
    import time

    a, b = " ".join(str(i) for i in range(20_000)), " ".join(str(i) for i in range(10, 20_005)) + " 50 50"
    rows = integrity.fidelity(spark.createDataFrame([(1, a, b), (2, "5 5 6", "5 7"), (3, None, ""), (4, "x 5", None)], "id int, s string, t string"), "s", "t", [])
    began = time.time()
    got = {r.id: [f.kind for f in r.flags].count("protected_span") for r in rows.collect()}
    assert got == {1: 10 + 5 + 2, 2: 3, 3: 0, 4: 0} and time.time() - began < 60


def test_blocks_with_control_characters(spark):
    from scriptorium.sources import html

    df = spark.createDataFrame([(1, "<p>c\x01d e</p><p>\x02f\x02 gh</p>")], "id int, html string")
    assert [(b.type, b.text) for b in html.block_rows(df, "id").orderBy("pos").collect()] == [("p", "c d e"), ("p", "f gh")]
