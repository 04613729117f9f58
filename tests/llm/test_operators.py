"""URL filters, token counts, HTML, decontamination, mixing, toxicity and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import decontaminate, html_text, mixing, token_counts, toxicity, url_filters
from strataloom.llm.queries import ORACLE_SQL, QUERIES

# --- URL filters ---------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x=1", "https://example.com/en/", "http://a.example.com/en/x#t", "http://notexample.com/en/", "http://b.net/es/1", "http://b.net/en/", "http://com", "x.com/en/", None, "", "http://x.org/a?b/c", "http://y.com?en"]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(pages, none).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("a.example.com", "/en/x", "example.com/en/", "block"),
        3: ("notexample.com", "/en/", "com/", "allow"), 4: ("b.net", "/es/1", "net/es/", "block"), 5: ("b.net", "/en/", None, "allow"), 6: ("com", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("x.org", "/a", None, "allow"), 11: ("y.com", "", None, "allow"),
    }
    assert url_filters.url_filter(pages.where("false"), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.org", 1)] * 80 + [("bad.org", 0)] * 5 + [("good.org", 0)] * 80 + [("new.org", 1)] + [(f"h{i}.org", int(i % 9 == 0)) for i in range(60)]
    got = {r.host: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.org"].lower > 0.5 > got["good.org"].mean and got["new.org"].mean < got["bad.org"].mean and got["new.org"].lower < got["new.org"].mean


def test_hosts_without_outcomes_inherit(spark):
    """A host without outcomes is judged by its domain, else its suffix; its own bound stays null."""
    hosts = [f"h{i}.bad.org" for i in range(6)] + [f"h{i}.good.net" for i in range(6)]
    seen = [(i, f"http://{h}/x") for i, h in enumerate(h for h in hosts for _ in range(40))]
    outcomes = spark.createDataFrame([(i, int("bad" in u)) for i, u in seen], "page_id long, bad int")
    new = [(1000, "http://new.bad.org/a"), (1001, "http://new.good.net/a"), (1002, "http://other.net/a"), (1003, None), (1004, "http://a.unseen/")]
    pages = spark.createDataFrame(seen + new, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.bad_rate_lower) for r in url_filters.url_filter(pages, outcomes, rules=[]).where("page_id >= 1000").collect()}
    assert got[1000] == ("block", None) and {got[i] for i in (1001, 1002, 1003)} == {("allow", None)} and got[1004][1] is None
    assert url_filters.url_filter(pages, outcomes, rules=[]).count() == len(seen) + len(new)


def test_domains(spark):
    hosts = {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "x.b.com": ("b.com", "com"), "b.com:8080": ("b.com", "com"), "10.0.0.1": ("10.0.0.1", "(address)"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk"), "a.com.au": ("a.com.au", "com.au")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.domain, r.suffix) for r in df.withColumns(url_filters._domain_suffix(F.col("host"))).collect()}
    assert got == hosts


def test_repeated_pages_and_outcomes(spark):
    """What is given twice counts once, and multiplies no row."""
    pages = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/y"), (2, "http://a.org/" + "z" * 100_000), (3, None)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in pages], "page_id long, url string, host string, bad int")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "page_id long, bad int")
    got = url_filters.url_filter(pages, outcomes, rules=[]).collect()
    assert len(got) == 5 and len({r.bad_rate_lower for r in got if r.host == "a.org"}) == 1
    again = spark.createDataFrame([(1, 1), (2, 0)], "page_id long, bad int")
    assert sorted(map(str, got)) == sorted(map(str, url_filters.url_filter(pages, again, rules=[]).collect()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols[:1] + [c for c in cols if c.endswith("_id")]).reset_index(drop=True) for x in (got, want))
    a, b = (x.sort_values("page_id" if "page_id" in cols else "doc_id").reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=2e-6, equal_nan=True)
        else:
            assert (a[c].fillna("").astype(str) == b[c].fillna("").astype(str)).all()


# --- token counts --------------------------------------------------------------------------------


def test_counts(docs, odd, nothing, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["it's 'll don't", "  \n\n x  ", "a<|endoftext|>b", "\x1c\x85 y", "½ ²x ªº Ǆ", "日本 語", "a  ", "\t\t b", "12 345a", "é" * 50, ""]
    cache = str(tmp_path / "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs(list(enumerate(texts))), path, cache).collect()}
    assert got == {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    assert len(token_counts.token_counts(odd, path, cache).collect()) == odd.count()
    assert token_counts.token_counts(nothing, path, cache).count() == 0


def test_cache_is_used_and_appended_to(spark, docs, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    token_counts.token_counts(docs([(1, "a b"), (2, "a b"), (3, "c")]), path, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    spark.read.parquet(cache).limit(0).count()
    # a stored count is taken as it is; another tokenizer version would not find it
    stored = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    spark.createDataFrame(stored, "digest string, version string, n_tokens long").write.mode("overwrite").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs([(1, "a b"), (4, "d e f")]), path, cache).collect()}
    assert got == {1: 102, 4: 3} and spark.read.parquet(cache).count() == 3


def test_warm_cache_moves_misses_only(spark, docs, tmp_path, monkeypatch):
    """Few and many misses are picked in two ways that give the same."""
    import public_tokenizers

    path, rows = public_tokenizers.path("byte_bpe_50k.json"), [(i, f"text {i % 7}") for i in range(40)]
    got = []
    for sent in (100, 0):
        monkeypatch.setattr(token_counts, "MISSES_SENT", sent)
        cache = str(tmp_path / f"cache{sent}")
        token_counts.token_counts(docs(rows[:3]), path, cache).collect()
        got.append(sorted(tuple(r) for r in token_counts.token_counts(docs(rows), path, cache).collect()))
        assert spark.read.parquet(cache).count() == 7
    assert got[0] == got[1] and len(got[0]) == 40


# --- HTML ----------------------------------------------------------------------------------------

PAGE = """<html><head><title>x y</title><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a>home</a></li></ul></nav><div class="ad">buy now cheap</div>
<article><h1>The &amp; Title</h1><p>First <b>bold<br>line&nbsp;two<p>second   &lt;p&gt; one</p><div class="cookie-notice"><p>we use cookies</p></div><form><p>sign up</p></form><p>last words here</p></article>
<section id="comments"><p>great post thanks for it all</p></section><footer>&copy; f</footer></body></html>"""


def test_extraction(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    weights = html_text.learn(pages[:100])
    assert html_text.extract(PAGE, weights) == "The & Title\n\nFirst bold line two\n\nsecond <p> one\n\nlast words here"
    assert html_text.extract("", weights) == "" and html_text.extract("<div", weights) == "" and html_text.extract("<script>x", weights) == ""


def test_marks_on_prose(spark, sf):
    """A class that only mentions a mark does not take a paragraph or heading out of the article; a whole class that is one does."""
    weights = html_text.learn([r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").limit(100).collect()])
    page = """<html><body><nav><a>home</a></nav><article><h1>A long title of it</h1><h2 class="section-menu">What we ate</h2><p class="related-work">Others have done the same before us</p>
    <p class="notice-of-death">He died in the year of the storm</p><p class="advert">buy it now</p><div class="share-buttons"><p>share this</p></div><p>and that is the end of it all</p></article><footer>f</footer></body></html>"""
    assert html_text.extract(page, weights) == "A long title of it\n\nWhat we ate\n\nOthers have done the same before us\n\nHe died in the year of the storm\n\nand that is the end of it all"


def test_best_run_is_the_best():
    """The linear scan finds the run that trying all runs finds."""
    rng = random.Random(7)
    for _ in range(30):
        parts = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<a>", "</a>", "some words here ", "word ", "<li>"]) for _ in range(14)]
        page, weights = "".join(parts), {}
        items = html_text.tokens(page)
        for kind, _, f, value in items:
            if f is not None:
                weights.setdefault((kind if kind == "tag" else "word", *f), rng.uniform(-3, -0.1) if kind == "tag" else rng.uniform(-1, 2))
        scores = [html_text._score(weights, k, f, v) for k, _, f, v in items]
        best = max(sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1))
        text = html_text.extract(page, weights)
        runs = {" ".join(html_text.extract(page, weights).split())}
        want = [(i, j) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1) if abs(sum(scores[i:j]) - best) < 1e-9]
        words = {" ".join(" ".join(v for k, _, _, v in items[i:j] if k == "text" and v).split()) for i, j in want}
        assert "".join(text.split()) in {"".join(w.split()) for w in words}, (page, runs, words)


def test_extraction_of_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {i} of a very long page that goes on</p>" for i in range(30_000))
    pages = spark.createDataFrame([(1, None, f"<html><body><nav>x</nav><article>{body}</article></body></html>")], "page_id long, url string, html string")
    assert html_text.extract_text(pages).first().text.count("\n\n") == 29_999


def test_extraction_of_the_table(spark, sf):
    """The pages' articles are plain, so a split at the tags gives their text."""
    import html
    import re

    got = {r.page_id: r for r in html_text.op9_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_extraction_odd(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (3, "v", "plain words only", 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(pages).collect())
    assert got == [(1, ""), (2, ""), (2, ""), (3, "plain words only")]
    assert html_text.extract_text(pages.where("false")).count() == 0


# --- decontamination -----------------------------------------------------------------------------

ITEM = "Well, Tom has 5 apples and buys 7 more apples at the shop, how many apples does Tom have in the end of it?"


def test_templates(spark, docs):
    def other(name, a, b, last=None):
        return "Some words before. So, " + ITEM[6:].replace("Tom", name, 1).replace("Tom", last or name).replace("5", a).replace("7", b) + " And more after it."

    rows = [(1, other("Tom", "5", "7")), (2, other("Ann Lee", "15", "9.5")), (3, "Tom has apples and that is all there is to say about Tom"), (4, None), (5, ""), (None, ITEM), (6, ITEM.lower()), (7, ITEM), (7, ITEM)]
    bench = spark.createDataFrame([(9, ITEM), (8, "tiny item"), (7, None), (None, ITEM)], "item_id long, text string")
    found = lambda **more: sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs(rows), bench, **more).collect())
    assert found() == [(0, 9), (1, 9), (2, 9), (6, 9), (7, 9)]  # the row without an id too
    assert found(index_windows=0) == found()
    assert decontaminate.verdicts(docs(rows), bench).count() == len(rows)
    assert decontaminate.contaminated(docs(rows).where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs(rows), bench.where("false")).count() == 0


def test_short_items_and_signs(spark, docs):
    """An item of fewer words than a window is found inside a longer text; signs around words, however many, hide nothing."""
    hidden = " ".join("*" * 9 + w + "!" * 7 for w in ITEM.split())
    rows = [(1, "here is a tiny item, and more"), (2, "an item that is tiny"), (3, "see Paris now"), (4, hidden), (5, "***** " * 40), (6, ITEM * 3000), (7, "x" * 300_000)]
    bench = spark.createDataFrame([(1, "Tiny item!"), (2, "Which river, Paris"), (3, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), bench).collect())
    assert got == [(1, 1), (4, 3), (6, 3)]


def test_decontamination_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.verdicts(odd, bench).collect()
    assert len(got) == odd.count() and sorted((r.doc_id or 0) for r in got if r.contaminated) == [0, 5, 6, 6]
    assert decontaminate.verdicts(nothing, bench).count() == 0


def test_windows_of_many_items(spark, docs):
    """Windows that many items share join few rows, and lose none: the shares are those of a plain count."""
    import re

    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    common = " ".join(vocabulary[:8])
    items = [(i, common + " " + " ".join(rng.choices(vocabulary, k=6 + i % 5))) for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=10)) + " " + (rng.choice(items)[1] if i % 3 else common)) for i in range(60)]

    def grams(t):
        w = re.findall(r"\S+", t)
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    want = {(d, i) for d, t in rows for i, x in items if len(grams(t) & grams(x)) / len(grams(x)) >= 0.8}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for index_windows in (decontaminate.INDEX_WINDOWS, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), bench, index_windows=index_windows).collect()} == want
    assert len(want) >= 30


def test_slots_must_agree(spark, docs):
    item = "The red car drives 40 km and the blue car drives 60 km while the green car drives 40 km and the white car drives 60 km today"
    fits = item.replace("40", "11").replace("60", "22")
    mixed = item.replace("40", "11", 1).replace("60", "22", 1).replace("40", "33").replace("60", "44")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(docs([(1, fits), (2, mixed)]), bench).collect()}
    assert got == {1}


def test_slots_of_several_occurrences(spark, docs):
    """One whole occurrence is enough, whatever other occurrences or repeated template windows stand beside it."""
    box = "A box has 3 red, 4 blue and 5 green balls"
    add = "Add 3 and 4 then add 5 and 6 then add 7 and 8"
    rows = [(i, " . ".join(x)) for i, x in enumerate([[box, box.translate(str.maketrans("345", v))] for v in ("678", "128", "971")])]
    rows += [(10, add), (11, "Add 1 and 2 then add 9 and 0 then add 13 and 14"), (12, "Add 3 and 4 then add 5 and 4 then add 5 and 4")]
    bench = spark.createDataFrame([(1, box), (2, add)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.share) for r in decontaminate.contaminated(docs(rows), bench).collect())
    assert [x for x in got if x[0] < 12] == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (10, 2, 1.0), (11, 2, 1.0)]


def test_assignment_is_the_best():
    """The search finds what trying all assignments finds."""
    import itertools

    rng = random.Random(5)
    for _ in range(200):
        matches = [(rng.randrange(6), tuple(rng.choice((0, 1, 2, 3)) for _ in range(3)), tuple(rng.randrange(1, 4) for _ in range(3))) for _ in range(rng.randrange(1, 25))]
        want = 0
        for values in itertools.product((1, 2, 3), repeat=3):
            fill = dict(zip((1, 2, 3), values, strict=True))
            want = max(want, len({w for w, t, o in matches if all(a == 0 or fill[a] == b for a, b in zip(t, o, strict=True))}))
        assert decontaminate.most_held(matches, 0) == want


def test_long_assignment_is_the_best():
    """A search of many open values ends with the best one: the same as going along the values, which each window has three of in a row."""
    rng = random.Random(1)
    n, r = 40, 3
    matches = [(i, tuple(range(i + 1, i + 4)), tuple(rng.randrange(r) for _ in range(3))) for i in range(n) for _ in range(2 * r)]
    had = {(w, o) for w, _, o in matches}
    best = {(a, b): 0 for a in range(r) for b in range(r)}
    for i in range(n):
        best = {(b, c): max(best[a, b] + ((i, (a, b, c)) in had) for a in range(r)) for b in range(r) for c in range(r)}
    assert decontaminate.most_held(matches, 0) == max(best.values())


def test_names_in_any_case_and_place(spark, docs):
    """Copies in lower case and in capitals, and other names that open sentences."""
    story = "Tom has 5 apples. Ann gives 7 apples to him. Tom eats 2 of them. Ann sells 3 of hers. How many apples are left for Tom?"
    other = story.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "8")
    numbers = "Sum 1 2 3 4 5 6 7 8 9"
    rows = [(1, ITEM.lower()), (2, ITEM.upper()), (3, "before it. " + ITEM.lower().replace("5", "6") + " after it"), (4, other), (5, story.upper()), (6, numbers.lower()), (7, ITEM.lower().replace("apples", "pears").replace("buys", "sells"))]
    bench = spark.createDataFrame([(1, ITEM), (2, story), (3, numbers)], "item_id long, text string")
    for index_windows in (decontaminate.INDEX_WINDOWS, 0):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), bench, index_windows=index_windows).collect())
        assert got == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)]


def test_leaks_in_the_table(spark):
    """Every document that holds an item word for word is found, and no other one that shares few of its words."""
    import re

    sf = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {d for d, t in docs.items() if any(x in t for x in items.values())}
    got = {r.doc_id for r in decontaminate.op10_decontamination(spark, sf).where("contaminated").collect()}
    assert want and got == want


# --- mixing --------------------------------------------------------------------------------------


def test_raking():
    rng = random.Random(1)
    cells = [(f"s{a}", f"l{b}", c, rng.randrange(100, 5000)) for a in range(4) for b in range(3) for c in range(3)]
    p = np.array(mixing.rake_local(cells, 0.3, mixing.TEMPER))
    tokens = np.array([c[3] for c in cells], float)
    assert (p > 0).all() and (p <= 1).all() and abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-3 * tokens.sum()
    topic = [(p * tokens)[[c[2] == k for c in cells]].sum() / tokens[[c[2] == k for c in cells]].sum() ** mixing.TEMPER["topic"] for k in range(3)]
    assert max(topic) / min(topic) < 1.001
    source = {s: ((p * tokens)[[c[0] == s for c in cells]].sum(), tokens[[c[0] == s for c in cells]].sum() ** 0.5) for s in {c[0] for c in cells}}
    shares = [a / b for a, b in source.values()]
    assert max(shares) / min(shares) < 1.001


def test_raking_by_frames_agrees(spark, monkeypatch):
    rng = random.Random(2)
    cells = [(f"s{a}", f"l{b}", c, rng.randrange(100, 900)) for a in range(3) for b in range(2) for c in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    one = {(r.source, r.lang, r.topic): r.prob for r in mixing.rake(df, 0.3).collect()}
    monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", 1)
    two = {(r.source, r.lang, r.topic): r.prob for r in mixing.rake(df, 0.3).collect()}
    assert all(abs(one[k] - two[k]) < 1e-4 for k in one)


def test_raking_by_frames_agrees_on_hard_cells(spark, monkeypatch):
    """Probabilities bounded by 1 that converge slowly, and a topic without tokens: the same rounds give the same."""
    cells = [("a", "x", 0, 10), ("a", "y", 1, 5000), ("b", "x", 1, 40), ("b", "y", 0, 900), ("c", "x", 2, 30), ("c", "y", 2, 0), ("a", "x", -1, 0), ("b", "x", -1, 0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    one = {(r.source, r.lang, r.topic): r.prob for r in mixing.rake(df, 0.5).collect()}
    monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", 1)
    two = {(r.source, r.lang, r.topic): r.prob for r in mixing.rake(df, 0.5).collect()}
    assert max(one.values()) == 1 and set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_topics_are_learned(spark, docs):
    """Documents of one vocabulary share a topic, whatever their length; the sample bounds only what is learned from."""
    rng = random.Random(6)
    themes = [[f"{t}word{i}" for i in range(40)] for t in ("sea", "law", "cook", "tech")]
    rows = [(i, " ".join(rng.choices(themes[i % 4], k=rng.choice((8, 30, 300))))) for i in range(200)] + [(200, ""), (201, None), (202, "a b c")]
    for sample in (100, 2000):
        got = {r.doc_id: r.topic for r in mixing.describe(docs(rows), mixing.learn_topics(docs(rows), topics=4, sample=sample)).collect()}
        of = [{got[i] for i in range(200) if i % 4 == t} for t in range(4)]
        assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 4 and {got[i] for i in (200, 201, 202)} == {-1}


def test_topics_are_learned_from_all_rows(spark, docs):
    """A centre is the mean of all rows that are nearest to it, and rows dealt out otherwise give the same centres."""
    rng = random.Random(8)
    themes = [[f"{t}word{i}" for i in range(40)] for t in ("sea", "law", "cook")]
    texts = [" ".join(rng.choices(themes[i % 3], k=12)) for i in range(4200)]
    rows = docs(list(enumerate(texts)))
    centres = mixing.learn_topics(rows, topics=3)
    raw = [t.encode() for t in texts]
    x = mixing.vectors(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))[1]
    for c in centres.values():
        of = (x @ c.T).argmax(axis=1)
        means = np.stack([x[of == i].sum(axis=0) for i in range(3)])
        assert np.allclose(c, means / np.sqrt((means * means).sum(axis=1, keepdims=True)), atol=2e-4)
    again = mixing.learn_topics(rows.repartition(7, "text"), topics=3)
    assert set(again) == set(centres) == {"", "en"} and all(np.allclose(again[k], centres[k], atol=1e-12) for k in centres)


def test_margin_report(spark, docs):
    rows = docs([(i, "word " * (5 + i % 9)) for i in range(300)])
    mixed = mixing.mix(rows, budget=0.4)
    report = mixing.margin_report(mixed, budget=0.4).collect()
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    for margin in mixing.MARGINS:
        of = [r for r in report if r.margin == margin]
        assert abs(sum(r.target for r in of) - 0.4 * total) < 1e-6 * total and all(abs(r.residual) < 1e-3 for r in of)
    # no probability may be over 1, so a budget of nearly all cannot meet targets that are not the sources' own shares
    hard = mixing.margin_report(mixing.mix(rows.withColumn("source", F.when(F.col("doc_id") < 3, "few").otherwise("many")), budget=0.9), budget=0.9)
    assert hard.agg(F.max(F.abs("residual"))).first()[0] > 0.1


def test_mixing(spark, sf, odd, nothing):
    rows = mixing.op4_mixing(spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert abs(rows.n_tokens[rows.sampled].sum() / rows.n_tokens.sum() - 0.5) < 0.2
    again = mixing.op4_mixing(spark, sf).toPandas()
    assert rows.sort_values("doc_id").sampled.tolist() == again.sort_values("doc_id").sampled.tolist()
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(nothing).count() == 0
    nulls = odd.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    assert {r.source for r in mixing.mix(nulls).collect()} == {"(none)"}


# --- toxicity ------------------------------------------------------------------------------------


def test_gradients():
    p = toxicity.fresh()
    _, kind, types = toxicity._training_types(["bad word you are a b", "hello world this is fine", "x y z bad"])
    rows = np.full((3, toxicity.WINDOW), -1)
    for i, (a, b) in enumerate(((0, 6), (6, 11), (11, 15))):
        rows[i, : b - a] = kind[a:b]
    label = np.array([1, 0, 1], np.float32)
    _, g = toxicity.gradients(p, types, rows, label)
    for k in p:
        v, d = p[k].reshape(-1), g[k].reshape(-1)
        i = int(np.abs(d).argmax())
        old, v[i] = v[i], v[i] + 1e-2
        up, _ = toxicity.gradients(p, types, rows, label)
        v[i] = old - 1e-2
        down, _ = toxicity.gradients(p, types, rows, label)
        v[i] = old
        assert abs((up - down) / 2e-2 - d[i]) < 2e-3, k


def test_signs_around_words():
    """Signs at both ends of a word are cut off, however many there are; a word of signs is its first one."""
    texts = [b"***bad*** word", b"*********************bad*********************** word", b"bad word", b"!!!!!!!! word"]
    types = []
    for t in texts:
        doc, kind, word_row, _, _ = toxicity.word_types(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        types.append(word_row[kind].tolist())
    assert types[0] == types[1] == types[2] != types[3]


def test_scores_are_those_of_a_plain_network():
    """Scores of whole texts against a network written out word by word and window by window."""
    p = toxicity.fresh(3)
    p["bias"][:] = 0.3
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("bad", "good", "x", "lovely", "you")) for _ in range(n)) for n in (1, 5, 32, 33, 60, 100)] + ["", "   "]
    raw = [t.encode() for t in texts]
    got = toxicity.score_texts(p, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    sig = lambda v: 1 / (1 + np.exp(-v))
    n = toxicity.HIDDEN

    def window(xs):
        states = {}
        for d, seq in (("f", xs), ("b", xs[::-1])):
            h, all_h = np.zeros(n), []
            for x in seq:
                a, g = x @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                r, z = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
                h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
                all_h.append(h)
            states[d] = all_h if d == "f" else all_h[::-1]
        h = np.concatenate([states["f"], states["b"]], axis=1)
        e = np.exp(np.tanh(h @ p["att"]) @ p["query"])
        return sig((e / e.sum()) @ h @ p["out"] + p["bias"][0])

    for t, x, score in zip(texts, raw, got, strict=True):
        if not t.split():
            assert score == 0
            continue
        _, kind, *types = toxicity.word_types(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        vectors = toxicity.inputs(p, *types)[kind]
        starts = [0] + [i * toxicity.STEP for i in range(1, 99) if (i - 1) * toxicity.STEP + toxicity.WINDOW < len(kind)]
        assert abs(score - max(window(vectors[i : i + toxicity.WINDOW]) for i in starts)) < 1e-4


def test_training_takes_whole_texts(spark, docs, monkeypatch):
    """A toxic passage far into a long text is trained on; the bound in bytes leaves out rows, never parts of one."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed=5: seen.append(dict(zip(texts, labels, strict=True))) or toxicity.fresh())
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    long = "fine words " * 5000 + "bad end"
    rows = [(i, long if k == 0 else f"text {i}") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, int(k % 2 == 0)) for k, i in enumerate(ids)] + [(ids[1], 1)], "doc_id long, toxic int")
    toxicity.fit(docs(rows), labels)
    assert seen[0][long] == 1 and seen[0][rows[1][1]] == 1 and len(seen[0]) == len(rows)
    toxicity.fit(docs(rows), labels, most_bytes=2000)
    assert set(seen[1]) == {t for _, t in rows if t != long}


def test_windows_cover_every_word():
    doc = np.repeat([0, 1, 3], [5, 100, 33])
    owner, first, size = toxicity.window_table(doc, 4)
    seen = np.zeros(len(doc), int)
    for o, f, s in zip(owner, first, size, strict=True):
        assert (doc[f : f + s] == o).all()
        seen[f : f + s] += 1
    assert (seen > 0).all() and set(owner) == {0, 1, 3}


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.op6_toxicity(spark, sf).toPandas(), spark.read.parquet(f"{sf}/labels.parquet").toPandas()


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and rows.score.between(0, 1).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.9


def test_toxicity_odd(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score < 0.5 for r in rows) and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    """Each stage keeps the columns, and what it takes out is what its operator rejects."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("node", F.lit(1))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        sizes.append(out.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_pipeline_against_brute_force(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for i, t in rows.items():
        best[t.translate(lower)] = max(best.get(t.translate(lower), i), i)
    exact = corpus_pipeline.exact(spark, docs, sf)
    assert {r.doc_id for r in exact.collect()} == set(best.values())
    sets = {}
    for i in best.values():
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[i].translate(lower))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for _ in range(len(links) + 1):
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    near = corpus_pipeline.near(spark, exact, sf)
    assert {r.doc_id for r in near.collect()} == {i for i in sets if root[i] == i}


def test_pipeline_judges_rows_without_ids(spark, sf):
    """Rows without an id and rows that repeat one are judged by their text."""
    rows = [(None, "same text here"), (3, "same text here"), (5, "Same Text here"), (5, "another one that stays"), (None, "only one of its kind"), (None, "Only one of its kind")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th int")
    left = lambda stage: sorted(((r.doc_id or 0), r.text) for r in stage(spark, docs, sf).collect())
    assert left(corpus_pipeline.exact) == [(0, "Only one of its kind"), (0, "only one of its kind"), (5, "Same Text here"), (5, "another one that stays")]
    assert left(corpus_pipeline.near) == [(0, "Only one of its kind"), (0, "only one of its kind"), (3, "same text here"), (5, "another one that stays")]
    assert len(left(corpus_pipeline.decontaminated)) == len(rows) == len(left(corpus_pipeline.clean_toxic))


def test_pipeline_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
