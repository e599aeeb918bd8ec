import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import html, quality, text, urls
from tesserae.operators import context, feedback, search, store


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, verdict",
    [
        ("http://localhost/x", "blocked host"), ("http://10.0.0.1/", "private address"), ("http://172.20.1.1/", "private address"), ("http://172.32.1.1/", "ok"), ("http://192.168.1.5:80/", "private address"),
        ("http://127.0.0.2/", "private address"), ("http://169.254.1.1/", "private address"), ("http://[::1]/", "blocked host"), ("http://[fe80::1]/", "private address"), ("http://[2001:db8::1]/", "ok"),
        ("http://a.local/", "blocked suffix"), ("ftp://a.org/", "scheme"), ("https://a.org/x", "ok"), ("nonsense", "scheme"),
    ],
)
def test_safety(spark, url, verdict):
    assert one(spark, url, urls.safety) == verdict


def test_allow_list_takes_subdomains(spark):
    allowed = lambda c: urls.safety(c, ["example.org"])
    assert [one(spark, u, allowed) for u in ("https://a.example.org/", "https://example.org/", "https://badexample.org/")] == ["ok", "ok", "not allowed"]


def test_normalize_source(spark):
    assert one(spark, "HTTPS://Docs.Example.ORG/A/?q=1#x", urls.normalize_source) == "https://docs.example.org/A?q=1"
    assert one(spark, "https://a.org", urls.normalize_source) == "https://a.org/"
    assert one(spark, "nothing", urls.normalize_source) == ""


def test_resolve(spark):
    f = lambda link: one(spark, link, lambda c: html.resolve(F.lit("https://a.org/x/y.html?q"), c))
    assert [f("z"), f("/z"), f("//b.org/z"), f("http://c.org/")] == ["https://a.org/x/z", "https://a.org/z", "https://b.org/z", "http://c.org/"]


def test_title_falls_back(spark):
    assert one(spark, "<title> A &amp; B </title>", html.title) == "A & B"
    assert one(spark, '<meta property="og:title" content="C"><h1>D</h1>', html.title) == "C"
    assert one(spark, "<h2>E</h2>", html.title) == "E"
    assert one(spark, "", html.title) == ""


def test_text_drops_scripts_and_menus(spark):
    page = "<html><title>T</title><script>var x = '<p>no</p>'</script><nav>menu</nav><p>Actual Content</p></html>"
    assert "actual content" in one(spark, page, html.text) and "menu" not in one(spark, page, html.text) and "var" not in one(spark, page, html.text)


def test_parse_in_document_order(spark):
    page = "<h1>Installation Guide</h1><p>Run this first of all.</p><pre class='language-py'>import requests\nprint(1)</pre><h2>More</h2><table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table><a href='/x#y'>x</a>"
    r = html.parse(spark.createDataFrame([("https://a.org/", page)], "url string, html string")).first()["parsed"]
    assert [h["text"] for h in r["headings"]] == ["Installation Guide", "More"]
    assert r["code_blocks"][0]["language"] == "python" and r["code_blocks"][0]["context"] == "Run this first of all. | Installation Guide"
    assert r["topics"][0]["topic"] == "installation-guide" and r["links"][0]["url"] == "https://a.org/x"
    assert r["tables"] == [[["a", "b"], ["1", "2"]]]


def test_code_analysis(spark):
    code = "import requests\ndef hello():\n    pass\nclass MyClass:\n    pass"
    r = spark.createDataFrame([(code,)], "c string").select(text.imports(F.col("c"), F.lit("python")).alias("i"), text.types(F.col("c"), F.lit("python")).alias("t"), text.functions(F.col("c"), F.lit("python")).alias("f"), html.detect_language(F.col("c")).alias("l")).first()
    assert (r["i"], r["t"], r["f"], r["l"]) == (["import requests"], ["MyClass"], ["hello"], "python")


@pytest.mark.parametrize("links, paragraphs, wanted", [(90, 10, 0), (1, 2, 15 + 5), (0, 0, 15)])
def test_quality_score(spark, links, paragraphs, wanted):
    p = ["word " * 15] * paragraphs
    df = spark.createDataFrame([(p, [], links)], "p array<string>, h array<string>, n int")
    got = df.select(quality.score(F.col("p"), F.col("h"), F.lit(0), F.col("n"), F.lit("a b c"), F.lit(""), F.lit("https://a.org")).alias("s")).first()["s"]
    assert got == wanted


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "été": "été"}
    assert {w: text.porter(w) for w in words} == words


def test_porter_agrees_with_sqlite():
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
        con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    for word in "running relational nationalization hesitancy digitizer operator feudalism decisiveness hopefulness formaliti sensitiviti electrical goodness revival allowance inference airliner adjustment dependent communism activate effective bowdlerize rate cease roll".split():
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (word,))
        assert text.porter(word) == con.execute("SELECT term FROM v").fetchone()[0], word


def test_learned_score_equals_a_plain_fold(spark):
    rng = random.Random(3)
    log = [(f"u{rng.randrange(3)}", rng.random() < 0.7, k) for k in range(400)]
    df = spark.createDataFrame(log, "url string, success boolean, k int").select("url", "success", F.timestamp_seconds(F.col("k") * 37).alias("ts"), F.col("k").alias("seq"))
    want = {}
    for url, good, _ in log:
        want[url] = max(0.1, min(5.0, want.get(url, 1.0) + (0.2 if good else -0.2)))
    got = {r["url"]: r["score"] for r in feedback.scores(df, run=7).collect()}
    assert got == pytest.approx(want)


def test_merge_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.merge(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, store.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_save_rejects_and_merges(spark):
    words = "word " * 30
    old = spark.createDataFrame([(1, "https://a.org/1", "t", ("first " * 120).strip(), "a.org")], "id long, url string, title string, content string, domain string")
    new = spark.createDataFrame(
        [(2, "https://a.org/2", "t", "first " * 120, False, 1), (3, "https://a.org/3", "t", "too short", False, 1), (4, "https://a.org/1", "t", "New " + words, False, 2), (5, "https://a.org/4", "t", words, False, 3), (6, "https://a.org/5", "t", words, False, 4)],
        "id long, url string, title string, content string, has_code boolean, scraped_at int",
    )
    assert sorted(r["id"] for r in store.save(old, new).collect()) == [4, 5]


def test_deletions_cover_two_edits(spark):
    df = spark.createDataFrame([("license", "lisence"), ("abc", "ab"), ("a", "abc"), ("abcd", "wxyz")], "a string, b string")
    got = df.select(F.arrays_overlap(search.deletions(F.col("a"), 2), search.deletions(F.col("b"), 2)).alias("m")).collect()
    assert [r["m"] for r in got] == [True, True, True, False]


def test_diff(spark):
    r = context.diff(spark.createDataFrame([("a\nb\nc", "a\nx\nc"), (None, "")], "a string, b string")).collect()
    assert (r[0]["added"], r[0]["removed"]) == (["x"], ["b"]) and r[0]["similarity"] == 80.0 and r[1]["similarity"] == 100.0
    assert [tuple(x) for x in r[0]["changed"]] == [("b", "x")] and r[1]["changed"] == []


def test_neighbours(spark):
    from tesserae.plans import registry

    rows = [(k, ["a", "a", "a", None, "b"][k % 5]) for k in range(200)] + [(1000, "alone")]
    frame = spark.createDataFrame(rows, "id long, g string").repartition(6)
    groups = {}
    for k, g in sorted(rows):
        groups.setdefault(g, []).append(k)
    wanted = {(x, y) for ids in groups.values() for x, y in zip(ids, ids[1:])}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in context.neighbours(frame, "g", "id", registry.scratch(spark)).collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert context.neighbours(frame.limit(0), "g", "id", registry.scratch(spark)).count() == 0


def test_payload_source(spark, tmp_path):
    from tesserae.sources import readers

    (tmp_path / "payload-1.json").write_text('{"documents": [{"url": "u1", "title": "t", "content": "c"}, {"url": "", "content": "x"}, {"url": "u2", "content": "y"}]}')
    got = readers.payload(spark, f"file://{tmp_path}/payload-*.json")
    docs = spark.createDataFrame([("u2",)], "url string")
    assert [r["url"] for r in readers.import_new(docs, got).collect()] == ["u1"]


def test_stream_misses(spark, data, tmp_path):
    from tesserae.streaming import feeds

    log = feeds.feedback(feeds.events(spark, data))
    got = feeds.run_once(feeds.misses(log).select("query"), f"file://{tmp_path}/m", f"file://{tmp_path}/c", mode="append")
    names = [r["query"] for r in got.collect()]
    assert names and len(set(names)) <= len(names)


def test_structured_texts(spark):
    from tesserae.functions import flatten

    files = [("a.json", '{"a": {"b": [1, 2, 3, 4, 5, 6]}, "c": null}'), ("b.xml", '<?xml version="1.0"?><r x="1"><s>text</s></r>'), ("c.md", "# Title\nintro\n```py\nprint(1)\n```\n## Next\nmore"), ("d.html", "<html><body>x</body></html>"), ("e.json", "{broken"), ("f.txt", None)]
    got = {r["url"]: r for r in flatten.parse(spark.createDataFrame(files, "url string, content string")).collect()}
    assert got["a.json"]["structured"]["content"].split("\n") == [f"a.b[{k}]: {k + 1}" for k in range(5)] + ["c: "]
    assert got["b.xml"]["structured"]["content"] == "/r/s: text" and got["b.xml"]["structured"]["topics"][0]["heading"] == "/r@x"
    md = got["c.md"]["structured"]
    assert [t["heading"] for t in md["topics"]] == ["Title", "Next"] and md["code_blocks"][0]["snippet"] == "print(1)"
    assert got["d.html"]["structured"] is None and got["f.txt"]["kind"] == "plaintext"


def test_cascades_and_prompts(spark):
    a = spark.createDataFrame([(1, "x", 1)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (2, "z", 1)], "query_id int, doc_id string, rank int")
    assert sorted((r["query_id"], r["doc_id"], r["tier"]) for r in context.cascade([a, b]).collect()) == [(1, "x", 1), (2, "z", 2)]
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    docs = spark.createDataFrame([(1, 1, "T", "s"), (1, 9, "U", "t")], "query_id int, rank int, title string, snippet string")
    code = spark.createDataFrame([(1, 1, "py", "x = 1")], "query_id int, rank int, language string, snippet string")
    got = {r["query_id"]: r["prompt"] for r in context.prompt(queries, docs, code).collect()}
    assert got == {1: "# q\n\n### T\ns\n\n```py\nx = 1\n```", 2: "# r\n\nNo documents.\n\nNo code."}
    blocks = spark.createDataFrame([("x", 1, "py", "a"), ("x", 2, "js", "b"), ("y", 3, "py", "c"), ("z", 4, "go", "d")], "doc_id string, code_id int, language string, snippet string")
    hits = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, doc_id string, rank int")
    assert [r["code_id"] for r in context.code_examples(hits, blocks).orderBy("n").collect()] == [1, 4]


def test_repositories_and_code_of_other_languages(spark):
    from tesserae.functions import html, text
    from tesserae.operators import repo
    from tesserae.plans import fixtures

    files = spark.createDataFrame(fixtures.FILES, "repo string, path string, content string")
    assert {tuple(r) for r in repo.project_type(files).collect()} == {("web", "React / Next.js app"), ("lib", "Python library"), ("tool", "Rust project"), ("svc", "Go project"), ("none", "Unknown")}
    assert {(r["repo"], r["name"]) for r in repo.dependencies(files).collect()} == {("web", "react"), ("web", "left-pad"), ("web", "vite"), ("lib", "numpy"), ("lib", "pandas"), ("tool", "serde"), ("tool", "tokio"), ("svc", "github.com/a/b")}
    assert {(r["repo"], r["name"]) for r in repo.api_surface(files).collect()} >= {("web", "App"), ("web", "helper"), ("lib", "load"), ("lib", "Table"), ("tool", "run"), ("svc", "Serve")}
    assert "node_modules/x/index.js" not in {r["path"] for r in repo.select_files(files).collect()} and repo.understanding(files).count() == 5
    code = spark.createDataFrame(fixtures.CODE, "id long, code string").withColumn("language", html.detect_language(F.col("code")))
    got = {r["id"]: r for r in code.select("id", "language", text.imports(F.col("code"), F.col("language")).alias("imports"), text.functions(F.col("code"), F.col("language")).alias("functions")).collect()}
    assert [got[k]["language"] for k in (1, 2, 4, 5, 6, 7)] == ["python", "javascript", "rust", "go", "sql", "unknown"]
    assert got[1]["imports"] == ["import requests", "from os import path"] and got[1]["functions"] == ["hello"] and got[4]["functions"] == ["main"]
