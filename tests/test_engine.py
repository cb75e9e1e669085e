"""Operators on literal rows, and the robots plan against the standard library's parser."""

import http.server
import json
import random
import threading
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import text, url
from sitegauge.functions.rounding import half_even_1
from sitegauge.operators import content, history, judgment, probes, robots, scoring, sitemap, structure
from sitegauge.operators import page as pages
from sitegauge.options import Options
from sitegauge.plans import live
from sitegauge.sources import dimensions as d
from sitegauge.sources import fetch, sinks
from sitegauge.streaming import history as streams


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).collect()[0]


def test_urls(spark):
    u = F.col("u")
    rows = spark.createDataFrame([(" \t\u00a0a.example\n",), ("http://b.example:80/x?q#f",), ("HTTPS://C.example",)], "u string")
    got = [tuple(r) for r in rows.select(url.normalize(u), url.base(url.normalize(u))).collect()]
    assert got == [
        ("https://a.example", "https://a.example"),
        ("http://b.example:80/x?q#f", "http://b.example:80"),
        ("https://HTTPS://C.example", "https://HTTPS:"),
    ]
    assert one(spark, "u string", ("a%2Fb+c",), url.decoded(u))[0] == "https://a/b+c"
    assert one(spark, "u string", ("https://A.example//?X=1",), url.canonical(u))[0] == "https://a.example//"


def test_text(spark):
    t = F.col("t")
    rows = spark.createDataFrame([("a  b\nc ",), ("  ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.word_count(t)).collect()] == [3, 0, 0, 0]
    assert one(spark, "t string", ("x\r\ny\n\nz\n",), text.lines(t))[0] == ["x", "y", "", "z"]
    ends = "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i\rj\n"
    assert one(spark, "t string", (ends,), text.lines(t))[0] == ends.splitlines()
    around = "\u3000\x1f a b \u2003\x85"
    assert one(spark, "t string", (around,), text.strip(t))[0] == around.strip()
    assert one(spark, "t string", ("<a & b>",), text.escape_html(t))[0] == "&lt;a &amp; b&gt;"


def test_rounding_agrees_with_python(spark):
    values = [k / 10 * 0.85 for k in range(1001)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", half_even_1(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 1) for r in got)


def random_robots(rng):
    agents = ["*", "GPTBot", "Google", "Applebot", "bot", "Claude-SearchBot", "nobody"]
    paths = ["/", "", "/p", "/private/", "/page", "*", "/q?x", "/caf\u00e9", "/caf%C3%A9", "/%70age", "/x?", "/a b", "/~u"]
    lines = []
    for _ in range(rng.randint(0, 12)):
        lines.append(
            rng.choice(
                [
                    lambda: f"User-agent:{rng.choice([' ', chr(9), ''])}{rng.choice(agents)}",
                    lambda: f"{rng.choice(['Disallow', 'allow', 'DISALLOW', 'Disallow' + chr(9)])}:{rng.choice([' ', chr(9)])}{rng.choice(paths)}",
                    lambda: "",
                    lambda: f"Crawl-delay: {rng.choice(['5', '2.5', 'x', '10'])}",
                    lambda: "# note",
                    lambda: " Sitemap: https://s.example/a.xml",
                    lambda: "Disallow: /x # inline",
                ]
            )()
        )
    return "\n".join(lines) + rng.choice(["", "\n"])


def test_robots_like_the_standard_library(spark):
    rng = random.Random(3)
    rows = [(i, f"https://h.example{rng.choice(['', '/', '/page', '/private/x', '/x', '/caf%C3%A9/1', '/caf\u00e9', '/a%20b', '/%7Eu', '/q?x=1'])}", 200, random_robots(rng)) for i in range(400)]
    got = {(r.page_id, r.bot_ord): (r.allowed, r.crawl_delay) for r in robots.access(spark.createDataFrame(rows, "page_id long, url string, http_status int, text string")).collect()}
    for i, u, _, body in rows:
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(body.splitlines())
        for ordinal, agent, _, _ in d.BOTS:
            at = u if u.endswith("/") else u + "/"
            want = (True, None) if not body else (rp.can_fetch(agent, at), rp.crawl_delay(agent))
            assert got[i, ordinal] == want, (body, u, agent)


def test_robots_defaults_paths_and_sitemaps(spark):
    rows = [
        (1, "https://a.example", 404, "User-agent: *\nDisallow: /"),
        (2, "https://a.example", None, None),
        (3, "https://a.example", 200, "User-agent: GPTBot\nDisallow: /a\nDisallow:\nUser-agent: *\nDisallow: /b # why\nSITEMAP: https://a.example/s.xml\nsitemap:"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, http_status int, text string")
    got = robots.access(df).where("page_id < 3")
    assert got.count() == 22 and got.where("allowed AND rule_source = 'default-allow'").count() == 22
    paths = [(r.bot_ord, r.pos, r.path) for r in robots.disallowed_paths(df).where("bot_ord < 2").orderBy("bot_ord", "pos").collect()]
    assert paths == [(0, 0, "/a"), (0, 1, "/b # why"), (1, 0, "/b # why")]
    assert [tuple(r) for r in robots.sitemap_directives(df).collect()] == [(3, 0, "https://a.example/s.xml")]


def test_sitemap(spark):
    body = "<urlset><url><lastmod>\t2025-01-01 </lastmod></url><URL></URL><url a='1'/></urlset>"
    sites = spark.createDataFrame(
        [(1, "https://a.example/x", []), (2, "https://b.example", ["https://b.example/1.xml", "https://b.example/2.xml"]), (3, "https://c.example", [])],
        "page_id long, url string, directives array<string>",
    )
    assert [tuple(r) for r in sitemap.requests(sites).where("page_id < 3").orderBy("page_id", "pos").collect()] == [
        (1, 0, "https://a.example/sitemap.xml"), (2, 0, "https://b.example/1.xml"), (2, 1, "https://b.example/2.xml")
    ]
    fetched = spark.createDataFrame(
        [(1, 0, 200, body, None), (2, 1, 200, body, None), (2, 0, 404, "no", None), (3, 0, None, None, "timeout after 10.0s")],
        "page_id long, pos int, http_status int, text string, error string",
    )
    got = {r.page_id: r for r in sitemap.check(sites, fetched).collect()}
    assert (got[1].url_count, got[1].last_modified, got[1].source, got[1].sitemap_url) == (2, "2025-01-01", "default-path", "https://a.example/sitemap.xml")
    assert got[2].sitemap_url == "https://b.example/2.xml" and got[2].source == "robots.txt"
    assert (got[3].sitemap_exists, got[3].sitemap_url, got[3].source) == (False, None, "absent")


def test_llms_txt(spark):
    rows = [(1, "https://a.example/x", 200, "hi", None), (2, "https://a.example", 200, " \n", None), (3, "https://a.example", 200, "", None), (4, "https://a.example", 404, "no", None), (5, "https://a.example", None, None, "refused")]
    got = sitemap.llms_txt(spark.createDataFrame(rows, "page_id long, url string, http_status int, text string, error string")).orderBy("page_id").collect()
    assert [(r.llms_exists, r.has_content) for r in got] == [(True, True), (True, False), (False, False), (False, False), (False, False)]
    assert {r.llms_url for r in got} == {"https://a.example/llms.txt"}


def page(spark, html):
    return spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ('{"@type":"Article"}', (True, False, 1, ["Article"])),
        ('[{"@type":"WebPage"},{"@type":["A","B"]}]', (True, False, 2, ["A", "B", "WebPage"])),
        ('{"@type":"X","@graph":[{"@type":"Y"}]}', (True, False, 1, ["Y"])),
        ("{oops", (True, True, 0, [])),
        ('{"a":1} x', (True, True, 0, [])),
        ("  ", (True, False, 0, [])),
        ("7", (True, False, 0, [])),
    ],
)
def test_json_ld(spark, block, want):
    for quoted in ('"application/ld+json"', "'application/ld+json'", "application/ld+json"):
        r = structure.json_ld(page(spark, f"<head><!-- <script type={quoted}>7</script> --><script async type={quoted}>{block}</script></head>")).collect()[0]
        assert (r.present, r.malformed, r.schema_count, r.types) == want


def test_no_json_ld(spark):
    assert not structure.json_ld(page(spark, "<p>")).collect()[0].present
    assert not structure.json_ld(page(spark, None)).collect()[0].present


def test_meta(spark):
    html = "<title> A &amp; B </title><META content='d' NAME='Description'><meta property=og:title content=x><meta name='robots' content='NoIndex'><link href='https://A.example' rel=\"canonical\">"
    r = structure.meta_tags(page(spark, html)).collect()[0]
    assert (r.title, r.description, r.og_title, r.og_description, r.canonical, r.noindex, r.noarchive) == ("A & B", "d", "x", None, "https://A.example", True, False)
    c = structure.canonical_check(structure.meta_tags(page(spark, html))).collect()[0]
    assert c.present and c.self_referential
    odd = "<title>it&#39;s&nbsp;</title><!-- <title>no</title> --><link rel='nofollow canonical' href=''>"
    c = structure.canonical_check(structure.meta_tags(page(spark, odd))).collect()[0]
    assert (c.present, c.canonical_url, c.self_referential) == (True, "", False)
    assert structure.meta_tags(page(spark, odd)).collect()[0].title == "it's"
    empty = structure.meta_tags(page(spark, "<meta name='description'>")).collect()[0]
    assert empty.description == "" and empty.title is None


@pytest.mark.parametrize(
    ("html", "n"), [("<h1>a</h1><h2>b</h2><h3>c</h3>", 0), ("<h1>a</h1><h3>c</h3><h3>d</h3>", 1), ("<h2>a</h2>", 2), ("", 1), ("<h1>a</h1><h1>b</h1>", 1), ("<h3>a</h3><h1>b</h1>", 1), ("<h1>a</h1><!-- <h1>b</h1><h5>c</h5> -->", 0), ("<script>'<h1>x</h1>'</script><h1>a</h1>", 0)]
)
def test_heading_issues(spark, html, n):
    r = structure.headings(page(spark, html or "<p>")).collect()[0]
    assert len(r.hierarchy_issues) == n


def test_heading_texts(spark):
    r = structure.headings(page(spark, "<h1> A <b> b </b>&hellip; </h1><H2 class=x>" + "y" * 200 + "</H2>")).collect()[0]
    assert [(h.tag, h.text) for h in r.headings] == [("h1", "Ab\u2026"), ("h2", "y" * 120)]


def test_failed_page_has_no_hierarchy_issues(spark):
    assert structure.check(page(spark, None)).collect()[0].hierarchy_issues == []
    assert content.check(page(spark, None)).collect()[0].quality_label.startswith("unavailable")


def main(html):
    return pages.main_content(pages.Tree(html).root)


def test_main_content():
    body = "word " * 40
    assert main(f"<nav>x</nav><article><p>{body}<p>tail</article>") == ((body + "tail"), False)
    assert main(f"<div class='sidebar'>no</div><div><p>{body}</p></div><p>x</p>") == (body.strip(), False)
    assert main("<script>var a</script><b>hi</b> there") == ("hi there", True)
    assert main("") == ("", True)
    assert main("<main class='shadow'>a</main>") == ("a", False)
    assert main("<![if x]>a") is not None


def test_bundles_and_spa(spark):
    html = "<script src='/app.ab12.js'></script><script src=/jquery.js></script><script async src=/x.chunk.js></script><!-- <script src='/bundle.js'></script> -->"
    r = content.bundles(page(spark, html)).select("bundles", content.likely_spa(F.lit(99), F.lit(True)), content.likely_spa(F.lit(100), F.lit(True))).collect()[0]
    assert list(r) == [["/app.ab12.js", "/x.chunk.js"], True, False]


def test_rendered_pages(spark):
    app = "<div id=root></div><script src='/bundle.js'></script>"
    rows = [(1, "u", app, "<main>" + "w " * 300 + "</main>", None), (2, "u", app, None, "no browser"), (3, "u", "<p>" + "x " * 300, "<p>unused", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rendered_html string, render_error string")
    got = {r.page_id: r for r in content.check(df, render=True).collect()}
    assert (got[1].rendered_used, got[1].rendered_word_count, got[1].error) == (True, 300, None)
    assert (got[2].rendered_used, got[2].rendered_word_count, got[2].error) == (True, None, "rendering failed: no browser")
    assert (got[3].rendered_used, got[3].rendered_word_count, got[3].likely_spa) == (False, None, False)
    assert content.check(df).where("page_id = 1").collect()[0].error == d.RENDER_OFF


def test_markup_is_read_once(spark):
    from sitegauge import registry

    for name in ("eligibility_report", "issues_ranked", "score_breakdown", "fix_pack"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan, name


def probe_rows(refused=(), failed=()):
    return [(1, o, ua, c, None if ua in failed else 403 if ua in refused else 200, "timeout" if ua in failed else None) for o, ua, c, _ in d.BOTS]


SEARCH, TRAINING = [b[1] for b in d.SEARCH_BOTS], [b[1] for b in d.TRAINING_BOTS]


@pytest.mark.parametrize(
    ("refused", "failed", "anomaly", "word"),
    [([], [], False, "uniform"), (SEARCH + TRAINING, [], False, "uniform"), (SEARCH[:2], [], True, "search bots blocked (2/5)"), (TRAINING[:1], [], True, "training bots blocked (1/6)"),
     ([SEARCH[0], TRAINING[0]], [], True, "partial blocking: 2/11"), ([], [SEARCH[0], TRAINING[0]], False, "no significant")],
)
def test_anomaly_ladder(spark, refused, failed, anomaly, word):
    df = spark.createDataFrame(probe_rows(refused, failed), "page_id long, bot_ord int, user_agent string, category string, http_status int, error string")
    r = probes.anomaly(df).collect()[0]
    assert r.anomaly is anomaly and word in r.reason


def test_escalation(spark):
    df = spark.createDataFrame(probe_rows(SEARCH[:2]), "page_id long, bot_ord int, user_agent string, category string, http_status int, error string")
    geo = spark.createDataFrame([(1, 0, "us", 200), (1, 1, "eu", 403), (1, 2, "apac", None)], "page_id long, region_ord int, region string, status int")
    found = probes.anomaly(df)
    assert probes.escalation(found, geo).collect()[0].tier_reached == 3
    assert probes.escalation(found, geo, enabled=False).collect()[0].tier_reached == 1
    assert probes.escalation(found, geo, n_workers=0).collect()[0].skipped == d.SKIPPED_NO_WORKER
    assert probes.full_matrix(probes.escalation(found, geo), geo, d.bots(spark)).count() == 33
    assert probes.regions(["", "https://w"]) == [(0, "us", "https://w")]


def test_judgments(spark):
    raw = F.col("r")
    rows = spark.createDataFrame([("READABILITY: 5\nSUBSTANTIVENESS: 4/5\n CITABILITY: x 3\nREASONING: ok",), ("?",), (None,)], "r string")
    got = [tuple(r[0]) for r in rows.select(judgment.parse_quality(raw)).collect()]
    assert got == [(0.75, "high", "ok"), (0.5, "medium", "Could not parse LLM response"), (None, "unavailable", None)]
    rows = spark.createDataFrame([("CITATION_LIKELIHOOD: 2\nCITATION_LIKELIHOOD: 5",), ("n/a",), (None,)], "r string")
    assert [r[0][0] for r in rows.select(judgment.parse_citation(raw)).collect()] == [1.0, 0.5, None]


def test_ratings_round_as_python_does(spark):
    replies = [[*r] for n in range(1, 9) for r in {tuple(sorted(random.Random(s).choices(range(1, 6), k=n))) for s in range(60)}]
    rows = [("\n".join(f"CITABILITY: {x}" for x in own), round((sum(own) / len(own) - 1) / 4, 3)) for own in replies]
    df = spark.createDataFrame(rows, "r string, want double").select(judgment.parse_quality(F.col("r"))["score"].alias("got"), "want")
    assert df.where("got <> want").collect() == []


def test_legacy_parsers(spark):
    rows = spark.createDataFrame([("READABILITY: 9\nREASONING:",), ("no",), (None,)], "r string")
    got = [r[0] and tuple(r[0]) for r in rows.select(judgment.legacy_quality(F.col("r"))).collect()]
    assert got == [(2.0, "high", ""), (0.5, "medium", "Could not parse LLM response"), None]
    assert one(spark, "r string", ("CITATION_LIKELIHOOD: 4",), judgment.legacy_citation(F.col("r")))[0][0] == 0.75


def test_options():
    env = {"ENABLE_LLM": "True", "LLM_PROVIDER": "Groq", "GROQ_API_KEY": "", "GEO_WORKER_URL_EU": "https://w", "GEO_WORKER_URL_US": ""}
    o = Options.from_env(env)
    assert (o.enable_llm, o.provider, o.workers, o.enable_geo) == (True, "mock", ("https://w",), False)
    assert Options.from_env(env | {"GROQ_API_KEY": "hush"}).provider == "groq" and "hush" not in repr(Options(llm_keys={"groq": "hush"}))


CACHE = "id long, cache_key string, created_at double, score double, label string, reasoning string, provider string"


def test_cache(spark):
    rows = [(1, "k", 10.0, 0.1, "low", "r", "p"), (2, "k", 90000.0, 0.9, "high", "r", "p"), (3, "old", 5.0, 0.5, "medium", "r", "p")]
    cache = judgment.latest(spark.createDataFrame(rows, CACHE))
    asked = spark.createDataFrame([(1, "k", "?"), (2, "old", "?"), (3, "new", "?"), (4, "new", "?")], "page_id long, cache_key string, prompt string")
    seen = []

    def scorer(df):
        seen.append(sorted(r.cache_key for r in df.collect()))
        return df.select("cache_key", F.when(F.col("cache_key") == "new", "CITATION_LIKELIHOOD: 5\nREASONING: so").alias("raw"), F.when(F.col("cache_key") == "old", "x" * 200).alias("error"))

    judged = judgment.judge(asked, cache, F.lit(100000.0), "citation_likelihood", "groq", True, scorer)
    got = {r.page_id: r.judgment for r in judged.collect()}
    assert seen == [["new", "old"]] and (got[1].score, got[1].cached) == (0.9, True)
    assert (got[2].score, got[2].label, got[2].provider, got[2].reasoning) == (None, "unavailable", "mock", d.JUDGE_FAILED + "x" * 120)
    assert [(got[k].score, got[k].reasoning, got[k].provider) for k in (3, 4)] == [(1.0, "so", "groq")] * 2
    assert [(r.cache_key, r.score) for r in judgment.to_cache(judged, "citation_likelihood", F.lit(1.0)).collect()] == [("new", 1.0)]
    off = judgment.judge(asked, cache, F.lit(100000.0), "citation_likelihood", "groq", False, scorer).collect()
    assert {(r.judgment.score, r.judgment.reasoning) for r in off} == {(None, d.JUDGE_OFF)}


def signals(spark, search=5, **change):
    row = {"page_id": 1, "url": "https://a.example", "search_allowed": search, "training_allowed": 6, "search_denied": [], "training_denied": [], "n": 11, "n_lost": 0, "sitemap": (True, 2), "llms": (True,),
           "present": True, "malformed": False, "types": ["A"], "description": "long enough text", "og_title": "t", "og_description": "d", "h1_count": 1, "hierarchy_issues": [], "noindex": False, "robots_meta": None, "quality": None, "citation": None} | change
    schema = "page_id long, url string, search_allowed long, training_allowed long, search_denied array<string>, training_denied array<string>, n long, n_lost long, sitemap struct<exists:boolean,url_count:long>, llms struct<exists:boolean>, present boolean, malformed boolean, types array<string>, description string, og_title string, og_description string, h1_count long, hierarchy_issues array<string>, noindex boolean, robots_meta string, quality struct<score:double,label:string>, citation struct<score:double,label:string>"
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return scoring.totals(scoring.breakdown(spark.createDataFrame([tuple(row[n] for n in names)], schema)))


@pytest.mark.parametrize(
    ("search", "total", "gate"), [(5, 100.0, None), (4, 91.4, None), (3, 82.9, None), (2, 63.2, "reduced 15%"), (1, 45.0, "capped at 45"), (0, 45.0, "capped at 45")]
)
def test_gate(spark, search, total, gate):
    r = signals(spark, search).collect()[0]
    assert r.total == total and r.gate_applied is (gate is not None) and (gate is None or gate in r.gate_reason)
    assert not r.llm_available and r.max_possible == 70.0


def test_score_with_judgments_and_nothing(spark):
    r = signals(spark, quality=(0.5, "medium"), citation=(0.25, "low")).collect()[0]
    assert r.llm_available and r.total == 82.5 and r.verdict == "Excellent"
    low = signals(spark, 0, training_allowed=0, n_lost=11, sitemap=(False, None), llms=(False,), present=False, description=None, og_title=None, og_description="", h1_count=0, hierarchy_issues=["a", "b", "c"]).collect()[0]
    assert low.total == 0.0 and low.verdict == "Poor"
    hidden = signals(spark, noindex=True, robots_meta="noindex")
    assert hidden.collect()[0].total == round(55 / 70 * 100, 1)
    assert all(round(s * 30 / 5, 1) == signals(spark, s).select("items").collect()[0][0][0].earned for s in range(6))
    ranked = scoring.issues(hidden).orderBy("rank").collect()
    assert [r.points_lost for r in ranked] == [20.0, 15.0, 10.0] and ranked[0].severity == "critical"


def test_history(spark):
    rows = [(1, "u", "2025-01-01", 50.0, "Fair"), (2, "u", "2025-01-02", 80.0, "Excellent"), (3, "u", "2025-01-02", 70.0, "Good"), (4, "v", "2025-01-01", 10.0, "Poor")]
    df = spark.createDataFrame(rows, "id long, url string, t string, score double, verdict string").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    assert [(r.url, r.score) for r in history.latest(df).collect()] == [("u", 70.0), ("v", 10.0)]
    assert [r.id for r in history.for_url(df, "u", 2).collect()] == [3, 2]
    change = {r.url: (r.runs, r.delta, r.delta_text) for r in history.delta(df).collect()}
    assert change == {"u": (3, 20.0, "+20.0"), "v": (1, 0.0, "+0.0")}
    points = history.sparkline(df).orderBy("i").collect()
    assert [(p.x, p.y) for p in points] == [(4.0, 19.0), (130.0, 4.0), (256.0, 9.0)]
    assert history.recent_table(df).count() == 3


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/")
            self.end_headers()
            return
        refuse = "GPTBot" in self.headers["User-Agent"]
        self.send_response(403 if refuse else 200)
        self.end_headers()
        self.wfile.write("grüße".encode())

    def log_message(self, *a):
        pass


def test_fetch(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    sites = spark.createDataFrame([(1, base + "/"), (2, base + "/moved"), (3, "http://127.0.0.1:1/"), (4, "ftp:x"), (5, None)], "page_id long, url string")
    got = {r.page_id: r for r in fetch.pages(sites).collect()}
    assert (got[1].http_status, got[1].text, got[1].size, got[1].error) == (200, "grüße", 7, None)
    assert got[2].http_status == 200 and got[2].redirects == [base + "/moved"]
    assert all(got[k].http_status is None and got[k].error for k in (3, 4, 5))
    probed = {r.user_agent: r.http_status for r in fetch.probe(sites.where("page_id = 1")).collect()}
    assert probed["GPTBot"] == 403 and probed["Googlebot"] == 200 and len(probed) == 11
    server.shutdown()


ROBOTS = "User-agent:\tGPTBot\nDisallow:\t/\nSitemap: {base}/dead.xml\nSitemap:\t{base}/map.xml\n"
HTML = "<title>T</title><meta name=description content='a long description'><h1>x</h1><article>" + "word " * 200 + "</article>"


class Site(http.server.BaseHTTPRequestHandler):
    """A site that refuses search crawlers, workers that see it differently, and a model that answers."""

    asked = []

    def answer(self, status, body, kind="text/html"):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        base = f"http://127.0.0.1:{self.server.server_port}"
        files = {"/robots.txt": ROBOTS.format(base=base), "/map.xml": "<urlset><url></url><url></url></urlset>", "/llms.txt": "# x", "/": HTML}
        if any(ua in self.headers["User-Agent"] for ua in ("OAI-SearchBot", "PerplexityBot")):
            self.answer(403, "no")
        elif self.path in files:
            self.answer(200, files[self.path])
        else:
            self.answer(404, "no")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.startswith("/worker"):
            Site.asked.append((self.path, body["user_agent"]))
            self.answer(200, json.dumps({"status": 403 if self.path.endswith("eu") else 200, "blocked": self.path.endswith("eu")}))
        else:
            prompt = body["messages"][0]["content"]
            said = "CITATION_LIKELIHOOD: 4\nREASONING: y" if "cite" in prompt.split("\n")[0] else "READABILITY: 5\nSUBSTANTIVENESS: 4\nCITABILITY: 4\nREASONING: x"
            self.answer(200, json.dumps({"choices": [{"message": {"content": said}}]}))

    def log_message(self, *a):
        pass


def test_from_sites_to_reports(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    sites = spark.createDataFrame([(1, f"\t{base}/"), (2, "http://127.0.0.1:1")], "page_id long, url string")
    options = Options(
        enable_geo=True, enable_llm=True, llm_provider="groq", llm_keys={"groq": "k"}, llm_endpoints={"groq": f"{base}/chat"},
        workers=(f"{base}/worker-us", f"{base}/worker-eu"), page_timeout=5.0, probe_timeout=5.0,
    )
    cache = spark.createDataFrame([], CACHE)
    out = live.run(sites, str(tmp_path / "fetched"), options, cache, F.lit(1000.0))
    got = {r.page_id: (r, json.loads(r.report)) for r in out.reports.collect()}
    row, report = got[1]
    assert report["url"] == f"{base}/" and report["score"]["llm_available"] and report["score"]["total"] == row.total
    access = report["raw_evidence"]["access"]
    assert access["sitemap"] == {"exists": True, "url": f"{base}/map.xml", "url_count": 2, "last_modified": None, "source": "robots.txt"}
    assert access["llms_txt"]["has_content"] and access["robots"]["sitemap_directives"] == [f"{base}/dead.xml", f"{base}/map.xml"]
    assert [r["bot"] for r in access["ua_spoof"] if r["blocked"]] == ["OAI-SearchBot", "PerplexityBot"]
    assert [b["bot_name"] for b in report["per_bot_table"] if not b["robots_allowed"]] == ["GPTBot"]
    tiers = report["raw_evidence"]["empirical"]
    assert tiers["tier2"]["geo_anomaly_detected"] and [r["status"] for r in tiers["tier2"]["results"]] == [200, 403]
    assert len(tiers["tier3"]["results"]) == 22 and len(Site.asked) == 24
    assert report["raw_evidence"]["content"]["body_word_count"] == 200 and report["raw_evidence"]["content"]["llm"]["provider"] == "groq"
    breakdown = {x["label"]: x for x in report["score"]["breakdown"]}
    assert breakdown[d.SEARCH[0]]["evidence"]["per_bot"]["Googlebot"] == {"allowed": True, "disallowed_paths": []}
    assert breakdown[d.QUALITY[0]]["points_earned"] == round(0.833 * 20, 1) and breakdown[d.CITATION[0]]["points_earned"] == 7.5
    failed, report = got[2]
    assert report["raw_evidence"]["access"]["robots"]["parse_note"] == d.NO_ROBOTS and report["raw_evidence"]["content"]["fetch_error"]
    assert not report["score"]["llm_available"] or report["raw_evidence"]["content"]["llm"]["score"] is None
    assert sorted((r.call_type, r.score) for r in out.new_judgments.collect()) == [("citation_likelihood", 0.75), ("citation_likelihood", 0.75), ("content_quality", 0.833)]
    assert {r.filename for r in out.fix_pack.where("page_id = 1").collect()} == {"robots_txt_additions.txt", "json_ld_snippet.html"}
    server.shutdown()


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS gauge LOCATION '{tmp_path / 'wh'}'")
    for _ in range(2):
        sinks.create_tables(spark, "gauge.history", "gauge.cache")
    assert spark.table("gauge.cache").columns[0] == "cache_key" and spark.table("gauge.history").count() == 0
    spark.sql("DROP DATABASE gauge CASCADE")


def test_sinks(spark, tmp_path):
    reports = spark.createDataFrame([("u", "2025-01-01 00:00:00", 1.0, "Poor", "{}")], "url string, t string, score double, verdict string, report string").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    for _ in range(2):
        sinks.append_history(reports, str(tmp_path / "h"))
    assert sinks.read_history(spark, str(tmp_path / "h")).count() == 2
    pack = spark.createDataFrame([(1, "a.txt", "x")], "page_id long, filename string, content string")
    sinks.write_fix_pack(pack, str(tmp_path / "f"))
    assert (tmp_path / "f" / "filename=a.txt").is_dir()
    schema = "id long, cache_key string, created_at double, score double"
    sinks.upsert_cache(spark.createDataFrame([(1, "k", 1.0, 0.1)], schema), spark.createDataFrame([(2, "k", 2.0, 0.2)], schema), str(tmp_path / "c"))
    assert [r.score for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [0.2]


def test_streams(spark, tmp_path):
    rows = [(1, "u", "2025-01-01 00:10:00", 50.0, "Fair"), (1, "u", "2025-01-01 00:10:00", 50.0, "Fair"), (2, "u", "2025-01-01 00:20:00", 70.0, "Good")]
    df = spark.createDataFrame(rows, "id long, url string, t string, score double, verdict string").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    asked = stream.select(F.lit("k").alias("cache_key"), "id", "timestamp")
    q = streams.cached_judgments(asked, ttl=300).writeStream.format("memory").queryName("judged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.cached for r in spark.table("judged").collect()) == [False, False, True]
    q = streams.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.mean_score) for r in spark.table("hours").collect()] == [(3, pytest.approx(170 / 3))]
