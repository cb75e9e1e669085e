"""Site relations derived from the tables pages and events, where no live fetch exists.

Each is a DataFrame of the schema a fetcher would deliver, and the same SQL
serves as a CTE of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import BOTS, bots

HTML = """
 replace(replace(CASE page_id % 6
   WHEN 1 THEN replace(html,'</h1>','</h1><h2>A &#38; <b>c</b> &hellip;</h2><h3>B</h3>')
   WHEN 2 THEN replace(html,'</h1>','</h1><h3>Skip</h3>')
   WHEN 3 THEN replace(html,'</h1>','</h1><h1>Second</h1>')
   WHEN 4 THEN replace(html,'</h1>','</h1><h2>A</h2><h4>D</h4><h4>E</h4>')
   WHEN 5 THEN replace(replace(html,'<h1>','<h2>'),'</h1>','</h2>')
   ELSE replace(html,'</h1>','</h1><!-- <h1>Gone</h1><h6>Gone</h6> -->') END,
   '</title>', CASE WHEN page_id % 7 = 1 THEN ' &#39;x&#39; </title>' ELSE '</title>' END), '</head>', concat(
 CASE page_id % 4 WHEN 1 THEN '<meta name="description" content="A reasonably long page description.">'
   WHEN 2 THEN '<meta content='' short'' NAME=Description>' WHEN 3 THEN '<meta name="description" content="">' ELSE '' END,
 CASE WHEN page_id % 3 < 2 THEN '<meta property="og:title" content="T">' ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN '<meta property="og:description" content="D">' ELSE '' END,
 CASE page_id % 13 WHEN 0 THEN '<meta name="robots" content="noindex, nofollow">' WHEN 1 THEN '<meta name="Robots" content="NOARCHIVE">' ELSE '' END,
 CASE page_id % 5 WHEN 1 THEN concat('<link rel="canonical" href="',url,'">') WHEN 2 THEN '<link rel="canonical" href="https://other.example/p">'
   WHEN 3 THEN concat('<link href=''',url,'/'' rel=''canonical''>') WHEN 4 THEN concat('<link rel="canonical" href="',upper(url),'?q=1">')
   ELSE CASE WHEN page_id % 10 = 5 THEN '<link rel=canonical href="">' ELSE '<!-- <link rel="canonical" href="/old"> -->' END END,
 CASE page_id % 8 WHEN 1 THEN '<script type=''application/ld+json''>{"@type":"Article"}</script>'
   WHEN 2 THEN '<script type="application/ld+json">[{"@type":"WebPage"},{"@type":"Person"}]</script>'
   WHEN 3 THEN '<script type=application/ld+json>{"@type":"Ignored","@graph":[{"@type":"WebPage"},{"@type":"Organization"}]}</script>'
   WHEN 4 THEN '<script type="application/ld+json">{not json</script>'
   WHEN 5 THEN '<script type="application/ld+json">{"@type":["NewsArticle","Article"]}</script>'
   WHEN 6 THEN '<script type="application/ld+json">{oops</script><script type="application/ld+json">{"@type":"WebPage"}</script>'
   WHEN 7 THEN '<script type="application/ld+json">  </script>' ELSE '<!-- <script type="application/ld+json">{"@type":"Gone"}</script> -->' END,
 CASE page_id % 10 WHEN 0 THEN '<script src=/static/js/main.a1b2.chunk.js></script>' WHEN 3 THEN '<script async src=''/_next/static/x.js''></script>'
   WHEN 5 THEN '<script src="/jquery.min.js"></script>' ELSE '' END,
 '</head>'))"""
#: Pages without an article: boilerplate by element, class and id, paragraphs under one parent, and pages with hardly any text.
PLAIN_HTML = """concat('<html><body class="nav-open"><header>top</header><nav><p>go there</p></nav><div class="Cookie-bar"><p>',repeat('no ',60),'</p></div>',
 '<div id="text"><p>', repeat('alpha beta ', cast(page_id % 25 AS int)), '</p><p>gamma</p></div><div><p>side</p></div><p id="top-menu">menu</p>',
 CASE WHEN page_id % 3 = 0 THEN '<script src="/app.1f.js"></script>' ELSE '' END, '<noscript>off</noscript><footer>end</footer></body></html>')"""
PROBE_FAILS = "(page_id*7+bot_ord)%29=0 OR (page_id%10=0 AND bot_ord IN (2,8))"
PROBE_STATUS = f"""CASE WHEN {PROBE_FAILS} THEN NULL
   WHEN page_id%5=1 AND category='search' THEN 403 WHEN page_id%5=2 AND category='training' THEN 429
   WHEN page_id%5=3 AND (page_id+bot_ord)%3=0 THEN 503 WHEN page_id%5=4 THEN 403 ELSE 200 END"""
PROBE_ERROR = f"CASE WHEN {PROBE_FAILS} THEN 'timeout after 15.0s' END"
ROBOTS_STATUS = "CASE WHEN page_id%7=0 THEN 404 WHEN page_id%49=1 THEN NULL ELSE 200 END"
ROBOTS_TEXT = """CASE page_id%7 WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *
Allow: /
'
 WHEN 2 THEN 'User-agent: *
Allow: /

User-agent: GPTBot
User-agent: ClaudeBot
Disallow: /

User-agent: CCBot
Disallow: /
Sitemap: https://s.example/a.xml
SITEMAP: https://s.example/b.xml
'
 WHEN 3 THEN 'User-agent: OAI-SearchBot
Disallow: /
User-agent: Claude-SearchBot
Disallow: /

User-agent: PerplexityBot
Disallow: /
'
 WHEN 4 THEN '# all closed
User-agent: *
Disallow: /
Crawl-delay: 10

User-agent: Googlebot
Disallow:
'
 WHEN 5 THEN 'User-agent: Google
Allow: /en/
Disallow: /
Crawl-delay: 2.5

User-agent: *
Disallow: /private/ # inline
Disallow: /fr/
Disallow:\t/%70age
Sitemap:\thttps://s.example/c.xml
'
 ELSE 'Disallow: /orphan

User-agent: GPTBot

User-agent:\tOAI-SearchBot
User-agent: Claude-SearchBot
User-agent :\tPerplexityBot
User-agent: Applebot-Extended
Disallow:\t/
' END"""
GEO_STATUS = "CASE WHEN (page_id+region_ord)%13=0 THEN NULL WHEN page_id%4=0 AND region='eu' THEN 403 ELSE 200 END"
#: What came back from the first and, where robots.txt names two, the second place to look for a sitemap; and from /llms.txt.
SITEMAPS = [
    ("true", "CASE WHEN page_id%28=9 THEN NULL WHEN page_id%4=3 THEN 404 ELSE 200 END",
     "CASE WHEN page_id%28=9 THEN NULL WHEN page_id%4=3 THEN 'not found' WHEN page_id%2=0 THEN '<urlset><URL><loc>a</loc><lastmod> 2025-01-01 </lastmod></url><url><loc>b</loc></url></urlset>' ELSE '<sitemapindex></sitemapindex>' END",
     "CASE WHEN page_id%28=9 THEN 'timeout after 10.0s' END"),
    ("page_id%7=2", "CASE WHEN page_id%3=0 THEN 500 ELSE 200 END", "'<urlset><url><lastmod>\t2025-02-02 </lastmod></url></urlset>'", "CAST(NULL AS varchar(9))"),
]
LLMS_STATUS = "CASE page_id%3 WHEN 0 THEN 200 WHEN 1 THEN 404 END"
LLMS_TEXT = "CASE WHEN page_id%3=2 THEN NULL WHEN page_id%9=3 THEN ' \t' WHEN page_id%9=6 THEN '' ELSE '# llms' END"
LLMS_ERROR = "CASE WHEN page_id%3=2 THEN 'timeout after 10.0s' END"
QUALITY_RAW = """CASE WHEN page_id%11=0 THEN NULL WHEN page_id%11=1 THEN 'Sorry, I cannot help.' WHEN page_id%11=2 THEN
 'READABILITY: 1
SUBSTANTIVENESS: 1
CITABILITY: 1
CITABILITY: 2
REASONING:\t' ELSE
 concat('READABILITY: ',cast(1+page_id%5 AS varchar(9)),'
SUBSTANTIVENESS: ',cast(1+page_id%4 AS varchar(9)),'
  CITABILITY: ',cast(1+page_id%3 AS varchar(9)),'/5
REASONING: r',cast(page_id AS varchar(9))) END"""
CITATION_RAW = """CASE WHEN page_id%11=0 THEN NULL WHEN page_id%7=0 THEN 'n/a' ELSE concat('CITATION_LIKELIHOOD: ',cast(1+page_id%5 AS varchar(9)),'
REASONING: c') END"""
HISTORY_URL = "concat('https://site-',cast(user_id AS varchar(20)),'.example')"
HISTORY_SCORE = "least(value, 100e0)"
HISTORY_VERDICT = """CASE WHEN least(value,100e0)>=80 THEN 'Excellent' WHEN least(value,100e0)>=60 THEN 'Good'
 WHEN least(value,100e0)>=40 THEN 'Fair' ELSE 'Poor' END"""
_BOT_ROWS = ",".join(f"({o},'{ua}','{c}','{p}')" for o, ua, c, p in BOTS)
REGION_ROWS = "(0,'us'),(1,'eu'),(2,'apac')"

#: The same relations for DuckDB.
SQL = {
    "bots": f"SELECT * FROM (VALUES {_BOT_ROWS}) AS t(bot_ord,user_agent,category,provider)",
    "site_html": f"SELECT page_id, url, {HTML} AS html FROM pages",
    "ua_probe": f"SELECT page_id, bot_ord, user_agent, category, {PROBE_STATUS} AS http_status, {PROBE_ERROR} AS error FROM pages CROSS JOIN bots",
    "robots_txt": f"SELECT page_id, url, {ROBOTS_STATUS} AS http_status, {ROBOTS_TEXT} AS text FROM pages",
    "geo_probe": f"SELECT page_id, region_ord, region, {GEO_STATUS} AS status FROM pages CROSS JOIN (SELECT * FROM (VALUES {REGION_ROWS}) AS v(region_ord,region)) r",
    "plain_html": f"SELECT page_id, url, {PLAIN_HTML} AS html FROM pages",
    "sitemap_fetch": " UNION ALL ".join(f"SELECT page_id, {i} AS pos, {status} AS http_status, {text} AS text, {error} AS error FROM pages WHERE {there}" for i, (there, status, text, error) in enumerate(SITEMAPS)),
    "llms_fetch": f"SELECT page_id, url, {LLMS_STATUS} AS http_status, {LLMS_TEXT} AS text, {LLMS_ERROR} AS error FROM pages",
    "llm_raw": f"SELECT page_id, url, {QUALITY_RAW} AS quality_raw, {CITATION_RAW} AS citation_raw FROM pages",
    "history": f'SELECT event_id AS id, {HISTORY_URL} AS url, ts AS "timestamp", {HISTORY_SCORE} AS score, {HISTORY_VERDICT} AS verdict FROM events',
}


def _for_bot(sql: str, bot_ord: int, category: str) -> str:
    return sql.replace("bot_ord", str(bot_ord)).replace("category", f"'{category}'")


class Site:
    """The site relations of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ids(self) -> DataFrame:
        """Only id and url: the html column never leaves the file."""
        return self.table("pages").select("page_id", "url")

    def site_html(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", F.expr(HTML).alias("html"))

    def ua_probe(self) -> DataFrame:
        rows = self.ids().crossJoin(F.broadcast(bots(self.spark)))
        return rows.select("page_id", "bot_ord", "user_agent", "category", F.expr(PROBE_STATUS).alias("http_status"), F.expr(PROBE_ERROR).alias("error"))

    def robots_txt(self) -> DataFrame:
        return self.ids().select("page_id", "url", F.expr(ROBOTS_STATUS).alias("http_status"), F.expr(ROBOTS_TEXT).alias("text"))

    def geo_probe(self) -> DataFrame:
        regions = self.spark.sql(f"SELECT * FROM (VALUES {REGION_ROWS}) AS v(region_ord, region)")
        return self.ids().crossJoin(F.broadcast(regions)).select("page_id", "region_ord", "region", F.expr(GEO_STATUS).alias("status"))

    def plain_html(self) -> DataFrame:
        return self.ids().select("page_id", "url", F.expr(PLAIN_HTML).alias("html"))

    def sitemap_fetch(self) -> DataFrame:
        parts = [
            self.ids().where(F.expr(there)).select("page_id", F.lit(i).alias("pos"), F.expr(status).alias("http_status"), F.expr(text).alias("text"), F.expr(error).cast("string").alias("error"))
            for i, (there, status, text, error) in enumerate(SITEMAPS)
        ]
        return parts[0].unionByName(parts[1])

    def llms_fetch(self) -> DataFrame:
        return self.ids().select("page_id", "url", F.expr(LLMS_STATUS).alias("http_status"), F.expr(LLMS_TEXT).alias("text"), F.expr(LLMS_ERROR).alias("error"))

    def wide(self, html: bool = True) -> DataFrame:
        """One row a site with all that a fetcher would have brought: what plans.analyze reads."""
        looked = F.array(*(
            F.when(F.expr(there), F.struct(F.lit(i).alias("pos"), F.expr(status).alias("http_status"), F.expr(text).alias("text"), F.expr(error).cast("string").alias("error")))
            for i, (there, status, text, error) in enumerate(SITEMAPS)
        ))
        probed = F.array(*(
            F.struct(
                F.lit(o).alias("bot_ord"), F.lit(ua).alias("user_agent"), F.lit(c).alias("category"), F.expr(_for_bot(PROBE_STATUS, o, c)).alias("http_status"),
                F.lit(0).cast("long").alias("size"), F.lit(0).alias("redirect_count"), F.expr(_for_bot(PROBE_ERROR, o, c)).alias("error"),
            )
            for o, ua, c, _ in BOTS
        ))
        pages = self.table("pages").select("page_id", "url", F.expr(HTML).alias("html")) if html else self.ids()
        none = F.lit(None).cast("string")
        return pages.select(
            *pages.columns, none.alias("fetch_error"), F.expr(ROBOTS_STATUS).alias("robots_status"), F.expr(ROBOTS_TEXT).alias("robots_text"),
            F.expr(f"CASE WHEN ({ROBOTS_STATUS}) IS NULL THEN 'timeout after 10.0s' END").alias("robots_error"),
            F.filter(looked, lambda x: x.isNotNull()).alias("sitemaps"), F.expr(LLMS_STATUS).alias("llms_status"), F.expr(LLMS_TEXT).alias("llms_text"),
            F.expr(LLMS_ERROR).alias("llms_error"), probed.alias("probes"), F.expr(QUALITY_RAW).alias("quality_raw"), F.expr(CITATION_RAW).alias("citation_raw"),
        )

    def llm_raw(self) -> DataFrame:
        return self.ids().select("page_id", "url", F.expr(QUALITY_RAW).alias("quality_raw"), F.expr(CITATION_RAW).alias("citation_raw"))

    def history(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.expr(HISTORY_URL).alias("url"), F.col("ts").alias("timestamp"),
            F.expr(HISTORY_SCORE).alias("score"), F.expr(HISTORY_VERDICT).alias("verdict"),
        )
