"""Queries over pages that are made, in the query, from rows of the driver's tables, so that SQL knows what must come out.

The raw pages of the driver have one shape.  Site extractors, metadata, API answers, hidden elements, streamed
segments, images and odd input need others: each table here holds one kind of page per row, ``{name}`` and ``{key}`` in it stand
for a customer's name and key, and the expected values stand beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.extract import extract
from .operators.pipeline import Options
from .plans import facts, nodes
from .sources.shared import stored

#: A comment of ten words and more, which a site's page needs to count without its API.
SAID = "{name} says that this is a comment of more than ten words in all"
_POST = f'<div class="question"><div class="js-post-body"><p>{SAID}</p></div><div class="user-details"><a>asker {{key}}</a></div></div><div class="answer accepted-answer"><span class="js-vote-count">3</span><div class="js-post-body"><p>answer</p></div><div class="user-details"><a>helper</a></div></div>'
_GH_ISSUE = f'<div data-testid="issue-viewer-issue-container"><a data-testid="issue-body-header-author" href="/u{{key}}">u{{key}}</a><div data-testid="issue-body-viewer"><div data-testid="markdown-body"><p>{SAID}</p></div></div></div><div data-wrapper-timeline-id="1"><div class="react-issue-comment"><a data-testid="avatar-link" href="/helper"></a><relative-time datetime="2024-01-02T0"></relative-time><div data-testid="markdown-body">reply</div></div></div>'
_GH_PULL = f'<div id="pullrequest-1"><a class="author">u{{key}}</a><div class="comment-body markdown-body"><p>{SAID}</p></div></div><div class="timeline-comment"><a class="author">helper</a><div class="comment-body markdown-body">reply</div></div>'
_HN = f'<table class="fatitem"><tr class="athing"><td class="titleline"><a href="https://a.b/{{key}}">{{name}} story</a></td></tr><tr><td><a class="hnuser">u{{key}}</a><span class="age" title="2024-01-02T03:04:05"></span></td></tr></table><table><tr class="athing comtr" id="7"><td class="ind"><img width="40"></td><td><a class="hnuser">you</a><div class="commtext">{SAID}</div></td></tr></table>'
_HN_COMMENT = f'<table class="fatitem"><tr class="athing"><td><a class="hnuser">u{{key}}</a><span class="onstory">on: x</span><div class="commtext">{SAID}</div></td></tr></table>'
_OLD_REDDIT = f'<div class="thing link" data-author="u{{key}}" data-subreddit="spark"><a class="title">{{name}} post</a><div class="usertext-body"><div class="md"><p>{SAID}</p></div></div></div><div class="commentarea"><div class="sitetable"><div class="thing comment" data-author="c"><div class="usertext-body"><div class="md">reply</div></div></div></div></div>'
_NEW_REDDIT = f'<shreddit-post author="u{{key}}"><h1>{{name}} post</h1><div slot="text-body"><p>{SAID}</p></div></shreddit-post><shreddit-comment author="c" depth="1" score="4"><div slot="comment">reply</div></shreddit-comment>'
_LOBSTERS = f'<a class="u-repost-of" href="https://a.b/{{key}}">{{name}} link</a><div class="story_text"><p>{SAID}</p></div>'
_X_ARTICLE = f'<div itemprop="author"><meta itemprop="name" content="{{name}}"><meta itemprop="additionalName" content="u{{key}}"></div><div data-testid="twitter-article-title">{{name}} article</div><div data-testid="twitterArticleRichTextView"><p>{SAID}</p></div>'
_CHATGPT = f'<title>{{name}} - ChatGPT</title><article data-testid="conversation-turn-1"><h5 class="sr-only">You said</h5><div class="markdown">{SAID}</div></article><article data-testid="conversation-turn-2"><div class="markdown">Hello</div></article>'
_CLAUDE = f'<title>Claude</title><div data-testid="user-message">{{name}}</div><div class="font-claude-response">{SAID}</div>'
_GEMINI = f'<title>{{name}} - Google Gemini</title><div class="conversation-container"><user-query>q</user-query><model-response>{SAID}</model-response></div>'
_ROW = "relative group flex flex-col justify-center w-full"
_GROK = f'<title>{{name}} | Grok</title><div class="{_ROW} items-end">q</div><div class="{_ROW} items-start">{SAID}</div>'
_BBCODE = "<div data-partnereventstore='[{\"event_name\":\"{name} event\",\"announcement_body\":{\"body\":\"[b]bold[/b] [list][*]one[*]two[/list]\"}}]'></div><div data-groupvanityinfo='[{\"group_name\":\"group {key}\"}]'></div>"
_NOTE = f'<meta property="og:title" content="{{name}} (@u{{key}})"><meta property="og:site_name" content="Substack"><div class="feedCommentBody-1"><div class="ProseMirror FeedProseMirror"><p>{SAID}</p></div></div>'

#: (address, page, extractor, title, author, site, part of the content) by kind.
SITES = (
    ("https://github.com/o/r/issues/{key}", "<title>{name} fails · Issue #{key} · o/r</title>" + _GH_ISSUE, "github", "{name} fails · Issue #{key}", "u{key}", "GitHub", "reply"),
    ("https://github.com/o/r/pull/{key}", "<title>{name} fix · Pull Request · o/r</title>" + _GH_PULL, "github", "{name} fix · Pull Request", "u{key}", "GitHub", "reply"),
    ("https://news.ycombinator.com/item?id={key}", _HN, "hackernews", "{name} story", "u{key}", "Hacker News", "item?id=7"),
    ("https://news.ycombinator.com/item?id={key}", _HN_COMMENT, "hackernews", None, "u{key}", "Hacker News", SAID),
    ("https://old.reddit.com/r/spark/comments/{key}", _OLD_REDDIT, "reddit", "{name} post", "u{key}", "r/spark", "reply"),
    ("https://www.reddit.com/r/spark/comments/{key}", _NEW_REDDIT, "reddit", "{name} post", "u{key}", "r/spark", "reply"),
    ("https://stackoverflow.com/questions/{key}/x", '<div id="question-header"><h1>{name} asks</h1></div>' + _POST, "stackoverflow", "{name} asks", "asker {key}", "Stack Overflow", "3 votes, accepted"),
    ("https://cooking.stackexchange.com/questions/{key}/x", '<div id="question-header"><h1>{name} asks</h1></div>' + _POST, "stackoverflow", "{name} asks", "asker {key}", "Cooking Stack Exchange", "answer"),
    ("https://lobste.rs/s/a{key}/x", _LOBSTERS, "lobsters", "{name} link", None, "Lobsters", "https://a.b/{key}"),
    ("https://x.com/u{key}/article/{key}", _X_ARTICLE, "twitter", "{name} article", "{name} (@u{key})", "X (Twitter)", SAID),
    ("https://wiki.c2.com/?PageName", f'<div class="page" data-title="PageName"><p>{SAID}</p></div>', "c2wiki", "Page Name", None, "C2 Wiki", SAID),
    ("https://chatgpt.com/c/{key}", _CHATGPT, "conversation", "{name}", None, "ChatGPT", "Hello"),
    ("https://claude.ai/chat/{key}", _CLAUDE, "conversation", "{name}", None, "Claude", SAID),
    ("https://gemini.google.com/app/{key}", _GEMINI, "conversation", "{name}", None, "Gemini", SAID),
    ("https://grok.com/chat/{key}", _GROK, "conversation", "{name}", None, "Grok", SAID),
    ("https://store.example.com/news/{key}", _BBCODE, "bbcode", "{name} event", "group {key}", None, "<strong>bold</strong>"),
    ("https://{key}.substack.com/note/{key}", _NOTE, "substack", None, "{name}", "Substack", SAID),
)
#: (address, API address, API answer, extractor, title, author, site, part of the content): pages without content of their own.
ANSWERS = (
    ("https://news.ycombinator.com/item?id={key}", "https://hacker-news.firebaseio.com/v0/item/{key}.json", '{"type": "story", "title": "{name}", "by": "u{key}", "url": "https://a.b/{key}", "time": 86400}', "hackernews", "{name}", "u{key}", "Hacker News", "https://a.b/{key}"),
    ("https://github.com/o/r/issues/{key}", "https://api.github.com/repos/o/r/issues/{key}", '{"title": "{name}", "body": "it **fails** for {name}", "user": {"login": "u{key}"}, "labels": [{"name": "L"}], "created_at": "2024-01-02T0"}', "github", "{name}", "u{key}", "GitHub", "<strong>fails</strong>"),
    ("https://lobste.rs/s/a{key}/x", "https://lobste.rs/s/a{key}.json", '{"title": "{name}", "url": "https://a.b/{key}", "submitter_user": {"username": "u{key}"}, "comments": [{"comment": "<p>c</p>", "commenting_user": {"username": "w"}, "depth": 0, "score": 2}], "created_at": "2024-01-02T0"}', "lobsters", "{name}", "u{key}", "Lobsters", "2 points"),
    ("https://x.com/u{key}/status/{key}", "https://publish.twitter.com/oembed?url=https%3A%2F%2Fx.com%2Fu{key}%2Fstatus%2F{key}", '{"html": "<blockquote><p>{name} posts</p></blockquote>", "author_name": "{name}"}', "twitter", None, "{name}", "X (Twitter)", "{name} posts"),
    ("https://wiki.c2.com/?Page{key}", "https://c2.com/wiki/remodel/pages/Page{key}", "{\"text\": \"{name} sees OtherPage and ''this''\"}", "c2wiki", None, None, "C2 Wiki", "<em>this</em>"),
    ("https://stackoverflow.com/questions/{key}", "https://api.stackexchange.com/2.3/questions/{key}?site=stackoverflow&filter=withbody&order=desc&sort=activity", '{"items": [{"title": "{name}", "body": "<p>{name} asks</p>", "owner": {"display_name": "u{key}"}}]}', "stackoverflow", "{name}", "u{key}", "Stack Overflow", "{name} asks"),
)
_NUMBER = "9" * 5000
#: Pages that would stop a parser, a number or a column; each keeps its text.
ODD = (
    f'<img src=a.png width="{_NUMBER}">', f'<ol start="{_NUMBER}"><li>x</li></ol>', f"<p>&#{_NUMBER};</p>", '<script type="application/ld+json">{"name": "\\ud800"}</script>',
    f'<script type="application/ld+json">{{"n": {_NUMBER}}}</script>', "<div>" * 600, "<b>x" * 100, '<script type="application/ld+json">' + "[" * 30_000 + "</script>",
)


def _filled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{name}"), F.col("c_name")), F.lit("{key}"), F.col("c_custkey").cast("string"))


def _made(spark: SparkSession, sf_dir: str, kinds: tuple, names: str) -> DataFrame:
    """Each customer with the kind of page that its key says (``names``: columns of ``kinds``)."""
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(kinds)], f"kind long, {names}")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").withColumn("kind", F.pmod("c_custkey", F.lit(len(kinds))))
    return customers.join(F.broadcast(table), "kind")  # one row per kind


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site extractor over pages of its site."""
    rows = _made(spark, sf_dir, SITES, "url string, html string, e string, t string, a string, s string, part string")
    rows = rows.select("c_custkey", _filled(F.col("url")).alias("url"), _filled(F.concat(F.lit("<body>"), "html")).alias("html"), _filled(F.col("part")).alias("part"), F.col("t").isNotNull().alias("titled"))
    p = extract(rows)
    return p.select("c_custkey", "page.extractor_type", F.when(F.col("titled"), F.col("page.title")).alias("title"), "page.author", "page.site", F.contains("page.content", "part").alias("found"), "page.error")


def site_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that API answers complete: a join by address."""
    rows = _made(spark, sf_dir, ANSWERS, "url string, api string, body string, e string, t string, a string, s string, part string")
    rows = stored(rows.select("c_custkey", _filled(F.col("url")).alias("url"), _filled(F.col("api")).alias("api"), _filled(F.col("body")).alias("body"), _filled(F.col("part")).alias("part"), F.col("t").isNotNull().alias("titled")))
    payloads = rows.select(F.col("api").alias("url"), "body")
    p = extract(rows.drop("api", "body").withColumn("html", F.lit("<body></body>")), api_payloads=payloads)
    return p.select("c_custkey", "page.extractor_type", F.when(F.col("titled"), F.col("page.title")).alias("title"), "page.author", "page.site", F.contains("page.content", "part").alias("found"), "page.error")


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long numbers, lone surrogates, deep nesting: every page gives its text, and no error."""
    table = F.broadcast(spark.createDataFrame(list(enumerate(ODD)), "kind long, odd string"))  # one row per kind
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("kind", F.pmod("s_suppkey", F.lit(len(ODD)))).join(table, "kind")
    html = F.concat(F.lit("<html><head><title>"), "s_name", F.lit("</title></head><body><article><p>The text of "), "s_name", F.lit(" is here to stay.</p>"), "odd", F.lit("</article></body></html>"))
    rows = rows.select("s_suppkey", "s_name", html.alias("html")).repartition(spark.sparkContext.defaultParallelism)
    p = extract(rows, url_col=None)
    return p.select("s_suppkey", "page.title", F.contains("page.content", F.concat(F.lit("The text of "), "s_name", F.lit(" is here"))).alias("found"), "page.error")


def made_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata chains with their sources given in turn: meta elements, Dublin Core, a schema.org object or a list of them."""
    who = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    fill = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("{name}"), F.col("c_name")), F.lit("{key}"), F.col("c_custkey").cast("string")), F.lit("{seg}"), F.col("c_mktsegment"))
    heads = (
        '<meta property="og:title" content="{name}"><meta name="description" content="about {seg}"><meta name="author" content="by {key}"><meta property="og:site_name" content="{seg}"><meta property="article:published_time" content="2024-02-03"><meta name="keywords" content="{seg}, k{key}">',
        '<meta name="DC.title" content="{name}"><meta name="twitter:title" content="{name}"><meta property="og:description" content="about {seg}"><meta name="sailthru.author" content="by {key}"><meta property="og:site_name" content="{seg}"><meta property="article:published_time" content="2024-02-03"><meta name="keywords" content="{seg}, k{key}">',
        '<meta property="og:title" content="{name}"><meta property="og:description" content="about {seg}"><script type="application/ld+json">{"@type": "Article", "author": {"name": "by {key}"}, "publisher": {"name": "{seg}"}, "datePublished": "2024-02-03"}</script><meta name="keywords" content="{seg}, k{key}">',
        '<meta property="og:title" content="{name}"><meta name="description" content="about {seg}"><script type="application/ld+json">[{"@type": "Thing"}, {"@type": "Article", "author": {"name": "by {key}"}, "publisher": {"name": "{seg}"}, "datePublished": "2024-02-03"}]</script><meta name="keywords" content="{seg}, k{key}">',
    )
    html = F.concat(F.lit("<html><head>"), F.element_at(F.array(*map(fill, heads)), (F.pmod("c_custkey", F.lit(len(heads))) + 1).cast("int")), F.lit("</head><body>x</body></html>"))
    rows = facts.page_metadata(who.select("c_custkey", html.alias("html"), F.lit("https://www.example.com/a").alias("url")))
    return rows.select("c_custkey", "meta_title", "description", "author", "site", "published", F.array_join("keywords", "|").alias("keywords"), "error")


# -- the node table ----------------------------------------------------


def _nodes(rows: DataFrame, key: str) -> DataFrame:
    return stored(nodes.dom_nodes(rows, key, "html"))


def node_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ("hidden", 'style="display: none"', 'class="a hidden"', 'class="hidden md:block"', 'aria-hidden="true"', "inert", 'class="shown"', 'style="opacity:0"', 'aria-hidden="false"', 'style="VISIBILITY:hidden"')
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.pmod("o_orderkey", F.lit(len(marks))) + 1).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("<body><div "), mark, F.lit("><p>x</p></div>")).alias("html"))
    return nodes.hidden(_nodes(orders, "o_orderkey")).groupBy(F.col("page").alias("o_orderkey")).agg(F.count("*").alias("n"))


def node_best_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    image = F.concat(F.lit('<img alt="'), "l_returnflag", F.lit('" width="'), F.col("l_quantity").cast("int").cast("string"), F.lit('" height="'), F.col("l_linenumber").cast("string"), F.lit('" src="i'), F.col("l_partkey").cast("string"), F.lit('"'), F.when(F.col("l_linestatus") == "O", F.lit(' srcset="a 2x"')).otherwise(""), F.lit(">"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", image.alias("image"))))
    pages = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<body>"), F.array_join(F.transform(ordered, lambda x: x["image"]), "")).alias("html"))
    best = nodes.best_images(_nodes(pages, "l_orderkey"))
    return best.select(F.col("page").alias("l_orderkey"), "alt", nodes.attr("src").alias("src"), "quality")


def node_metadata_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date in one of three forms, behind up to four paragraphs after the heading: three elements are looked at."""
    form = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "M/d/yyyy")]), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    html = F.concat(F.lit("<body><h1>Order</h1>"), F.repeat(F.lit("<p>plain words</p>"), F.pmod("o_orderkey", F.lit(5)).cast("int")), F.lit("<p>"), form, F.lit("</p><p>end</p>"))
    table = _nodes(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", html.alias("html")), "o_orderkey")
    return nodes.text_of(table, nodes.merged(table, nodes.metadata_blocks(table), ["page", "node_id"])).select(F.col("page").alias("o_orderkey"), "text")


def node_streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and the places that scripts would move them to; every fourth page has no call."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    call = F.when(F.pmod("c_custkey", F.lit(4)) != 0, F.lit('<script>$RC("B:1","S:1")</script>')).otherwise(F.lit("<script>other()</script>"))
    html = F.concat(F.lit('<body><div><template id="B:1"></template>wait</div><div hidden id="S:1"><p>'), "c_name", F.lit("</p></div>"), call)
    table = _nodes(rows.select("c_custkey", html.alias("html")), "c_custkey")
    found = nodes.streamed_segments(table)
    parts = nodes.merged(table, found.select("page", F.col("segment_id").alias("node_id")), ["page", "node_id"])
    return nodes.text_of(table, parts).select(F.col("page").alias("c_custkey"), "text")


def node_part_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link density of pages that are part link, part text."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    html = F.concat(F.lit('<body><section> <a href="x"> '), "p_name", F.lit(" </a> <b>"), "p_type", F.lit("</b> <a>"), "p_brand", F.lit("</a></section>"))
    table = _nodes(rows.select("p_partkey", html.alias("html")), "p_partkey")
    return nodes.link_density(table, nodes.elements(table, "section")).select(F.col("page").alias("p_partkey"), F.round("density", 9).alias("density"))


QUERIES = {f.__name__: f for f in (site_pages, site_answers, odd_pages, made_metadata, node_hidden, node_best_images, node_metadata_blocks, node_streamed_segments, node_part_density)}


# -- the same in SQL ---------------------------------------------------


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _expected(kinds: tuple, first: int) -> str:
    """Customers with what their kind says: extractor, title, author and site from column ``first`` on."""
    values = ", ".join(f"({k}, {', '.join(_quoted(x) for x in row[first : first + 4])})" for k, row in enumerate(kinds))
    fill = lambda c: f"replace(replace({c}, '{{name}}', c_name), '{{key}}', c_custkey::VARCHAR) AS {c}"
    return f"""WITH kinds(kind, extractor_type, title, author, site) AS (VALUES {values})
        SELECT c_custkey, extractor_type, {fill("title")}, {fill("author")}, {fill("site")}, true AS found, NULL::VARCHAR AS error FROM customer JOIN kinds ON c_custkey % {len(kinds)} = kind"""


ORACLE_SQL = {
    "site_pages": _expected(SITES, 2),
    "site_answers": _expected(ANSWERS, 3),
    "odd_pages": "SELECT s_suppkey, s_name AS title, true AS found, NULL::VARCHAR AS error FROM supplier",
    "made_metadata": """SELECT c_custkey, c_name AS meta_title, 'about ' || c_mktsegment AS description, 'by ' || c_custkey AS author, c_mktsegment AS site, '2024-02-03' AS published,
        c_mktsegment || '|k' || c_custkey AS keywords, NULL::VARCHAR AS error FROM customer""",
    "node_hidden": "SELECT o_orderkey, 1 AS n FROM orders WHERE o_orderkey % 10 NOT IN (3, 6, 8)",
    "node_best_images": """SELECT l_orderkey, l_returnflag AS alt, 'i' || l_partkey AS src, quality FROM (
        SELECT *, CAST(l_quantity AS BIGINT) * l_linenumber + CASE l_linestatus WHEN 'O' THEN 10000 ELSE 0 END + strlen('i' || l_partkey) AS quality FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY quality DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus) = 1""",
    "node_metadata_blocks": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS text
        FROM orders WHERE o_orderkey % 5 < 3""",
    "node_streamed_segments": "SELECT c_custkey, c_name AS text FROM customer WHERE c_custkey % 4 <> 0",
    "node_part_density": "SELECT p_partkey, round((strlen(p_name) + strlen(p_brand)) / strlen(p_name || '  ' || p_type || ' ' || p_brand), 9) AS density FROM part",
}
