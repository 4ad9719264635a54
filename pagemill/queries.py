"""The page operators as queries over the driver's tables, with equivalent SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import made_pages, rule_pages, sql
from .functions import columns as C
from .operators.extract import extract
from .operators.extractors import chat_html
from .operators.pipeline import Options
from .plans import facts, nodes
from .sources.files import result_json, result_markdown, result_text
from .sources.shared import shared_dir, stored
from .streaming import pages as stream


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than those, as a small table's has; a large table is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table, stored: pages are parsed once, and filters on kind and tag reach the scans."""
    return stored(nodes.dom_nodes(_pages(spark, sf_dir)))


# -- whole pages -------------------------------------------------------


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir)).drop("html")
    return out.select("page_id", "page.title", "page.language", "page.domain", "page.favicon", "page.word_count")


def extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir), Options(separate_markdown=True)).drop("html")
    return out.select("page_id", F.col("page.content").alias("content"), result_markdown(F.col("page")).alias("markdown"), result_text(F.col("page")).alias("text"))


def extract_without_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir), Options(remove_low_scoring=False)).drop("html")
    return out.select("page_id", "page.word_count")


def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON lines, and what a reader finds in them."""
    rows = extract(_pages(spark, sf_dir)).drop("html").select("page_id", result_json(F.col("page")).alias("json"))
    read = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.select("page_id", read("title").alias("title"), read("domain").alias("domain"), read("word_count").cast("long").alias("word_count"), F.contains(read("content"), F.lit("<article>")).alias("has_content"))


def extract_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options: the navigation as the content, clutter rules off."""
    o = Options(content_selector="nav", remove_exact_selectors=False, remove_partial_selectors=False, remove_low_scoring=False, remove_content_patterns=False, remove_hidden_elements=False)
    return extract(_pages(spark, sf_dir), o).drop("html").select("page_id", "page.word_count", F.startswith("page.content", F.lit("<nav>")).alias("is_nav"))


def extract_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir), Options(debug=True)).drop("html")
    rows = out.select(F.explode("page.debug.removals").alias("r"))
    return rows.groupBy(F.col("r.step").alias("step"), F.col("r.selector").alias("selector"), F.col("r.reason").alias("reason")).agg(F.count("*").alias("n"))


def domain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir)).drop("html")
    return out.groupBy(F.col("page.domain").alias("domain")).agg(F.count("*").alias("pages"), F.sum("page.word_count").alias("words"))


def longest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_pages(spark, sf_dir)).drop("html")
    return out.select("page_id", "page.word_count").orderBy(F.col("word_count").desc(), "page_id").limit(10)


def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch operator under a stream that ends when its input does."""
    base = shared_dir(spark)
    source = spark.readStream.schema(stream.PAGES).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, base))
    out = stream.extract_stream(source).select("page_id", "page.title", "page.word_count")
    stream.write_stream(out, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.schema("page_id long, title string, word_count long").parquet(f"{base}/out")


def _folder(spark: SparkSession, sf_dir: str, base: str) -> str:
    _read(spark, sf_dir, "pages").write.parquet(f"{base}/in")
    return f"{base}/in"


# -- metadata ----------------------------------------------------------


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.page_metadata(_pages(spark, sf_dir))
    return rows.select("page_id", "html_title", "meta_title", "description", "author", "language", "domain", "favicon")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = _read(spark, sf_dir, "pages").select("page_id", "url")
    return rows.select("page_id", C.url_host(url).alias("host"), C.url_origin(url).alias("origin"), C.site_of_domain(C.url_host(url)).alias("site"))


# -- scalar text functions ---------------------------------------------


def text_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages")
    return rows.select("page_id", C.strip_tags(F.col("html")).alias("text"))


def text_strip_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    return rows.select("page_id", sql.SCALARS["strip_html_tags"]("html").alias("text"))


def text_count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", C.count_words(F.col("text")).cast("long").alias("words"), C.count_commas(F.col("text")).cast("long").alias("commas"))


def text_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.html_escape(F.col("text")).alias("escaped"))


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.preview(text).alias("preview"), C.first_paragraph(text).alias("first"))


def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.explode(C.keywords(F.col("text"))).alias("keyword"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("keyword").alias("last"))


def text_percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", C.percent_encode(F.col("url")).alias("encoded"))


def dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(_read(spark, sf_dir, "events").select("event_id", "ts"))
    text = lambda form: C.iso_date(F.date_format("ts", form))
    return rows.select("event_id", text("MMMM d, yyyy").alias("english"), text("d MMMM yyyy").alias("plain"), text("yyyy-MM-dd").alias("iso"))


def dates_from_unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", C.unix_day(F.col("o_orderkey") * 86_399).alias("day"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count(value).alias("n"))


# -- pages as nodes ----------------------------------------------------


def node_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).where("kind = 'element' and tag in ('p', 'li', 'a', 'h1', 'article', 'nav', 'footer', 'div')")
    return rows.groupBy(F.col("page").alias("page_id"), "tag").agg(F.count("*").alias("n"))


def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = _nodes(spark, sf_dir)
    links = nodes.elements(all_nodes, "a")
    texts = nodes.merged(nodes.text_of(all_nodes, links), links.select("page", "node_id", nodes.attr("href").alias("href")), ["page", "node_id"])
    return texts.select(F.col("page").alias("page_id"), "href", "text")


def node_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = _nodes(spark, sf_dir)
    return nodes.text_of(all_nodes, nodes.elements(all_nodes, "h1")).select(F.col("page").alias("page_id"), "text")


def node_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in links over bytes of text, of the whole body, the navigation and the article."""
    all_nodes = _nodes(spark, sf_dir)
    found = nodes.link_density(all_nodes, nodes.elements(all_nodes, "body", "nav", "article"))
    tags = nodes.elements(all_nodes, "body", "nav", "article").select("page", "node_id", "tag")
    return nodes.merged(found, tags, ["page", "node_id"]).select(F.col("page").alias("page_id"), "tag", F.round("density", 9).alias("density"))


def node_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = _nodes(spark, sf_dir)
    found = nodes.tag_counts(all_nodes, nodes.elements(all_nodes, "nav", "article"), "a", "li", "p")
    tags = nodes.elements(all_nodes, "nav", "article").select("page", "node_id", "tag")
    return nodes.merged(found, tags, ["page", "node_id"]).select(F.col("page").alias("page_id"), "tag", "a", "li", "p")


def node_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with their items' count and the first and last item, by place among siblings."""
    rows = nodes.siblings(_nodes(spark, sf_dir)).where("tag = 'li'")
    return rows.groupBy(F.col("page").alias("page_id")).agg(F.count("*").alias("items"), F.count_if(F.col("from_start") == 1).alias("lists"), F.count_if(F.col("previous").isNotNull() & F.col("following").isNotNull()).alias("inner_items"))


def node_links_outside_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = _nodes(spark, sf_dir)
    links = nodes.elements(all_nodes, "a", "h1", "p")
    return nodes.not_inside(links, nodes.elements(all_nodes, "nav")).groupBy("tag").agg(F.count("*").alias("n"))


def node_sections_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and lists that hold line breaks or links: a semi join."""
    all_nodes = _nodes(spark, sf_dir)
    found = nodes.has_below(nodes.elements(all_nodes, "nav", "article", "footer", "li", "p"), nodes.elements(all_nodes, "a", "br"))
    return found.groupBy("tag").agg(F.count("*").alias("n"))


# -- chats -------------------------------------------------------------


def chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as HTML: an ordered aggregation of messages."""
    who = F.when(F.col("role") == "user", "You").when(F.col("role") == "assistant", "Assistant").otherwise(F.col("role"))
    message = F.concat(
        F.lit('<div class="message message-'), "role", F.lit('" data-role="'), "role", F.lit('"><div class="message-header"><strong>'), C.html_escape(who),
        F.lit('</strong></div><div class="message-content">'), "text", F.lit("</div></div>"),
    )
    head, tail = chat_html([]).split("><", 1)
    rows = _read(spark, sf_dir, "conversations").withColumn("message", message)
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("parts"))
    return parts.select("conv_id", F.concat(F.lit(head + ">"), F.array_join(F.transform("parts", lambda p: p["message"]), ""), F.lit("<" + tail)).alias("html"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_pages, extract_content, extract_without_scoring, extract_json, extract_removals, domain_words, longest_pages, stream_pages, page_metadata,
        page_hosts, text_strip_tags, text_strip_html_tags, text_count_words, text_escape, text_preview, text_keywords, text_percent_encode,
        dates_from_text, dates_from_unix, json_paths, node_tags, node_links, node_headings, node_link_density, node_list_items,
        node_links_outside_nav, node_sections_with_links, node_tag_counts, chat_pages, extract_navigation,
    )
} | made_pages.QUERIES | rule_pages.QUERIES

# -- the same in SQL ---------------------------------------------------

_WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CJK = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"


def _decoded(text: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def _decoded_plain(text: str) -> str:
    """As plain text does it: the middle dot is none of its entities."""
    for name, char in (("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def _trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{_WS}]+|[{_WS}]+\z', '', 'g')"


def _words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[{_CJK}]|[^{_WS}{_CJK}]+'))"


_TITLE = _trimmed(_decoded(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
#: A last segment of up to four words counts as the site's name and goes.
_CLEAN = rf"""CASE WHEN regexp_matches(t, '(?s)\A\S+\s.* \| \S.*\z') AND regexp_matches(regexp_extract(t, '(?s)\A.* \| (.*)\z', 1), '\A\S+(?: \S+){{0,3}}\z')
    AND strlen(regexp_extract(t, '(?s)\A(.*) \| .*\z', 1)) >= strlen(regexp_extract(t, '(?s)\A.* \| (.*)\z', 1)) THEN {_trimmed(r"regexp_extract(t, '(?s)\A(.*) \| .*\z', 1)")} ELSE t END"""
_PARTS = r"string_split(regexp_extract(html, '(?s)<article>.*?</article>'), '<p>')"
_SEEN = _trimmed(_decoded("regexp_replace(part, '<[^>]*>', '', 'g')"))
#: Short bylines and notices go; k = 1 is the heading.
_BYLINE = rf"""({_words(_SEEN)} <= 15 AND regexp_matches({_SEEN}, '(?i)\A(by|written by|author:)\s+\S'))"""
_BOILERPLATE = rf"""({_words(_SEEN)} <= 30 AND regexp_matches({_SEEN}, '(?i)this article (appeared|was published|originally)|originally published|©\s*\d{{4}}|all rights reserved|comments|leave a reply|subscribe to|sign up for'))"""
_KEPT = f"k = 1 OR NOT ({_BYLINE} OR {_BOILERPLATE})"
_COUNTED = _words(_decoded("regexp_replace(part, '<[^>]*>', ' ', 'g')"))
_HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_ORIGIN = rf"regexp_extract(url, '^(https?)://', 1) || '://' || {_HOST}"
_EXTRACT = f"""SELECT page_id, {_CLEAN} AS title, language, domain, favicon, word_count FROM
    (SELECT page_id, {_TITLE} AS t, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, {_HOST} AS domain, {_ORIGIN} || '/favicon.ico' AS favicon FROM pages)
    JOIN (SELECT page_id, CAST(sum({_COUNTED}) AS BIGINT) AS word_count FROM
      (SELECT page_id, unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS k FROM pages) WHERE {_KEPT} GROUP BY page_id) USING (page_id)"""
_COUNT = lambda tag: f"len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<{tag}[ >]'))"
#: Bytes of the texts of all links.
_LINKS = f"""list_sum(list_transform(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), lambda x: strlen({_trimmed(_decoded("x"))})))"""
#: What goes by exact selectors, and how often a page has it.
_REMOVED = (
    ('script:not([type^="math/"])', "len(regexp_extract_all(html, '<script>'))"), ("style", _COUNT("style")), ("meta", _COUNT("meta")), ('.ad:not([class*="gradient"])', "len(regexp_extract_all(html, '<div class=\"ad\">'))"), ("nav", _COUNT("nav")), ("footer", _COUNT("footer")),
)
_TAGS = ("p", "li", "a", "h1", "article", "nav", "footer", "div")
_DAY = "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d')"

ORACLE_SQL = {
    "extract_pages": _EXTRACT,
    "extract_without_scoring": f"SELECT page_id, word_count FROM ({_EXTRACT})",
    "domain_words": f"SELECT domain, count(*) AS pages, CAST(sum(word_count) AS BIGINT) AS words FROM ({_EXTRACT}) GROUP BY domain",
    "longest_pages": f"SELECT page_id, word_count FROM ({_EXTRACT}) ORDER BY word_count DESC, page_id LIMIT 10",
    "stream_pages": f"SELECT page_id, title, word_count FROM ({_EXTRACT})",
    "page_metadata": f"""SELECT page_id, {_TITLE} AS html_title, NULL::VARCHAR AS meta_title, NULL::VARCHAR AS description, NULL::VARCHAR AS author,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, {_HOST} AS domain, {_ORIGIN} || '/favicon.ico' AS favicon FROM pages""",
    "page_hosts": rf"""SELECT page_id, host, origin, upper(name[1:1]) || name[2:] AS site FROM (
        SELECT page_id, {_HOST} AS host, {_ORIGIN} AS origin, split_part(regexp_replace({_HOST}, '\A(?:www|[a-z]{{2}})\.', ''), '.', 1) AS name FROM pages)""",
    "text_strip_tags": "SELECT page_id, replace(regexp_replace(regexp_replace(html, '<[^>]*>', '>', 'g'), '<[^>]*$', ''), '>', ' ') AS text FROM pages",
    "text_strip_html_tags": f"SELECT page_id, {_decoded_plain(chr(39).join(['replace(regexp_replace(html, ', '<[^>]*>', ', ', '>', ', ', 'g', '), ', '>', ', ', ' ', ')']))} AS text FROM pages",
    "text_count_words": f"SELECT doc_id, {_words('text')} AS words, length(text) - length(replace(text, ',', '')) AS commas FROM documents",
    "text_escape": "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents",
    "text_preview": f"""SELECT doc_id, CASE WHEN length(flat) > 80 THEN flat[1:80] || '...' ELSE flat END AS preview, {_trimmed("split_part(" + _trimmed("text") + ", chr(10) || chr(10), 1)")}[1:100] AS first
        FROM (SELECT doc_id, text, {_trimmed(f"regexp_replace(text, '[{_WS}]+', ' ', 'g')")} AS flat FROM documents)""",
    "text_keywords": f"SELECT doc_id, count(*) AS n, max(k) AS last FROM (SELECT doc_id, {_trimmed('unnest(string_split(text, chr(44)))')} AS k FROM documents) WHERE k <> '' GROUP BY doc_id",
    "text_percent_encode": "SELECT page_id, url_encode(url) AS encoded FROM pages",
    "dates_from_text": f"SELECT event_id, {_DAY} AS english, {_DAY} AS plain, {_DAY} AS iso FROM events",
    "dates_from_unix": "SELECT o_orderkey, strftime(to_timestamp(o_orderkey * 86399) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM orders",
    "json_paths": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type",
    "node_tags": "SELECT page_id, tag, n FROM (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, {_COUNT(t)} AS n FROM pages" for t in _TAGS) + ") WHERE n > 0",
    "node_links": f"""SELECT page_id, {_decoded("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, {_decoded("regexp_extract(a, '>([^<]*)</a>', 1)")} AS text
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) AS a FROM pages)""",
    "node_headings": f"SELECT page_id, {_decoded(chr(39).join(['regexp_extract(html, ', '(?s)<h1>(.*?)</h1>', ', 1)']))} AS text FROM pages",
    "node_link_density": f"""WITH p AS (SELECT page_id, {_LINKS} AS linked, strlen({_trimmed(_decoded("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"))}) AS size FROM pages)
        SELECT page_id, 'body' AS tag, round(linked / size, 9) AS density FROM p UNION ALL SELECT page_id, 'nav', 1.0 FROM p UNION ALL SELECT page_id, 'article', 0.0 FROM p""",
    "node_tag_counts": f"""SELECT page_id, 'nav' AS tag, {_COUNT('a')} AS a, {_COUNT('li')} AS li, 0 AS p FROM pages UNION ALL SELECT page_id, 'article', 0, 0, {_COUNT('p')} FROM pages""",
    "extract_json": f"SELECT page_id, title, domain, word_count, true AS has_content FROM ({_EXTRACT})",
    "extract_navigation": f"""SELECT page_id, CAST(list_sum(list_transform(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), lambda x: {_words(_decoded("x"))})) AS BIGINT) AS word_count, true AS is_nav FROM pages""",
    "node_list_items": f"SELECT page_id, {_COUNT('li')} AS items, {_COUNT('ul')} AS lists, {_COUNT('li')} - 2 * {_COUNT('ul')} AS inner_items FROM pages",
    "node_links_outside_nav": f"SELECT 'h1' AS tag, CAST(sum({_COUNT('h1')}) AS BIGINT) AS n FROM pages UNION ALL SELECT 'p', CAST(sum({_COUNT('p')}) AS BIGINT) FROM pages",
    "node_sections_with_links": f"""SELECT tag, count(*) AS n FROM (SELECT 'nav' AS tag FROM pages UNION ALL SELECT 'li' FROM (SELECT unnest(regexp_extract_all(html, '<li><a ')) FROM pages)
        UNION ALL SELECT 'article' FROM pages WHERE contains(html, '<br>') UNION ALL
        SELECT 'p' FROM (SELECT unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS k FROM pages) WHERE k > 1 AND contains(part, '<br>')) GROUP BY tag""",
    "extract_removals": f"""SELECT * FROM ({" UNION ALL ".join(f"SELECT 'removeBySelector' AS step, '{s}' AS selector, 'exact selector match' AS reason, CAST(sum({n}) AS BIGINT) AS n FROM pages" for s, n in _REMOVED)}
        UNION ALL SELECT 'removeByContentPattern', NULL, CASE WHEN {_BYLINE} THEN 'byline' ELSE 'boilerplate' END, count(*) FROM (SELECT unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS k FROM pages)
        WHERE k > 1 AND ({_BYLINE} OR {_BOILERPLATE}) GROUP BY ALL) WHERE n > 0""",
    "chat_pages": """SELECT conv_id, '<div class="conversation">' || string_agg('<div class="message message-' || role || '" data-role="' || role || '"><div class="message-header"><strong>' ||
        CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE role END || '</strong></div><div class="message-content">' || text || '</div></div>', '' ORDER BY turn) || '</div>' AS html
        FROM conversations GROUP BY conv_id""",
} | made_pages.ORACLE_SQL | rule_pages.ORACLE_SQL
