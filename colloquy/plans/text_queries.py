"""Queries over documents, pages and conversations, and the learning runs, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import text, urls
from colloquy.operators import behavior, corpus, evaluate, graph, html, learn, relational
from colloquy.plans import study
from colloquy.plans.relational_queries import IMAGES, SITE, TRAIN, comments, table, threads
from colloquy.sources import text as text_sources

#: Stop words of the queries below. Fixed values.
STOP = ["the", "of", "and", "to", "in", "de", "la", "die", "der", "que"]
SQL_STOP = ", ".join(f"'{w}'" for w in STOP)
SQL_NUMBER = r"'^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?([eE][+-]?[0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*([eE][+-]?[0-9]+(_[0-9]+)*)?|(?i:nan|inf|infinity))$'"
TOKENS = rf"""
w AS (SELECT doc_id, unnest(string_split(lower(replace(text, chr(10), ' ')), ' ')) AS token FROM documents),
k AS (SELECT * FROM w WHERE length(token) > 1 AND NOT regexp_matches(token, {SQL_NUMBER}) AND token NOT IN ({SQL_STOP}))"""


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("tokens", text.tokens(text.remove_newlines("text", " "), STOP))


def vector_distance(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return pairs.select("vec_id", F.round(text.distance("v", "w"), 6).alias("distance"))


def char_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x7f]")).cast("bigint").alias("non_ascii"), text.count_cjk(F.concat(F.lit("一龥龦あ"), "text")).cast("bigint").alias("cjk"))


def _linked(spark, sf):
    p = table(spark, sf, "pages")
    shown = F.transform(F.sequence(F.lit(0), F.pmod("page_id", F.lit(6)).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit(f"http://{IMAGES}/"), i.cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("see "), F.col("url"))))
    return p.select("page_id", F.concat(F.lit("see "), "url", F.lit(" end")).alias("t"), F.array_join(shown, " and ").alias("i"))


def remove_url(spark, sf):
    return _linked(spark, sf).select("page_id", text.remove_urls("t").alias("t"))


def image_count(spark, sf):
    return _linked(spark, sf).select("page_id", text.count_images("i", IMAGES).alias("greedy"), text.count_images("i", IMAGES, lazy=True).alias("lazy"))


def external_link(spark, sf):
    return _linked(spark, sf).select("page_id", text.external_link("t", "blog.tionsh.example.net").alias("external"))


def url_class(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit(f"http://{SITE}/group/topic/"), F.col("page_id").cast("string"), F.lit("/?start=100")).alias("made"))
    return p.select("page_id", urls.scheme("url").alias("scheme"), urls.host("url").alias("host"), urls.path("url").alias("path"), urls.is_web("url").alias("web"), urls.url_class("made", SITE).alias("kind"), urls.url_id("made", "comment", SITE).alias("id"), urls.page_number(urls.url_start("made", "comment", SITE)).cast("bigint").alias("page"), urls.url_class("url", SITE).alias("other"))


def hrefs(spark, sf):
    return html.links(table(spark, sf, "pages")).select("page_id", "href", "target")


def title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title("html").alias("title"))


def charset(spark, sf):
    return table(spark, sf, "pages").groupBy(html.charset("html").alias("charset")).agg(F.count(F.lit(1)).alias("n"))


def doc_freq(spark, sf):
    return corpus.doc_frequency(docs(spark, sf))


def high_freq_tokens(spark, sf):
    """T1. The most frequent 100 tokens: a report, hence the limit."""
    return corpus.doc_frequency(docs(spark, sf)).orderBy(F.desc("df"), "token").limit(100)


def token_summary(spark, sf):
    d = docs(spark, sf).withColumn("raw", F.split(F.lower(text.remove_newlines("text", " ")), " "))
    return corpus.token_summary(d, STOP)


def plain_corpus(spark, sf):
    """A12. Titles and contents without comments, and a group's description first."""
    heads = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("topic_id"), F.concat(F.lit("at "), F.col("url"), F.lit(" it")).alias("title"), F.lit("more").alias("content"))
    return corpus.corpus(spark.range(1).select(F.lit("about us").alias("description")), heads, None, "g")


def user_bags(spark, sf):
    said = comments(spark, sf).select("user_id", "topic_id")
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("topic_id"), F.split(F.concat_ws(" ", "o_orderstatus", F.regexp_replace("o_orderpriority", "-", " ")), " ").alias("tokens"))
    return corpus.interest_bags(said, texts)


def bow(spark, sf):
    return corpus.bag_of_words(docs(spark, sf), "doc_id")


def dictionary(spark, sf):
    return corpus.dictionary(docs(spark, sf))


def corpus_text(spark, sf):
    c = table(spark, sf, "conversations")
    joined = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    return joined.select("conv_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


def thread_corpus(spark, sf):
    c = table(spark, sf, "conversations")
    heads = c.where("turn = 0").select(F.col("conv_id").cast("string").alias("topic_id"), F.col("role").alias("title"), F.col("text").alias("content"))
    rest = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("topic_id"), F.lit(None).cast("timestamp").alias("pubdate"), F.lpad(F.col("turn").cast("string"), 8, "0").alias("comment_id"), F.col("text").alias("content"))
    group = spark.range(1).select(F.lit("about http://a.example/x this").alias("description"))
    return corpus.corpus(group, heads, rest, "g").select("doc_key", F.md5("text").alias("digest"))


def comment_tree(spark, sf):
    c = table(spark, sf, "conversations")
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    nodes = c.select(F.col("conv_id").alias("topic_id"), ident(F.col("turn")).alias("comment_id"), F.when(F.col("turn") > 0, ident(F.col("turn") - 1)).alias("ref_comment_id"))
    tree, _ = graph.comment_tree(nodes)
    children = tree.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return graph.depths(tree.select("child", "parent")).join(children, "node", "left").select("node", "root", "depth", F.coalesce("children", F.lit(0)).alias("children"))


def user_interest_text(spark, sf):
    said = comments(spark, sf).select("user_id", "topic_id")
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("topic_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("content"))
    return corpus.interest_text(said, texts).select("user_id", F.md5("text").alias("digest"), "n_topics")


def behaviour_text(spark, sf):
    said = comments(spark, sf).withColumn("comment_id", F.col("topic_id"))
    t = threads(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("topic_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("content")), "topic_id")
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return behavior.behaviour_text(users, t, said, *TRAIN).select("user_id", "num_topics", "num_comments", F.md5("text").alias("digest"))


def segmented(spark, sf):
    mixed = F.concat(F.repeat(F.lit("今天天气 好"), F.pmod("doc_id", F.lit(3)).cast("int")), F.lit(" "), F.col("text"))
    words = table(spark, sf, "documents").select("doc_id", text.segment(mixed).alias("w"))
    return words.select("doc_id", F.md5("w").alias("digest"), F.size(F.split("w", " ")).cast("bigint").alias("n_words"))


def lda(spark, sf):
    d = docs(spark, sf)
    vectors = corpus.fit_vectors(d)
    model = corpus.train_topics(d, vectors, 5, 5)
    return corpus.topic_terms(vectors, model)


def topic_interest(spark, sf):
    d = docs(spark, sf)
    vectors = corpus.fit_vectors(d)
    return corpus.topic_distribution(d.select("doc_id", "tokens"), vectors, corpus.train_topics(d, vectors, 5, 5), 5).select("doc_id", "topics")


def _labelled(spark, sf):
    d = table(spark, sf, "documents")
    shapes = d.select("doc_id", (F.length("text") / 1000.0).alias("length"), (F.regexp_count("text", F.lit("[!#%&*$]")) / F.greatest(F.length("text"), F.lit(1))).alias("junk"), F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("words"))
    rows = shapes.join(table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") > 0, 1).otherwise(-1).alias("label")), "doc_id")
    return rows, ["length", "junk", "words"]


def logreg(spark, sf):
    rows, features = _labelled(spark, sf)
    scaled = learn.min_max(rows, features)
    return learn.predict(learn.fit_logistic(scaled, features), scaled, features).select("doc_id", "label", F.round("prob", 4).alias("prob"))


def bagging(spark, sf):
    rows, features = _labelled(spark, sf)
    scaled = learn.min_max(rows, features)
    turned = scaled.withColumn("label", -F.col("label"))  # low quality is the rare class
    return learn.predict_bagged(learn.fit_bagged(turned, features, ["doc_id"]), turned, features, ["doc_id"]).select("doc_id", "label", F.round("prob", 4).alias("prob"), "predicted")


def prediction_eval(spark, sf):
    """Scores and labels come from two tables and meet on their key (J14), whatever the order of their rows."""
    scores = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / 20000.0).alias("prob")).orderBy(F.desc("doc_id"))
    scored = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(scores, "doc_id")
    return evaluate.precision_at_k(scored, ["source"], "doc_id").withColumn("precision", F.round("precision", 6))


def _shown(c) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _person(c) -> Column:
    return F.concat(F.lit(f'<a href="http://{SITE}/people/'), c, F.lit('/">'), c, F.lit("</a>"))


def topic_pages(spark, sf):
    """H3. Threads written as pages from the first turns of conversations, and read back."""
    turns = table(spark, sf, "conversations")
    sizes = turns.groupBy("conv_id").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("n"))
    head = turns.where("turn = 0").join(sizes, "conv_id")
    page = F.concat(
        F.lit('<html><body><div class="topic-doc"><h3><span class="from">'), _person(F.col("role")), F.lit('</span><span class="color-green">2024-01-02 03:04:05</span></h3><div class="topic-content"><p>'),
        _shown(F.col("text")), F.lit('</p><div class="topic-figure cc"><img src="http://img.example.com/x.jpg"></div></div></div><div class="paginator"><a href="?start=0">1</a>'),
        F.concat(F.lit("<a>"), F.col("n").cast("string"), F.lit("</a></div></body></html>")),
    )
    return html.extract_topics(head.select(F.col("conv_id").alias("page_id"), page.alias("html"))).select("page_id", "user_id", "user_name", "pubdate", F.md5("content").alias("digest"), "n_pages")


def comment_pages(spark, sf):
    """H4. Comments written as pages of 100 from the later turns of conversations, each quoting the one before, and read back."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("quoted"), F.col("text").alias("quote"))
    rows = turns.where("turn > 0").join(before, ["conv_id", "turn"])
    quote = F.when(F.col("turn") > 1, F.concat(F.lit('<div class="reply-quote"><span class="all">'), _shown(F.col("quote")), F.lit('</span><span class="pubdate">'), _person(F.col("quoted")), F.lit("</span></div>"))).otherwise("")
    item = F.concat(
        F.lit('<li data-cid="'), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit('"><div class="reply-doc content"><h4>'), _person(F.col("role")),
        F.lit('<span class="pubtime">2024-01-02 03:04:05</span></h4>'), quote, F.lit("<p>"), _shown(F.col("text")), F.lit("</p></div></li>"),
    )
    pages = rows.groupBy("conv_id", F.floor(F.col("turn") / 100).alias("page")).agg(F.concat(F.lit('<ul id="comments">'), F.array_join(F.collect_list(item), ""), F.lit("</ul>")).alias("html"))
    found = html.extract_comments(pages.withColumnRenamed("conv_id", "page_id"))
    return found.select("page_id", "comment_id", "user_id", "pubdate", F.md5("content").alias("digest"), F.md5(F.coalesce("quote_text", F.lit(""))).alias("quote_digest"), F.coalesce("quote_user_id", F.lit("")).alias("quote_user_id"))


def group_pages(spark, sf):
    """H5, H6. Groups written as pages from regions and nations, and read back."""
    n = table(spark, sf, "nation")
    page = F.concat(
        F.lit("<title>"), F.col("n_name"), F.lit('</title><div class="infobox"><div class="bd"><p>since 2011-05-0'), F.col("n_regionkey").cast("string"), F.lit(" by "), _person(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))),
        F.lit("</p> all of it</div></div><table><tr><td><span><img alt='[置顶]'></span><a href=\"http://"), F.lit(SITE), F.lit("/group/topic/"), F.col("n_nationkey").cast("string"), F.lit('/">x</a></td></tr></table>'),
    )
    found = html.extract_groups(n.select(F.col("n_nationkey").alias("page_id"), page.alias("html")))
    return found.select("page_id", "title", "user_id", "pubdate", "description", F.array_join("sticky_topic_ids", ",").alias("sticky"))


def page_records(spark, sf):
    """H3, H5. Titles and page counts of plain pages."""
    group = html.extract_groups(table(spark, sf, "pages"))
    topic = html.extract_topics(table(spark, sf, "pages"))
    return group.select("page_id", "title").join(topic.select("page_id", "n_pages"), "page_id")


def thread_dump(spark, sf):
    c = table(spark, sf, "conversations")
    t = c.where("turn = 0").select(F.col("conv_id").cast("string").alias("topic_id"), F.col("role").alias("user_id"), F.lit(None).cast("timestamp").alias("pubdate"), F.lit("thread").alias("title"), F.col("text").alias("content"))
    said = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("topic_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("comment_id"), F.col("role").alias("user_id"), F.lit(None).cast("timestamp").alias("pubdate"), F.when(F.col("turn") > 1, F.lpad((F.col("turn") - 1).cast("string"), 6, "0")).alias("ref_comment_id"), F.col("text").alias("content"))
    return text_sources.dump_threads(t, said).select("topic_id", "place", F.md5("value").alias("digest"))


def quality_funnel(spark, sf):
    d = table(spark, sf, "documents")
    long = d.where("n_chars >= 200")
    return study.funnel({"documents": d, "long": long, "labelled": relational.of_known(long, table(spark, sf, "labels"), "doc_id"), "good": relational.of_known(long, table(spark, sf, "labels").where("quality = 1"), "doc_id")})


def keyword_pages(spark, sf):
    return table(spark, sf, "pages").where(html.has_keyword("html", "blog")).select("page_id", urls.host("url").alias("host"))


def list_pages(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("pages"))
    return html.page_urls(turns, "conv_id", "pages", 100, F.concat(F.lit(f"http://{SITE}/group/topic/"), F.col("conv_id").cast("string"), F.lit("/?start=")))


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
NOSCRIPT = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


QUERIES = {
    "q25_distance": vector_distance, "q26_char_count": char_count, "q27_remove_url": remove_url, "q28_image_count": image_count, "q29_external_link": external_link,
    "q30_url_class": url_class, "q31_hrefs": hrefs, "q32_title": title, "q33_charset": charset, "q34_doc_freq": doc_freq, "q35_bow": bow, "q36_dictionary": dictionary,
    "q37_corpus": corpus_text, "q37b_thread_corpus": thread_corpus, "q38_comment_tree": comment_tree, "q44_user_interest_text": user_interest_text,
    "q44b_behaviour_text": behaviour_text, "q46_lda": lda, "q46b_topic_interest": topic_interest, "q47_logreg": logreg, "q48_bagging": bagging,
    "q49_prediction_eval": prediction_eval, "q50_html_extract": page_records, "q51_quality_funnel": quality_funnel, "q52_keyword_pages": keyword_pages,
    "q57_list_pages": list_pages, "q58_segment": segmented,
    "q34b_high_freq_tokens": high_freq_tokens, "q37c_plain_corpus": plain_corpus, "q44c_user_bags": user_bags, "q50b_topic_pages": topic_pages, "q50c_comment_pages": comment_pages,
    "q50d_group_pages": group_pages, "q66_token_summary": token_summary, "q67_thread_dump": thread_dump,
}

ORACLES = {
    "q25_distance": "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "q26_char_count": r"SELECT doc_id, len(regexp_extract_all(text, '[^\x00-\x7f]'))::BIGINT AS non_ascii, 2 + len(regexp_extract_all(text, '[一-龥]'))::BIGINT AS cjk FROM documents",
    "q27_remove_url": r"SELECT page_id, regexp_replace('see ' || url || ' end', '((http|https|ftp)://([a-zA-Z0-9_\-]+\.)+[a-zA-Z0-9_\-]+(/[a-zA-Z0-9_\-\./\?%&\=]*)?)', '', 'g') AS t FROM pages",
    "q28_image_count": "SELECT page_id, (page_id % 6 > 0)::INT AS greedy, (page_id % 6)::INT AS lazy FROM pages",
    "q29_external_link": f"SELECT page_id, ({HOST} <> 'blog.tionsh.example.net')::INT AS external FROM pages",
    "q30_url_class": f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9_+.-]*):', 1)) AS scheme, {HOST} AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?#]*([^?#]*)', 1) AS path, scheme IN ('http', 'https') AS web, 'comment' AS kind, page_id::VARCHAR AS id, 2::BIGINT AS page, NULL::VARCHAR AS other FROM pages",
    # By cutting the page at its links, and each at its quotes; the pages have links in double quotes only, none of them in comments or scripts.
    "q31_hrefs": """WITH p AS (SELECT page_id, url, unnest(string_split(html, '<a ')[2:]) AS rest FROM pages),
h AS (SELECT page_id, url, replace(string_split(string_split(rest, 'href="')[2], '"')[1], '&amp;', '&') AS href FROM p WHERE starts_with(rest, 'href="'))
SELECT page_id, href, CASE WHEN starts_with(href, '//') THEN string_split(url, '//')[1] || href WHEN starts_with(href, '/') THEN array_to_string(string_split(url, '/')[1:3], '/') || href ELSE href END AS target FROM h""",
    "q32_title": f"SELECT page_id, {_plain(f'''regexp_extract({NOSCRIPT}, '(?is)<h1[^>]*>(.*?)</h1>', 1)''')} AS title FROM pages",
    "q33_charset": """SELECT lower(regexp_extract(html, '(?i)charset="?([^";> ]+)', 1)) AS charset, count(*) AS n FROM pages GROUP BY 1""",
    "q34_doc_freq": f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY token",
    "q34b_high_freq_tokens": f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY token ORDER BY df DESC, token LIMIT 100",
    "q37c_plain_corpus": "SELECT 'g' AS doc_key, 'about us' AS text UNION ALL SELECT page_id::VARCHAR, regexp_replace('at ' || url || ' it', '((http|https|ftp)://([a-zA-Z0-9_\\-]+\\.)+[a-zA-Z0-9_\\-]+(/[a-zA-Z0-9_\\-\\./\\?%&\\=]*)?)', '', 'g') || ' more' FROM pages",
    "q44c_user_bags": """WITH d AS (SELECT DISTINCT l_suppkey AS user_id, o_orderkey AS k, o_orderstatus || ' ' || replace(o_orderpriority, '-', ' ') AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, token, count(*) AS tf FROM (SELECT user_id, unnest(string_split(t, ' ')) AS token FROM d) GROUP BY 1, 2""",
    "q49_prediction_eval": """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk, count(*) OVER (PARTITION BY source) AS n, (quality > 0)::INT AS hit FROM labels JOIN documents USING (doc_id)),
k AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS "K")
SELECT source, "K", round(sum(CASE WHEN rk <= "K" THEN hit ELSE 0 END) / least("K", max(n))::DOUBLE, 6) AS precision FROM r, k GROUP BY source, "K\"""",
    "q50b_topic_pages": """SELECT c.conv_id AS page_id, role AS user_id, role AS user_name, '2024-01-02 03:04:05' AS pubdate, md5(trim(text, ' ' || chr(10)) || chr(10) || '（图片：http://img.example.com/x.jpg）' || chr(10)) AS digest, (n // 2 + 1)::INT AS n_pages
FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE turn = 0""",
    "q50c_comment_pages": """SELECT c.conv_id AS page_id, c.conv_id || ':' || c.turn AS comment_id, c.role AS user_id, '2024-01-02 03:04:05' AS pubdate, md5(trim(c.text, ' ' || chr(10))) AS digest,
 md5(CASE WHEN c.turn > 1 THEN trim(b.text, ' ' || chr(10)) ELSE '' END) AS quote_digest, CASE WHEN c.turn > 1 THEN b.role ELSE '' END AS quote_user_id
FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.turn > 0""",
    "q50d_group_pages": "SELECT n_nationkey AS page_id, n_name AS title, 'r' || n_regionkey AS user_id, '2011-05-0' || n_regionkey AS pubdate, 'since 2011-05-0' || n_regionkey || ' by r' || n_regionkey || ' all of it' AS description, n_nationkey::VARCHAR AS sticky FROM nation",
    "q58_segment": r"""WITH s AS (SELECT doc_id, array_to_string(list_concat(CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['今天', '天天', '天气', '好'] ELSE ['今天', '天天', '天气', '好今', '今天', '天天', '天气', '好'] END, regexp_extract_all(text, '[\p{L}\p{N}_]+')), ' ') AS w FROM documents)
SELECT doc_id, md5(w) AS digest, len(string_split(w, ' ')) AS n_words FROM s""",
    "q66_token_summary": f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS c FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM w) AS raw_tokens, (SELECT count(*) FROM k) AS kept_tokens, (SELECT count(*) FROM w WHERE token IN ({SQL_STOP})) AS stop_tokens, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)) AS empty_documents""",
    "q67_thread_dump": """WITH r AS (SELECT conv_id, -2 AS t, '# thread by ' || role || ' ' AS v FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, -1, text FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, turn, '- ' || lpad(turn::VARCHAR, 6, '0') || CASE WHEN turn > 1 THEN ' > ' || lpad((turn - 1)::VARCHAR, 6, '0') ELSE '' END || ' ' || role || ': ' || text FROM conversations WHERE turn > 0)
SELECT conv_id::VARCHAR AS topic_id, row_number() OVER (PARTITION BY conv_id ORDER BY t)::INT AS place, md5(v) AS digest FROM r""",
    "q35_bow": f"WITH {TOKENS} SELECT doc_id, token, count(*) AS tf FROM k GROUP BY 1, 2",
    "q36_dictionary": f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY token HAVING count(DISTINCT doc_id) <= 0.8 * (SELECT count(*) FROM documents)",
    "q37_corpus": "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS digest, length(string_agg(text, ' ' ORDER BY turn, text)) AS n_chars FROM conversations GROUP BY conv_id",
    "q37b_thread_corpus": """SELECT 'g' AS doc_key, md5('about  this') AS digest UNION ALL
SELECT h.conv_id::VARCHAR, md5(h.role || ' ' || h.text || coalesce(' ' || r.t, '')) FROM conversations h LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE turn > 0 GROUP BY 1) r USING (conv_id) WHERE h.turn = 0""",
    "q38_comment_tree": """SELECT conv_id || ':' || turn AS node, 'root_' || conv_id AS root, turn + 1 AS depth, (turn < max(turn) OVER (PARTITION BY conv_id))::BIGINT AS children FROM conversations
UNION ALL SELECT 'root_' || conv_id, 'root_' || conv_id, 0, count(*) FILTER (turn = 0) FROM conversations GROUP BY conv_id""",
    "q44_user_interest_text": "SELECT user_id, md5(string_agg(t, ' ' ORDER BY k)) AS digest, count(*) AS n_topics FROM (SELECT DISTINCT l_suppkey AS user_id, o_orderkey AS k, o_orderstatus || ' ' || o_orderpriority AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
    "q44b_behaviour_text": f"""WITH c AS (SELECT l_suppkey AS user_id, count(*) AS n, string_agg(o_orderstatus || ' ' || o_orderpriority, ' ' ORDER BY o_orderkey) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= '{TRAIN[0]}' AND l_shipdate < '{TRAIN[1]}' GROUP BY 1),
t AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1)
SELECT s_suppkey AS user_id, coalesce(t.n, 0) AS num_topics, coalesce(c.n, 0) AS num_comments, md5(coalesce(c.t, '')) AS digest FROM supplier LEFT JOIN t ON t.user_id = s_suppkey LEFT JOIN c ON c.user_id = s_suppkey""",
    "q50_html_extract": rf"SELECT page_id, {_plain('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} AS title, 1 AS n_pages FROM pages",
    "q51_quality_funnel": """SELECT 0 AS step, 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 200 UNION ALL
SELECT 2, 'labelled', count(*) FROM documents WHERE n_chars >= 200 AND doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 3, 'good', count(*) FROM documents WHERE n_chars >= 200 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "q52_keyword_pages": f"SELECT page_id, {HOST} AS host FROM pages WHERE contains(html, 'blog')",
    "q57_list_pages": "SELECT conv_id, page::INT AS page, 'http://www.example.com/group/topic/' || conv_id || '/?start=' || page * 100 AS url FROM (SELECT conv_id, unnest(range(1, max(turn))) AS page FROM conversations GROUP BY conv_id)",
}
