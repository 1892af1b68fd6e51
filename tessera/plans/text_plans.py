"""Queries over text: ingest, cleaning, tokens and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..sources import files
from . import sqlparts as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its checking SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"SELECT doc_id, pos, sentence FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) AS r FROM ({S.sentences('documents', 'doc_id')})) WHERE r = 1")
def text_sentences(spark, d):
    return C.corpus(read(spark, d, "documents"))


@query(f"SELECT doc_id, pos, trim(s) AS sentence, {S.garbage('trim(s)')} AS is_garbage FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS s FROM (SELECT doc_id, {S.split('text')} AS p FROM documents))")
def garbage_sentences(spark, d):
    parts = read(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "part"))
    s = F.trim("part")
    return parts.select("doc_id", "pos", s.alias("sentence"), T.garbage(s).alias("is_garbage"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(txt|md)$') THEN 'text' WHEN regexp_matches(lower(url), '\\.docx$') THEN 'docx' WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.doc$') THEN 'convert to docx' ELSE 'unsupported' END AS status FROM pages")
def file_statuses(spark, d):
    return read(spark, d, "pages").select("page_id", T.file_status(F.col("url")).alias("status"))


@query("SELECT page_id, (lower(regexp_replace(url, '\\?.*$', '')) LIKE '%.pdf' OR starts_with(html, '%PDF-')) AS is_pdf FROM pages")
def pdf_pages(spark, d):
    return read(spark, d, "pages").select("page_id", T.is_pdf(F.col("url"), F.lit("text/html"), F.col("html")).alias("is_pdf"))


@query(f"SELECT page_id, {S.html_text('html')} AS text FROM pages")
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_BLOCKED = " OR ".join(f"contains(u, '{b}')" for b in T.BLOCKED_LINKS)


@query(f"""
WITH h AS (SELECT page_id, generate_subscripts(l, 1) AS pos, replace(unnest(l), '&amp;', '&') AS h FROM (SELECT page_id, regexp_extract_all(html || '<a href="' || replace(url, '&', '&amp;') || '">x</a><a href=''/l/?uddg=' || url_encode(url || '#top') || '&amp;rut=1''>y</a><a href="/url?q=' || url_encode(url || '/z') || '">', 'href=["'']([^"'']+)["'']', 1) AS l FROM pages)),
r AS (SELECT page_id, pos, CASE WHEN contains(h, 'uddg=') THEN url_decode(nullif(regexp_extract(h, '[?&]uddg=([^&#]*)', 1), '')) WHEN contains(h, '/url?q=') THEN url_decode(nullif(regexp_extract(h, '[?&]q=([^&#]*)', 1), ''))
  WHEN regexp_matches(h, '^https?://') THEN h END AS u FROM h),
f AS (SELECT page_id, u, min(pos) AS pos FROM r WHERE u IS NOT NULL AND NOT ({_BLOCKED}) GROUP BY ALL)
SELECT page_id, u AS link, rank - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f) WHERE rank <= 10
""")
def page_links(spark, d):
    """Outside links of pages to which their own address is added, as it is and wrapped as search engines do."""
    url = F.col("url")
    plain = F.concat(F.lit('<a href="'), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('">x</a>'))
    wrapped = F.concat(F.lit("<a href='/l/?uddg="), F.url_encode(F.concat(url, F.lit("#top"))), F.lit("&amp;rut=1'>y</a>"))
    other = F.concat(F.lit('<a href="/url?q='), F.url_encode(F.concat(url, F.lit("/z"))), F.lit('">'))
    return read(spark, d, "pages").select("page_id", F.posexplode(T.links(F.concat("html", plain, wrapped, other))).alias("pos", "link"))


_PAGE_SENTENCES = f"""
WITH t AS (SELECT page_id, url, {S.html_text('html')} AS text FROM pages),
s AS ({S.sentences('t', 'page_id')}),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(sentence) ORDER BY page_id, pos) AS r FROM s) WHERE r = 1)
"""


@query(_PAGE_SENTENCES + "SELECT page_id, url, pos, sentence FROM k JOIN pages USING (page_id) ORDER BY page_id, pos LIMIT 300")
def crawl_sentences(spark, d):
    return C.crawl(read(spark, d, "pages"))


@query(_PAGE_SENTENCES + "SELECT page_id, any_value(url) AS url, count(*) AS n_sentences FROM s JOIN pages USING (page_id) GROUP BY page_id")
def crawl_source_log(spark, d):
    return C.crawl_log(read(spark, d, "pages"))


@query(f"""
WITH d AS (SELECT item_id, list_concat([text], string_split(text, chr(10))) AS parts FROM benchmark),
e AS (SELECT item_id, generate_subscripts(parts, 1) - 1 AS part, unnest(parts) AS text FROM d),
p AS (SELECT item_id, part, {S.split('text')} AS p FROM e),
s AS (SELECT item_id, part, generate_subscripts(p, 1) - 1 AS pos, trim(unnest(p)) AS sentence FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY item_id, part, pos) AS r FROM s WHERE {S.kept('sentence')})
SELECT item_id, part, pos, sentence FROM k WHERE r = 1 ORDER BY item_id, part, pos LIMIT 200
""")
def collect_snippets(spark, d):
    """Descriptions and extra snippets of search results (benchmark texts and their lines) as distinct sentences."""
    parts = read(spark, d, "benchmark").select("item_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("part", "text"))
    split = parts.select("item_id", "part", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "s"))
    kept = split.select("item_id", "part", "pos", F.trim("s").alias("sentence")).where(T.keep_sentence(F.col("sentence")))
    return C.keep_first(kept, F.col("sentence"), ["item_id", "part", "pos"]).orderBy("item_id", "part", "pos").limit(200)


@query("SELECT page_id, 'page ' || page_id AS title, url, left(html, 40) AS description, 1 AS n_extra FROM pages")
def search_response(spark, d):
    """A stored search response, parsed with the result schema."""
    item = F.struct(
        F.concat(F.lit("page "), F.col("page_id")).alias("title"), "url", F.substring("html", 1, 40).alias("description"), F.array("url").alias("extra_snippets")
    )
    stored = read(spark, d, "pages").select("page_id", F.to_json(F.struct(F.struct(F.array(item).alias("results")).alias("web"))).alias("body"))
    schema = "web struct<results:array<struct<title:string,url:string,description:string,extra_snippets:array<string>>>>"
    hit = stored.select("page_id", F.explode(F.from_json("body", schema).web.results).alias("r"))
    return hit.select("page_id", "r.title", "r.url", "r.description", F.size("r.extra_snippets").alias("n_extra"))


@query("""
WITH l AS (SELECT page_id // 4 AS q, page_id % 4 AS engine, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS n FROM pages)
SELECT q, min(engine) AS engine, min_by(n, engine) AS n_links FROM l WHERE n > 0 GROUP BY q
""")
def search_fallback(spark, d):
    """The first of the ordered engines (pages 4q to 4q+3) that found any link."""
    n = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    found = read(spark, d, "pages").select(F.floor(F.col("page_id") / 4).alias("q"), (F.col("page_id") % 4).alias("engine"), n.alias("n")).where("n > 0")
    return found.groupBy("q").agg(F.min("engine").alias("engine"), F.min_by("n", "engine").alias("n_links"))


def _files(spark, d):
    """The documents as files, as the binaryFile source gives them."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    return read(spark, d, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


_FILES = f"""WITH f AS (SELECT coalesce(source, 'none') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, coalesce(text, '') AS text FROM documents),
s AS ({S.sentences('f', 'path')})"""


@query(_FILES + " SELECT path, pos, md5(sentence) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY path, pos) AS r FROM s) WHERE r = 1")
def file_corpus(spark, d):
    """Sentences of all files, decoded, split, filtered and kept once in their first place."""
    return files.sentences(_files(spark, d))[0].select("path", "pos", F.md5("sentence").alias("digest"))


@query(_FILES + ", c AS (SELECT path, count(DISTINCT sentence) AS n FROM s GROUP BY path) SELECT path, 'txt, ' || length(text) || ' characters, ' || coalesce(n, 0) || ' sentences' AS info FROM f LEFT JOIN c USING (path)")
def file_info(spark, d):
    """What became of every file."""
    return files.sentences(_files(spark, d))[1].select("path", "info")


@query(f"SELECT doc_id, len({S.tokenize('text')}) AS n_tokens, md5(array_to_string({S.tokenize('text')}, ' ')) AS digest FROM documents")
def tokenize_documents(spark, d):
    t = T.tokenize(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '{S.WHITE}', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents)")
def space_token_counts(spark, d):
    t = T.space_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


_JOSA = "|".join(sorted(T.SEARCH_PARTICLES, key=len, reverse=True))
_ENDINGS = ", ".join(f"'{p}'" for p in T.SEARCH_PARTICLES)


@query(f"""WITH t AS (SELECT DISTINCT tok, md5(tok) AS h FROM ({S.tokens('documents')})),
n AS (SELECT tok, [CAST(('0x' || substr(h, i, 4)) AS BIGINT) for i in [1, 5, 9, 13]] AS n FROM t),
w AS (SELECT tok, chr(CAST(44032 + n[1] % 11172 AS INT)) || CASE WHEN n[3] % 3 > 0 THEN chr(CAST(44032 + n[2] % 11172 AS INT)) ELSE '' END || [{_ENDINGS}][1 + n[4] % {len(T.SEARCH_PARTICLES)}] AS w FROM n)
SELECT tok, w, regexp_replace(w, '^([가-힣]{{2,}}?)(?:{_JOSA})$', '\\1') AS stem FROM w""")
def particle_strip(spark, d):
    """Hangul words made of the digests of the documents' tokens, each with one of the particles, stripped of it."""
    toks = C.tokens(read(spark, d, "documents")).select("tok").distinct()
    n = [F.conv(F.substring(F.md5("tok"), i, 4), 16, 10).cast("long") for i in (1, 5, 9, 13)]

    def syllable(x):  # the three bytes of a syllable in UTF-8
        c = F.lit(44032) + x % 11172
        parts = (224 + F.shiftright(c, 12), 128 + F.shiftright(c, 6) % 64, 128 + c % 64)
        return F.decode(F.unhex(F.concat(*(F.hex(p) for p in parts))), "utf-8")

    second = F.when(n[2] % 3 > 0, syllable(n[1])).otherwise("")
    ending = F.get(F.array(*(F.lit(p) for p in T.SEARCH_PARTICLES)), (n[3] % len(T.SEARCH_PARTICLES)).cast("int"))
    words = toks.select("tok", F.concat(syllable(n[0]), second, ending).alias("w"))
    return words.select("tok", "w", T.strip_search_particle(F.col("w")).alias("stem"))


_CLEAN = "CASE " + " ".join(f"WHEN ends_with(tok, '{p}') AND length(tok) - {len(p)} >= 2 THEN left(tok, length(tok) - {len(p)})" for p in T.WORD_PARTICLES) + " ELSE tok END"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT tok, {_CLEAN} AS word, count(*) AS n FROM ({S.tokens('documents')})
WHERE length(tok) >= 2 AND CASE WHEN regexp_matches(tok, '[가-힣]') THEN tok NOT IN ({_STOP}) ELSE regexp_matches(tok, '^[\\p{{L}}]{{4,}}$') END GROUP BY ALL""")
def good_words(spark, d):
    toks = C.word_count(C.tokens(read(spark, d, "documents")).where(T.good_word(F.col("tok"))))
    return toks.select("tok", T.clean_word(F.col("tok")).alias("word"), "n")


_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC)


@query(f"""SELECT doc_id, line, len(t) = 0 OR hits >= greatest(1, len(t) // 2 + 1) OR (len(t) = 1 AND hits = 1) AS generic FROM (
  SELECT doc_id, line, t, len(list_filter(t, lambda x: x IN ({_GENERIC}))) AS hits FROM (
    SELECT doc_id, line, list_filter({S.tokenize('line')}, lambda x: length(x) >= 2) AS t FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)))""")
def generic_queries(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("line"))
    return lines.select("doc_id", "line", T.too_generic(F.col("line")).alias("generic"))


@query(f"""WITH t AS ({S.tokens("(SELECT * FROM documents WHERE lang = 'en')")}),
c AS (SELECT tok, count(*) AS n, min((doc_id, pos)) AS first FROM t WHERE length(tok) >= 2 GROUP BY tok),
r AS (SELECT tok, row_number() OVER (ORDER BY n DESC, first) - 1 AS r FROM c)
SELECT r // 2 AS topic, string_agg(tok, ' ' ORDER BY r) AS query FROM r WHERE r < 6 GROUP BY topic""")
def seed_topics(spark, d):
    return C.seed_topics(read(spark, d, "documents").where("lang = 'en'"))


@query("SELECT doc_id, lower(left(text, 10)) AS low, starts_with(text, 'The') AS s, ends_with(text, '.') AS e, contains(text, 'the') AS c, replace(left(text, 20), 'e', '3') AS r, md5(text) AS h, length(text) AS n, url_encode(left(source, 8)) AS u FROM documents")
def string_scalars(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id",
        F.lower(F.substring(t, 1, 10)).alias("low"),
        t.startswith("The").alias("s"),
        t.endswith(".").alias("e"),
        t.contains("the").alias("c"),
        F.replace(F.substring(t, 1, 20), F.lit("e"), F.lit("3")).alias("r"),
        F.md5(t).alias("h"),
        F.length(t).alias("n"),
        F.url_encode(F.substring("source", 1, 8)).alias("u"),
    )


@query("SELECT event_id, round(ln(value + 1), 6) AS l, round(exp(-abs(value) / 100), 6) AS e, round(sqrt(abs(value)), 6) AS q, round_even(value, 0) AS half_even, greatest(-1.0, least(1.0, value)) AS clipped FROM events WHERE value > 0")
def math_scalars(spark, d):
    v = F.col("value")
    return (
        read(spark, d, "events")
        .where("value > 0")
        .select(
            "event_id",
            F.round(F.ln(v + 1), 6).alias("l"),
            F.round(F.exp(-F.abs(v) / 100), 6).alias("e"),
            F.round(F.sqrt(F.abs(v)), 6).alias("q"),
            F.rint(v).alias("half_even"),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)).alias("clipped"),
        )
    )


@query(f"SELECT tok, count(*) AS n FROM ({S.tokens('documents')}) GROUP BY tok")
def word_count(spark, d):
    return C.word_count(C.tokens(read(spark, d, "documents")))


_VOCAB = f"SELECT tok, n, row_number() OVER (ORDER BY n DESC, first) - 1 AS idx FROM (SELECT tok, count(*) AS n, min((doc_id, pos)) AS first FROM ({S.tokens('documents')}) GROUP BY tok HAVING count(*) >= 2) ORDER BY idx LIMIT 20000"


@query(_VOCAB)
def build_vocabulary(spark, d):
    return C.vocabulary(C.tokens(read(spark, d, "documents")))


@query(f"SELECT round(count(DISTINCT tok) / count(*), 9) AS vocab_div FROM ({S.tokens('documents')})")
def type_token_ratio(spark, d):
    return C.type_token_ratio(C.tokens(read(spark, d, "documents"))).select(F.round("vocab_div", 9).alias("vocab_div"))


@query(f"SELECT tok, round(pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 9) AS p_negative, round(least(1.0, (sqrt(n / sum(n) OVER () / 1e-3) + 1) * 1e-3 / (n / sum(n) OVER ())), 9) AS p_keep FROM ({_VOCAB})")
def sampling_weights(spark, d):
    w = C.negative_sampling(C.vocabulary(C.tokens(read(spark, d, "documents"))))
    return w.select("tok", F.round("p_negative", 9).alias("p_negative"), F.round("p_keep", 9).alias("p_keep"))


@query(f"WITH t AS ({S.tokens('benchmark', 'item_id')}) SELECT a.tok AS center, b.tok AS context, count(*) AS n FROM t a JOIN t b USING (item_id) WHERE abs(a.pos - b.pos) BETWEEN 1 AND 2 GROUP BY ALL")
def skip_gram_pairs(spark, d):
    return C.skip_gram_pairs(read(spark, d, "benchmark"), 2, "item_id")


@query()
def corpus_skip_gram_pairs(spark, d):
    """Pairs of the documents' words."""
    return C.skip_gram_pairs(read(spark, d, "documents"), 2)


RETENTION = f"""WITH t AS ({S.tokens('documents')}), n AS (SELECT greatest(5, CAST(floor(0.3 * count(*)) AS BIGINT)) AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents),
top AS (SELECT tok, count(*) AS c FROM t JOIN r USING (doc_id), n WHERE seq < k GROUP BY tok ORDER BY c DESC, tok LIMIT 100)
SELECT count(*) FILTER (tok IN (SELECT tok FROM t JOIN r USING (doc_id), n WHERE seq >= k)) / count(*) AS retention FROM top"""


@query(RETENTION)
def vocabulary_retention(spark, d):
    """Share of the first 30 % of documents' top 100 words that the rest has (document ids are in order of arrival)."""
    docs = read(spark, d, "documents")
    edge = C.kth_smallest(docs, "doc_id", max(5, int(0.3 * docs.count())))
    return C.top_retention(C.tokens(docs.where(F.col("doc_id") <= edge)), C.tokens(docs.where(F.col("doc_id") > edge)))
