"""Column functions over text: cleaning, sentence splitting, predicates, tokens."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: word lists, patterns and bounds that results depend on ---
JUNK = ("cookie", "javascript", "copyright", "로그인", "회원가입", "개인정보", "구독", "광고")
PDF_MARKS = ("endobj", "endstream", "ProcSet", "/PDF", " obj ", "stream", "xref", "/Font", "/Type")
WEB_UI = ("바로가기", "메뉴", "로그인", "회원가입", "글자수", "검색어", "이용약관", "개인정보처리방침", "저작권", "사이트맵", "댓글")
STOP_WORDS = ("그리고", "하지만", "그래서", "그러나", "또한", "위한", "통해", "대한", "이런", "저런", "그런", "있는", "없는", "하는", "되는", "같은")
GENERIC = (
    "실험", "관점", "방법", "결과", "내용", "경우", "문제", "사용", "활용", "분석", "처리", "기반", "통해", "대한", "위한", "이런", "그런", "여러",
    "다양", "관련", "정보", "자료", "시스템", "연구", "설계", "구조", "방식", "self", "organizing", "outlier", "smoothing", "data", "the", "and",
)
SEARCH_PARTICLES = (
    "으로부터", "에서부터", "에게서", "으로서", "이라고", "으로는", "에서는", "에게는", "에서", "에게", "한테", "으로", "이랑", "부터", "까지", "마다",
    "보다", "처럼", "만큼", "이나", "에도", "에만", "에는", "이라", "이고", "이가", "이를", "이는", "와", "과", "랑", "로", "을", "를", "은", "는",
    "이", "가", "의", "도", "만", "에",
)
WORD_PARTICLES = ("으로", "에서", "에게", "과", "와", "을", "를", "이", "가", "은", "는", "의", "도", "만", "과의", "와의", "들", "엔")
SENTENCE_END = ".!?。！？다요죠함음임됨니"
SKIPPED_TAGS = ("script", "style", "noscript", "svg", "canvas", "header", "footer", "nav")
BLOCKED_LINKS = ("duckduckgo.com", "bing.com", "google.com", "javascript:", "mailto:", "microsoft.com/", "go.microsoft.com", "w3.org")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
MIN_LEN, MAX_LEN = 12, 220
TOKEN = "[가-힣]+|[a-z]{2,}|[0-9]{2,}"
WHITE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"  # white space beside the space itself
LOWER_TO_ASCII = ("\u212A", "\u0130")  # the Kelvin sign, I with a dot
# --- End of fixed values ---


def clean(text: Column) -> Column:
    """Tags become spaces, white space collapses (beyond ASCII too), ends are trimmed. A single space is no match: it stays as it is."""
    bare = F.when(text.contains("<"), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)
    return F.trim(F.regexp_replace(bare, f"[{WHITE}][ {WHITE}]*| [ {WHITE}]+", " "))


def split_sentences(text: Column) -> Column:
    """Parts of the cleaned text, before any filter. White space in it is single spaces, so each is found first and then looked at."""
    return F.split(clean(text), rf" (?<=[{SENTENCE_END}] )|[•·]")


def contains_any(s: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (s.contains(w) for w in words))


def garbage(s: Column) -> Column:
    """True where a sentence is binary debris, a fragment, web interface noise or code."""
    size = F.length(s)
    hangul = s.rlike("[가-힣]{2,}")
    run = "(?:(?<![A-Za-z])[A-Za-z]{3,}+|(?<![가-힣])[가-힣]{2,}+)"
    odd = F.length(F.regexp_replace(s, r"[가-힣A-Za-z0-9 .,!?\"'()%~\-:;]+", ""))
    shouting = (size < 40) & ~hangul & (F.length(F.regexp_replace(s, "[^A-Z]", "")) / size > 0.2)
    interface = reduce(add, (s.contains(w).cast("int") for w in WEB_UI)) >= 2
    code = (s.contains("print") | s.contains("df") | s.contains("import")) & s.rlike(r"\bprint\s*\(|\bdf\s*\.|import\s+\w+")
    return (
        (size == 0)
        | ~s.rlike(f"(?s){run}.*?{run}")  # fewer than two runs of letters
        | contains_any(s, PDF_MARKS)
        | s.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
        | ((size - odd) / F.greatest(size, F.lit(1)) < 0.75)
        | shouting
        | (s.contains("^") & s.rlike(r"^\s*\^"))
        | s.contains("Archived from the original")
        | (s.contains("[") & s.rlike(r"\[\s*편집\s*\]|\[\s*\d+\s*\]"))
        | interface
        | (s.contains("(") & s.rlike(r"\(\s*0\s*/\s*\d+\s*\)"))
        | (code & ~hangul)
    )


def keep_sentence(s: Column, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> Column:
    """Length, junk and garbage filters of sentence splitting."""
    return F.length(s).between(min_len, max_len) & ~contains_any(F.lower(s), JUNK) & ~garbage(s)


def tokenize(text: Column) -> Column:
    """Tokens: Hangul, Latin or digit runs without URLs and mail addresses; single ASCII characters dropped; Latin in lower case."""
    bare = F.when(text.contains("://"), F.regexp_replace(text, r"(?U)https?://\S+", " ")).otherwise(text)
    bare = F.when(text.contains("@"), F.regexp_replace(bare, r"(?U)\S+@\S+", " ")).otherwise(bare)
    for c in LOWER_TO_ASCII:  # no letters of a token, but their lower case would be
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return F.regexp_extract_all(F.lower(bare), F.lit(TOKEN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda t: t != "")


def strip_search_particle(token: Column) -> Column:
    """An all-Hangul token without its longest particle, if two characters or more stay."""
    ordered = "|".join(sorted(SEARCH_PARTICLES, key=len, reverse=True))
    return F.regexp_replace(token, f"^([가-힣]{{2,}}?)(?:{ordered})$", "$1")


def search_tokens(text: Column) -> Column:
    """Tokens without search particles; a text without Hangul has none to strip."""
    toks = tokenize(text)
    return F.when(text.rlike("[가-힣]"), F.transform(toks, strip_search_particle)).otherwise(toks)


def good_word(w: Column) -> Column:
    """Fit for a query: two characters, no stop word; without Hangul four letters."""
    hangul = w.rlike("[가-힣]")
    return (F.length(w) >= 2) & F.when(hangul, ~w.isin(*STOP_WORDS)).otherwise(w.rlike(r"^\p{L}{4,}$"))


def clean_word(w: Column) -> Column:
    """Without the first particle of the list that ends it and leaves two characters or more."""
    out = None
    for p in WORD_PARTICLES:
        hit = w.endswith(p) & (F.length(w) - len(p) >= 2)
        cut = F.substring(w, F.lit(1), F.length(w) - len(p))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(w)


def too_generic(query: Column) -> Column:
    """True for a query without tokens, or with too many general words among them."""
    toks = F.filter(tokenize(query), lambda t: F.length(t) >= 2)
    n, hits = F.size(toks), F.size(F.filter(toks, lambda t: t.isin(*GENERIC)))
    return (n == 0) | (hits >= F.greatest(F.lit(1), F.floor(n / 2) + 1)) | ((n == 1) & (hits == 1))


def html_text(html: Column) -> Column:
    """Visible text of a page: comments, skipped blocks and tags go, entities are read, white space collapses."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in SKIPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def links(html: Column, limit: int = 10) -> Column:
    """First distinct outside links of a page, redirects unwrapped."""
    raw = F.transform(F.regexp_extract_all(html, F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))

    def real(h: Column) -> Column:
        def param(name: str) -> Column:
            return F.try_url_decode(F.nullif(F.regexp_extract(h, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))

        return F.when(h.contains("uddg="), param("uddg")).when(h.contains("/url?q="), param("q")).when(h.rlike("^https?://"), h)

    found = F.filter(F.transform(raw, real), lambda u: u.isNotNull() & ~contains_any(u, BLOCKED_LINKS))
    return F.slice(F.array_distinct(found), 1, limit)


def is_pdf(url: Column, content_type: Column, head: Column) -> Column:
    """A PDF by content type, by the path's ending or by its first bytes."""
    return F.lower(content_type).contains("application/pdf") | F.lower(F.split(url, r"\?")[0]).endswith(".pdf") | head.startswith("%PDF-")


def file_status(name: Column) -> Column:
    """How a file would be read, by its extension; nothing raises."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return (
        F.when(ext.isin(".txt", ".md"), "text").when(ext == ".docx", "docx").when(ext == ".pdf", "pdf").when(ext == ".doc", "convert to docx").otherwise("unsupported")
    )
