"""SQL fragments shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations

WHITE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{WHITE}', ' ', 'g'))"


def split(x: str) -> str:
    return (
        f"string_split(regexp_replace(regexp_replace({clean(x)}, '([.!?。！？다요죠함음임됨니])\\s+', '\\1' || chr(1), 'g'), '[\\n\\r]+|[•·]', chr(1), 'g'), chr(1))"
    )


def has_any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def garbage(s: str) -> str:
    from ..functions import text as T

    ui = " + ".join(f"CAST(contains({s}, '{w}') AS INT)" for w in T.WEB_UI)
    hangul = f"regexp_matches({s}, '[가-힣]{{2,}}')"
    return f"""(length({s}) = 0 OR {has_any(s, T.PDF_MARKS)} OR regexp_matches({s}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')
      OR length(regexp_replace({s}, '[^가-힣A-Za-z0-9 .,!?"''()%~\\-:;]', '', 'g')) / greatest(length({s}), 1) < 0.75
      OR NOT ({hangul} OR regexp_matches({s}, '[A-Za-z]{{3,}}'))
      OR len(regexp_extract_all({s}, '[가-힣]{{2,}}')) + len(regexp_extract_all({s}, '[A-Za-z]{{3,}}')) < 2
      OR (length({s}) < 40 AND NOT {hangul} AND length(regexp_replace({s}, '[^A-Z]', '', 'g')) / greatest(length({s}), 1) > 0.2)
      OR regexp_matches({s}, '^\\s*\\^') OR contains({s}, 'Archived from the original')
      OR regexp_matches({s}, '\\[\\s*편집\\s*\\]|\\[\\s*\\d+\\s*\\]') OR ({ui}) >= 2 OR regexp_matches({s}, '\\(\\s*0\\s*/\\s*\\d+\\s*\\)')
      OR (regexp_matches({s}, '\\bprint\\s*\\(|\\bdf\\s*\\.|import\\s+\\w+') AND NOT {hangul}))"""


def kept(s: str) -> str:
    from ..functions import text as T

    return f"(length({s}) BETWEEN 12 AND 220 AND NOT {has_any(f'lower({s})', T.JUNK)} AND NOT {garbage(s)})"


def sentences(table: str, key: str, text: str = "text") -> str:
    """A query for (key, pos, sentence)."""
    parts = split(text)
    return f"""SELECT {key}, pos, sentence FROM (SELECT {key}, generate_subscripts(p, 1) - 1 AS pos, trim(unnest(p)) AS sentence
      FROM (SELECT {key}, {parts} AS p FROM {table})) WHERE {kept('sentence')}"""


def tokenize(x: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(trim({x}), 'https?://\\S+', ' ', 'g'), '\\S+@\\S+', ' ', 'g'), "
        "'[가-힣]+|[A-Za-z]+|[0-9]+'), lambda t: NOT regexp_matches(t, '^[A-Za-z0-9]$')), lambda t: lower(t))"
    )


def tokens(table: str, key: str = "doc_id", text: str = "text") -> str:
    """A query for (key, pos, tok)."""
    return f"SELECT {key}, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM (SELECT {key}, {tokenize(text)} AS t FROM {table})"


def html_text(x: str) -> str:
    from ..functions import text as T

    out = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in T.SKIPPED_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '{WHITE}', ' ', 'g'))"
