"""Text, URL and markup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, listed since engines and versions differ in what \s means.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def count_of(text: Column, term: str) -> Column:
    """How often a term occurs (without overlaps)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def html_text(html: Column) -> Column:
    """Markup to text: scripts, styles and comments go, tags become blanks, common entities are decoded, blanks collapse."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def html_text_sql(html: str) -> str:
    t = f"regexp_replace({html}, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'gis')"
    t = f"regexp_replace(regexp_replace({t}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'))"


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no slash at the end."""
    base = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z]+://[^/?]+)", 1))
    path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z]+://[^/?]+([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|gclid|fbclid|ref|source)(=|$)"))
    joined = F.array_join(kept, "&")
    return F.concat(head, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def normal_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def first_words(text: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "…").otherwise(""))


#: Marks that a clipped text doesn't end with (fixed values), and how much of a text and of a line is kept.
_TAIL = " ,;:-"
CLIP, LINE, LINE_WORDS, LINES = 800, 500, 24, 3


def clipped(text: Column, width: int) -> Column:
    """White space as single blanks, and at most ``width`` characters: cut after a whole word, with an ellipsis, if there were more."""
    flat = F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" "))
    head = F.regexp_replace(F.left(flat, F.lit(width + 1)), r" [^ ]*$", "")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(head, F.lit(_TAIL)), F.lit("…")))


def summary_line(text: Column) -> Column:
    """A clipped text of at most ``LINE_WORDS`` words."""
    line = clipped(text, LINE)
    words = F.split(line, " ")
    short = F.rtrim(F.array_join(F.slice(words, 1, LINE_WORDS), " "), F.lit(_TAIL + "."))
    return F.when(F.size(words) <= LINE_WORDS, line).otherwise(F.concat(short, F.lit("…")))


def first_sentences(text: Column) -> Column:
    """The first ``LINES`` sentences of a clipped text as summary lines; they end at ., ! or ? before white space."""
    parts = F.filter(F.split(clipped(text, CLIP), r"(?<=[.!?]) +"), lambda s: s != "")
    return F.transform(F.slice(parts, 1, LINES), summary_line)
