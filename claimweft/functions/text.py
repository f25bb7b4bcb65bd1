"""String, markup and URL functions as column expressions; none leaves the JVM.

White space is written out as a class, so that other engines with other defaults can be compared: WS is what the
expressions treat as white space (blank, tab, line ends, no-break space).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[ \\t\\r\\n\\u00a0]"
Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace(x: Text, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_c(x), F.lit(pattern), F.lit(by))


def squeeze(x: Text) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(replace(x, f"{WS}+", " "))


def strip_html(x: Text) -> Column:
    """Readable text of raw HTML: invisible and furniture blocks and all tags become blanks, then the named entities are
    decoded in a fixed order, so that a doubly escaped mark is decoded twice."""
    out = _c(x)
    for tag in ("script", "style", "noscript", "header", "nav", "footer", "aside", "form", "svg"):
        out = replace(out, f"(?i)<{tag}\\b[^>]*>[\\s\\S]*?</{tag}>", " ")
    out = replace(out, "<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = replace(out, f"(?i){entity}", mark)
    return squeeze(out)


def html_title(x: Text) -> Column:
    return squeeze(F.regexp_extract(_c(x), "(?is)<title[^>]*>([\\s\\S]*?)</title>", 1))


def html_language(x: Text) -> Column:
    return F.nullif(F.regexp_extract(_c(x), '(?i)<html[^>]*\\blang="([^"]+)"', 1), F.lit(""))


def drop_media(x: Text) -> Column:
    """HTML without svg and img elements."""
    return replace(replace(x, "(?i)<svg\\b[^>]*>[\\s\\S]*?</svg>"), "(?i)<img\\b[^>]*>")


def strip_tags(x: Text) -> Column:
    """Tags deleted without a trace, as in search snippets."""
    return replace(x, "<[^>]+>")


def plain_markdown(x: Text) -> Column:
    """Markdown as plain text: code and images go, link labels stay, headings are dropped, one block a line."""
    out = replace(x, "```[\\s\\S]*?```", " ")
    out = replace(out, "`[^`]*`", " ")
    out = replace(out, "!\\[[^\\]]*\\]\\([^)]*\\)", " ")
    out = F.regexp_replace(out, F.lit("\\[([^\\]]*)\\]\\([^)]*\\)"), F.lit("$1"))
    out = replace(out, "<!--[\\s\\S]*?-->", " ")
    out = replace(out, "<[^>]+>", " ")
    out = replace(out, f"(?m)^#{{1,6}}{WS}+.*$", "")
    out = replace(out, f"(?m)^[-=]{{3,}}{WS}*$", "")
    out = replace(out, f"(?m)^>{WS}+", "")
    out = replace(out, "[*_~]", "")
    out = replace(out, f"{WS}+\n", "\n")
    out = replace(out, "\n{2,}", "\n\n")
    return replace(replace(out, "[ \t]{2,}", " "), f"^{WS}+|{WS}+$", "")


def tight_emphasis(x: Text) -> Column:
    """``** word **`` as ``**word**``."""
    return F.regexp_replace(_c(x), F.lit("\\*\\*[ \\t]*([^*]*?)[ \\t]*\\*\\*"), F.lit("**$1**"))


def word_count(x: Text) -> Column:
    return F.size(F.filter(F.split(_c(x), f"{WS}+"), lambda w: w != ""))


# --- URLs -------------------------------------------------------------------------------------------------------------

def authority(url: Text) -> Column:
    """Host with port and in its own case; empty where there is none."""
    return F.coalesce(F.regexp_extract(_c(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def host(url: Text) -> Column:
    return F.lower(F.regexp_extract(authority(url), "^(?:[^@]*@)?([^:]*)", 1))


def canonical_url(url: Text) -> Column:
    """Host and path without slashes at the end: scheme, port, query and fragment don't count. What is no URL stays."""
    path = F.regexp_extract(_c(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url) != "", replace(F.concat(host(url), path), "/+$")).otherwise(_c(url))


def with_scheme(url: Text) -> Column:
    return F.when(_c(url).rlike("(?i)^https?://"), _c(url)).otherwise(F.concat(F.lit("https://"), _c(url)))


def bare_domain(url: Text) -> Column:
    return replace(host(url), "^www\\.")


def short_domain(url: Text) -> Column:
    """The last two labels of the host."""
    return F.array_join(F.slice(F.split(host(url), "\\."), F.greatest(F.lit(1), F.size(F.split(host(url), "\\.")) - 1), 2), ".")


def route_domain(url: Text) -> Column:
    """Whatever stands between the scheme and the first slash."""
    return F.split_part(replace(url, "^https?://"), F.lit("/"), F.lit(1))


def in_domain(host_column: Column, domain: Column) -> Column:
    """The host is the domain or below it; false where either is empty."""
    h, d = F.lower(F.coalesce(host_column, F.lit(""))), F.lower(F.coalesce(domain, F.lit("")))
    return (h != "") & (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def unwrap_redirect(url: Text, parameter: str = "uddg") -> Column:
    target = F.regexp_extract(_c(url), f"[?&]{parameter}=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(_c(url))


# --- Small text rules -------------------------------------------------------------------------------------------------

def clean_query(x: Text, fallback: Text, limit: int = 200) -> Column:
    """A model's answer as a search query: outer quotes go, the first line stays without a label. Empty: the fallback."""
    out = replace(x, "^[\"'` \\t\\r\\n]+|[\"'` \\t\\r\\n]+$")
    out = F.split_part(out, F.lit("\n"), F.lit(1))
    out = F.left(F.trim(replace(out, "(?i)^(query|search)[ \\t]*:[ \\t]*")), F.lit(limit))
    return F.coalesce(F.nullif(out, F.lit("")), _c(fallback))


def strip_quotes(x: Text) -> Column:
    return replace(replace(x, '^[ \\t]*"+|"+[ \\t]*$'), "^[ \\t]+|[ \\t]+$")


def alignment_label(x: Text) -> Column:
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    return F.when(low.startswith("agree"), "agrees").when(low.startswith("disagree") | low.startswith("contradict"), "disagrees").otherwise("unrelated")


def capped(x: Text, n: int, mark: str = "") -> Column:
    """The first ``n`` characters, and ``mark`` where there were more."""
    return F.when(F.length(_c(x)) > n, F.concat(F.left(_c(x), F.lit(n)), F.lit(mark))).otherwise(_c(x))


def ellipsis(x: Text, n: int) -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.rtrim(F.left(_c(x), F.lit(n - 1))), F.lit("…"))).otherwise(_c(x))


def drop_thoughts(x: Text) -> Column:
    return replace(x, "(?is)<think>[\\s\\S]*?</think>")


def plain_words(x: Text) -> Column:
    """Lower case, everything but letters, digits and underscores as blanks."""
    return squeeze(replace(F.lower(_c(x)), "[^\\p{L}\\p{N}_ \\t\\r\\n]", " "))


def clean_lower(x: Text) -> Column:
    return squeeze(F.lower(_c(x)))


def occurrences(text: Text, part: Text) -> Column:
    """Non-overlapping occurrences, without regard to case."""
    low, p = F.lower(_c(text)), F.lower(_c(part))
    return F.when(F.length(p) > 0, ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens; 0 where either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score_colour(score: Column) -> Column:
    """Red over yellow to green for 0 to 1."""
    s = clamp(score, 0.0, 1.0)
    red = F.when(s < 0.5, 255.0).otherwise(255 * (2 - 2 * s))
    green = F.when(s < 0.5, 255 * 2 * s).otherwise(255.0)
    return F.format_string("rgb(%d,%d,0)", F.floor(red + 0.5).cast("int"), F.floor(green + 0.5).cast("int"))


def score_band(score: Column) -> Column:
    return F.when(score < -0.2, "contradiction").when(score < 0.2, "irrelevant").otherwise("support")


def context_text(pairs: Column, skip: str | None = None) -> Column:
    """A map as lines ``key: value``."""
    kept = F.map_filter(pairs, lambda k, v: k != F.lit(skip)) if skip else pairs
    return F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def sentence_parts(x: Text) -> Column:
    return F.split(F.lower(_c(x)), "[.!?][ \\t\\r\\n]+")


def base_model_name(tag: Text) -> Column:
    """The part of a model's tag before the colon."""
    return F.split_part(_c(tag), F.lit(":"), F.lit(1))


def grouped(n: Text) -> Column:
    """A whole number with its thousands grouped."""
    return F.format_number(_c(n), 0)


def percent(score: Column) -> Column:
    return F.concat(F.format_number(score * 100, 0), F.lit("%"))
