"""Text, URL, JSON and version functions as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweave.functions import vocabulary as V


def words(text: Column) -> Column:
    """Words at white space, none empty."""
    return F.array_remove(F.split(text, r"\s+", -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _list(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def question_keywords(question: Column) -> Column:
    """Distinct lower-cased words that aren't stop words."""
    return F.array_distinct(F.array_except(words(F.lower(question)), _list(V.STOP_WORDS)))


def section_quality(content: Column, question: Column) -> Column:
    """0 under 20 words; else up to 0.8 for length and 0.2 for the question's keywords, 1 at most."""
    n, keys = word_count(content), question_keywords(question)
    overlap = F.when(F.size(keys) > 0, F.size(F.array_intersect(keys, words(F.lower(content)))) / F.size(keys) * 0.2).otherwise(0.0)
    return F.when(n < 20, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(0.8), 0.2 + n / 200 * 0.6) + overlap))


def normal_question(question: Column) -> Column:
    """Lower case, without the start of a question and trailing marks."""
    starts = "|".join(V.QUESTION_STARTS)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(question)), rf"^({starts})\s+", ""), r"[?. ]+$", "")


def search_terms(question: Column, most: int = 3) -> Column:
    """The first words of more than three characters that aren't stop words, as written."""
    return F.slice(F.filter(words(question), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*V.STOP_WORDS)), 1, most)


def summary(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean(text: Column) -> Column:
    """Text without page furniture: whole lines, short lines, then parts of lines in order; blank lines collapsed."""

    def trimmed(x: Column) -> Column:
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    def part(line: Column) -> Column:
        *plain, breadcrumbs = V.FURNITURE_PARTS  # one small expression over a list of patterns, as plans repeat it often
        done = F.aggregate(F.array(*map(F.lit, plain)), line, lambda x, p: trimmed(F.regexp_replace(x, p, F.lit(""))))
        marks = F.length(line) - F.length(F.replace(line, F.lit(">"), F.lit("")))  # the last pattern is slow where it can't match
        return F.when(marks >= 3, trimmed(F.regexp_replace(done, breadcrumbs, ""))).otherwise(done)

    def lines(parts: bool) -> Column:
        every = F.transform(F.split(text, "\n", -1), trimmed)
        kept = F.filter(every, lambda x: (x == "") | (~F.lower(x).isin(*V.FURNITURE_LINES) & ((F.length(x) >= 4) | x.rlike(r"^\d"))))
        if not parts:
            return F.filter(kept, lambda x: (x == "") | (F.length(x) >= 5))
        done = F.transform(kept, lambda x: F.struct(x.alias("was"), F.when(x == "", x).otherwise(part(x)).alias("now")))
        return F.transform(F.filter(done, lambda x: (x["was"] == "") | (F.length(x["now"]) >= 5)), lambda x: x["now"])

    # texts without any word of the patterns, most of them, are spared the patterns
    some = F.lower(text).rlike("feedback|share|tweet|facebook|x\\.com|linkedin|reddit|article|content|page|yes|edit|issue|previous|cookie|privacy|newsletter|updates|>")
    return trimmed(F.regexp_replace(F.array_join(F.when(some, lines(True)).otherwise(lines(False)), "\n"), r"\n{3,}", "\n\n"))


def relation(text: Column) -> Column:
    """The canonical relation, after lower case and blanks and hyphens to underscores; unknown ones stay."""
    form = F.translate(F.lower(F.trim(text)), " -", "__")
    known = [F.lit(x) for pair in V.RELATION_SPELLINGS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*known), form), form)


def domain(categories: Column) -> Column:
    """The domain with most of its words among the categories, the earlier one in a tie; null below two."""
    joined = F.lower(F.array_join(categories, " "))
    best = [(name, reduce(lambda a, b: a + b, (joined.rlike(rf"\b{w}\b").cast("int") for w in ws))) for name, ws in V.DOMAIN_WORDS.items()]
    top = F.greatest(*(score for _, score in best))
    pick = reduce(lambda c, x: c.when(x[1] == top, x[0]), best[1:], F.when(best[0][1] == top, best[0][0]))
    return F.when(top >= 2, pick)


def valid_link(title: Column) -> Column:
    """Whether a title can be an article: two characters, no namespace, no list, no disambiguation page."""
    spaces = "|".join(V.NAMESPACES)
    return F.coalesce((F.length(title) >= 2) & ~F.lower(title).rlike(f"^({spaces}):") & ~title.startswith("List of ") & ~title.contains("(disambiguation)"), F.lit(False))


def capitalised(text: Column) -> Column:
    """Every run of letters with its first letter upper and the rest lower, also after digits and apostrophes."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))), "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def unescaped(text: Column) -> Column:
    """The common named character references resolved."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_title(html: Column, url: Column) -> Column:
    """The title element up to a bar or dash; else the last part of the URL's path in capitals."""
    inner = unescaped(F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)))
    cut = F.trim(F.get(F.split(inner, r"\s*[|\u2013\u2014]\s*"), F.lit(0)))
    last = F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "([^/]*)$", 1)
    return F.when(cut != "", cut).otherwise(capitalised(F.translate(last, "-_", "  ")))


def page_categories(url: Column) -> Column:
    """Up to three path segments of more than two characters, in capitals, without the plain ones."""
    segments = F.slice(F.filter(F.split(url_path(url), "/"), lambda s: F.length(s) > 2), 1, 3)
    return F.filter(F.transform(segments, lambda s: capitalised(F.translate(s, "-_", "  "))), lambda s: ~F.lower(s).isin(*V.PLAIN_SEGMENTS))


def page_links(html: Column, url: Column) -> Column:
    """Distinct absolute links of the page's own host, in order: root-relative, absolute and sibling references."""
    hrefs = F.filter(F.regexp_extract_all(html, F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1)), lambda h: ~h.startswith("#") & ~h.startswith("javascript:"))
    root = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.lit("//"), url_host(url))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.concat(root, F.regexp_replace(F.when(url_path(url) == "", "/").otherwise(url_path(url)), "[^/]*$", ""))

    def absolute(h: Column) -> Column:
        return (
            F.when(h == "", url).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(root, url_path(url), h)).otherwise(F.concat(folder, h))
        )

    return F.array_distinct(F.filter(F.transform(hrefs, absolute), lambda a: url_host(a) == url_host(url)))


def text_links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1)))


def wiki_links(wikitext: Column) -> Column:
    """Targets of double-bracket links, without those in other namespaces."""
    found = F.transform(F.regexp_extract_all(wikitext, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))  # trim itself would take the place as its second argument
    return F.filter(found, lambda x: ~F.lower(x).rlike("^(file|image|category|template|wikipedia):"))


def redirect_target(wikitext: Column) -> Column:
    """The title that a page redirects to, or null."""
    return F.nullif(F.regexp_extract(wikitext, r"(?i)^\s*#REDIRECT\s*\[\[([^\]]+)\]\]", 1), F.lit(""))


def redacted(message: Column) -> Column:
    """An error message without keys, tokens, credentials and paths; names of secrets stay, quoted or in URLs."""
    rules = (
        (r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1***REDACTED***@"),
        (r"([?&](?:api[_-]?key|key|token|access_token|secret|password)=)[^&\s'\"]+", "$1***REDACTED***"),
        (r"(['\"](?:x-)?(?:api[_-]?key|token|secret|password|authorization)['\"]\s*:\s*['\"])[^'\"]+(['\"])", "$1***REDACTED***$2"),
        (r"\b(authorization:\s*(?:bearer|basic)\s+|bearer\s+)[A-Za-z0-9_\-.=+/]+", "$1***REDACTED***"),
        (r"\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)['\"]?[A-Za-z0-9_\-.]{8,}['\"]?", "$1$2***REDACTED***"),
        (r"\bsk-[A-Za-z0-9_\-]{16,}", "***REDACTED***"),
        (r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "***REDACTED_JWT***"),
        (r"(?<![\w:/])/(?:home|root|usr|var|tmp|etc|opt|users)/[^\s'\":]+", "***REDACTED_PATH***"),
    )
    return reduce(lambda x, r: F.regexp_replace(x, "(?i)" + r[0], r[1]), rules, message)


def braces(text: Column) -> Column:
    """The text from its first opening brace to its last closing one; the text itself without both."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(text)


def json_or_empty(text: Column) -> Column:
    """The text if it is a JSON object, else an empty object."""
    return F.when(F.get_json_object(text, "$").isNotNull() & F.trim(text).startswith("{"), text).otherwise("{}")


def without_fences(text: Column) -> Column:
    inside = lambda mark: F.trim(F.get(F.split(F.get(F.split(text, mark, -1), F.lit(1)), "```", -1), F.lit(0)))
    return F.when(text.contains("```json"), inside("```json")).when(text.contains("```"), inside("```")).otherwise(text)


def judge_score(text: Column, most: int | None = 10) -> Column:
    """The score in a judge's answer: its JSON field, else a number after the word score; 0 if there is none."""
    field = F.get_json_object(without_fences(text), "$.score")
    number = F.coalesce(field.try_cast("double").cast("int"), F.regexp_extract(text, r"(?i)score\D{0,5}(\d+)", 1).try_cast("int"), F.lit(0))
    return F.least(number, F.lit(most)) if most is not None else number


def version(text: Column) -> Column:
    """struct(major, minor, patch, pre) of a semantic version, null if it is none."""
    shape = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda n: F.regexp_extract(text, shape, n)
    numbers = [part(n).try_cast("int").alias(name) for n, name in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(text.rlike(shape), F.struct(*numbers, part(4).alias("pre")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a pre-release comes before its release, pre-releases by their text."""
    x, y = version(a), version(b)
    key = lambda v: F.struct(v["major"], v["minor"], v["patch"], F.when(v["pre"] == "", 1).otherwise(0), v["pre"])
    order = F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), order)


def compatible_versions(required: Column, installed: Column) -> Column:
    """Same major and not older; a pre-release only with itself."""
    x, y = version(required), version(installed)
    exact = (x["pre"] != "") | (y["pre"] != "")
    return F.when(exact, required == installed).otherwise((x["major"] == y["major"]) & (compare_versions(installed, required) >= 0))


def recency(published: Column, now: Column) -> Column:
    """0.5 without a date, 1 in the future, falling to 0 over 730 days."""
    days = F.datediff(now, published)
    return F.when(published.isNull(), 0.5).when(days <= 0, 1.0).when(days > 730, 0.0).otherwise(1 - days / 730)


def url_rank(authority: Column, fresh: Column, content: Column) -> Column:
    return 0.4 * authority + 0.3 * fresh + 0.3 * content


def safe_url(url: Column) -> Column:
    """https with a host that isn't local or a private address as written; names aren't resolved."""
    host = F.lower(F.regexp_replace(url_host(url), r":\d+$|^[^@]*@", ""))
    private = r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|0\.|22[4-9]\.|2[3-5]\d\.|\[)|\.(local|internal)$"
    return F.coalesce(url.startswith("https://") & (host != "") & ~host.rlike(private), F.lit(False))


def pack_name_ok(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$")


def progress_bar(done: Column, total: Column, width: int = 40) -> Column:
    full = F.floor(F.least(F.lit(1.0), done / F.greatest(total, F.lit(1))) * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("]"))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def wiki_url(title: Column) -> Column:
    """The title with underscores, percent-encoded but for / : @."""
    coded = F.url_encode(F.translate(title, " ", "_"))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))


def title_of_url(url: Column) -> Column:
    """The last path segment without .html, hyphens as blanks, in capitals; the one before where it is empty."""
    parts = F.split(F.regexp_replace(url, r"/+$", ""), "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"\.html$", "")
    return capitalised(F.translate(F.when(last != "", last).otherwise(F.try_element_at(parts, F.lit(-2))), "-", " "))


def heading_sections(markdown: Column) -> Column:
    """Texts between lines that begin with #, as array<struct<title, content>>, none empty."""
    marked = F.regexp_replace(markdown, r"(?m)^#+[ \t]*(.*)$", "\u0001$1\u0002")
    parts = F.transform(
        F.split(marked, "\u0001", -1),
        lambda p, i: F.struct(
            F.when(i == 0, "").otherwise(F.trim(F.substring_index(p, "\u0002", 1))).alias("title"), F.regexp_replace(F.when(i == 0, p).otherwise(F.substring_index(p, "\u0002", -1)), r"^\s+|\s+$", "").alias("content")
        ),
    )
    return F.filter(parts, lambda s: s["content"] != "")


def listed_urls(xml: Column) -> Column:
    """Addresses in a sitemap (loc elements) or a feed (link elements and attributes), in order, once each."""
    found = F.regexp_extract_all(xml, F.lit(r"<(?:loc|link)[^>]*>\s*(?:<!\[CDATA\[)?\s*(https?://[^<\]\s]+)"), F.lit(1))
    attributes = F.regexp_extract_all(xml, F.lit(r"<link[^>]+href=[\"'](https?://[^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(found, attributes), unescaped))


def safe_query(text: Column) -> Column:
    """Whether a graph query only reads: it begins with MATCH or CALL, has no writing word outside quotes and no open-length pattern."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), "'[^']*'", ""))
    return F.trim(bare).rlike(r"^(MATCH|CALL)\b") & ~bare.rlike(r"\b(CREATE|DELETE|DROP|SET|MERGE|REMOVE|DETACH)\b") & ~text.rlike(r"\[[\w:]*\*[^\]]*\]")


def relations_sane(raw: Column) -> Column:
    """array<struct<source,relation,target,context>> without blanks, relations in canonical form, texts cut."""
    ok = F.filter(raw, lambda r: r.isNotNull() & (F.coalesce(F.trim(r["source"]), F.lit("")) != "") & (F.coalesce(F.trim(r["target"]), F.lit("")) != ""))
    form = lambda r: F.when(F.coalesce(F.trim(r["relation"]), F.lit("")) == "", "related_to").otherwise(relation(r["relation"]))
    return F.transform(ok, lambda r: F.struct(F.substring(F.trim(r["source"]), 1, 256).alias("source"), form(r).alias("relation"), F.substring(F.trim(r["target"]), 1, 256).alias("target"), F.substring(F.coalesce(r["context"], F.lit("")), 1, 1024).alias("context")))


def facts_sane(raw: Column) -> Column:
    """Facts without blanks, cut at 1024 characters."""
    return F.transform(F.filter(raw, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.substring(F.trim(x), 1, 1024))
