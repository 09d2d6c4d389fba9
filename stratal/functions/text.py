"""String, URL, HTML and Markdown expressions; Catalyst expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Query keys that only track a visit.
TRACKING = r"(?i)^(utm_.*|ref|source|fbclid|gclid)$"
# The terms whose occurrences make the topic score.
TOPIC_TERMS = ["robot", "robotics", "humanoid", "embodied", "physical ai", "manipulation", "locomotion", "world model", "vision-language-action", "vla", "autonomous"]
# Substrings by error class, in order of priority, and those of errors worth a retry.
ERROR_CLASSES = [
    ("capacity", ["model is at capacity"]),
    ("quota", ["quota", "usage limit", "billing", "credits"]),
    ("authentication", ["unauthorized", "authentication", "token expired"]),
    ("network", ["network", "connection", "timed out", "timeout"]),
]
RETRYABLE = ["rate_limit", "rate limit", "timeout", "timed out", "network", "temporarily unavailable", "service unavailable", "bad gateway", "gateway timeout", "connection reset"]
# Key parts whose map values are secret.
SECRET_KEYS = ["authorization", "cookie", "token", "secret", "password", "key"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(*columns) -> Column:
    """The first that is neither null nor empty, else the last: `a or b` on strings."""
    *first, last = [_c(c) for c in columns]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in first), last)


def collapse(x) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def host(url) -> Column:
    """Lower-cased host without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _requoted(part: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url) -> Column:
    """Lower-cased scheme and authority, no tracking keys, re-encoded query, no trailing slash, parameters or fragment.

    An empty path becomes "/"; one of slashes only but longer than one becomes empty. Null where there is no scheme.
    """
    url = _c(url)
    part = lambda n: F.regexp_extract(url, URL, n)
    bare = F.regexp_replace(part(3), ";[^/]*$", "")
    path = F.when(bare.isin("", "/"), "/").otherwise(F.regexp_replace(bare, "/+$", ""))
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING))
    pairs = F.transform(pairs, lambda p: F.concat(_requoted(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("="), _requoted(F.regexp_extract(p, "^[^=]*=(.*)$", 1))))
    query = F.array_join(pairs, "&")
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(1) != "", out)


def contains_any(x, needles: list[str]) -> Column:
    """True if one of the needles occurs; no needles admit everything."""
    if not needles:
        return F.lit(True)
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(_c(x), F.lit(needle))
    return out


def post_id(path) -> Column:
    """Digits between "/status/" and the next "?" or "/"; null otherwise."""
    return F.nullif(F.regexp_extract(_c(path), r"/status/([0-9]+)(?:[?/]|$)", 1), F.lit(""))


def repository_name(href) -> Column:
    """owner/name of a link with exactly those two segments, else null."""
    name = F.trim(_c(href), F.lit("/"))
    return F.when(name.rlike("^[^/]+/[^/]+$"), name)


def arxiv_id(url) -> Column:
    return F.nullif(F.regexp_extract(_c(url), r"arxiv\.org/(?:abs|pdf)/(\d+\.\d+)(?:v(\d+))?", 1), F.lit(""))


def arxiv_version(url) -> Column:
    return F.nullif(F.regexp_extract(_c(url), r"arxiv\.org/(?:abs|pdf)/(\d+\.\d+)(?:v(\d+))?", 2), F.lit("")).cast("int")


def safe_id(x) -> Column:
    return F.translate(_c(x), "/:", "__")


def key_slug(x, longest: int = 48) -> Column:
    """Lower-cased, other characters as "_"; a longer key is cut and told apart by six digits of its hash."""
    slug = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_-]+", "_")
    return F.when(F.length(slug) <= longest, slug).otherwise(F.concat(F.left(slug, F.lit(longest - 7)), F.lit("-"), F.left(F.sha2(_c(x), 256), F.lit(6))))


def valid_id(x, longest: int = 64) -> Column:
    return _c(x).rlike(rf"\A[a-z0-9][a-z0-9_-]{{0,{longest - 1}}}\z")


def markdown_title(x) -> Column:
    """The first line that starts with "# ", trimmed; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(_c(x), r"(?m)^# (.*)$", 1)), F.lit(""))


def replace_title(x, title) -> Column:
    """The first such line replaced, or the title put first."""
    x, title = _c(x), _c(title)
    safe = F.regexp_replace(title, r"([\\$])", r"\\$1")
    return F.when(x.rlike(r"(?m)^# .*$"), F.regexp_replace(x, F.lit(r"(?s)\A((?:(?!# )[^\n]*\n)*)# [^\n]*"), F.concat(F.lit("$1# "), safe))).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), x))


def rewrite_links(content, ids, urls: Column, scheme: str = "report") -> Column:
    """Every scheme://id replaced by its url, longest ids first, never inside a longer id or after a longer scheme."""
    order = F.array_sort(_c(ids), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    step = lambda text, i: F.regexp_replace(text, F.concat(F.lit(rf"(?<![a-z]){scheme}://"), i, F.lit("(?![a-z0-9_-])")), F.regexp_replace(urls[i], r"([\\$])", r"\\$1"))
    return F.aggregate(order, _c(content), step)


def unknown_links(content, ids, scheme: str = "report") -> Column:
    """The ids of scheme:// links in the content that are none of the given, each once, in order; a rewrite may go on only if there is none."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(_c(content), F.lit(rf"(?<![a-z]){scheme}://([a-z0-9_-]+)"), F.lit(1))), _c(ids))


def has_link(content, key, scheme: str = "report") -> Column:
    return F.regexp_like(_c(content), F.concat(F.lit(rf"(?<![a-z]){scheme}://"), _c(key), F.lit("(?![a-z0-9_-])")))


# The named references of HTML 4 come with the language's library; the space that does not break is read as a space.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def unescaped(x) -> Column:
    """Character references, named, decimal and hexadecimal ones, each read once; what is none stays as it is."""
    known = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])
    parts = F.split(x, "&")

    def read(part):
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("int")).when(name.startswith("#"), F.substr(name, F.lit(2)).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.when(code == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(known, name))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), read)
    return F.when(F.contains(x, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(x)


def html_title(x, longest: int = 500) -> Column:
    return F.left(unescaped(collapse(F.regexp_extract(_c(x), "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(longest))


def html_description(x, longest: int = 1000) -> Column:
    return F.left(unescaped(F.regexp_extract(_c(x), "(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)), F.lit(longest))


def html_text(x) -> Column:
    """Text without scripts, styles and markup, white space collapsed."""
    x = F.regexp_replace(_c(x), "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    return collapse(unescaped(F.regexp_replace(x, "(?s)<[^>]*>", " ")))


def html_hrefs(x) -> Column:
    """Targets of the anchors, in page order, in double, single or no quotes."""
    found = F.regexp_extract_all(_c(x), F.lit("""(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>]+)"""), 1)
    return F.transform(found, lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))


def absolute_url(href, base) -> Column:
    """A target against its page: absolute, protocol-relative, root-relative, or beside the page."""
    href, base = _c(href), _c(base)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), "(?<=[^/:]/)[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def occurrences(x, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def topic_score(x, terms: list[str] | None = None) -> Column:
    low = F.lower(_c(x))
    out = F.lit(0)
    for term in terms or TOPIC_TERMS:
        out = out + occurrences(low, term)
    return out


def error_class(x) -> Column:
    low, out = F.lower(_c(x)), F
    for name, parts in ERROR_CLASSES:
        out = out.when(contains_any(low, parts), name)
    return out.otherwise("process_error")


def retryable(x) -> Column:
    return contains_any(F.lower(_c(x)), RETRYABLE)


def redacted(m) -> Column:
    """Values of keys with a secret part replaced."""
    return F.transform_values(_c(m), lambda k, v: F.when(contains_any(F.lower(k), SECRET_KEYS), "<redacted>").otherwise(v))


def source_group(source) -> Column:
    source = _c(source)
    return F.when(source.isin("x_list", "x_for_you"), source).when(source.isin("github", "github_trending"), "github").when(source.isin("arxiv", "huggingface"), "papers").when(source == "hackernews", "hackernews").otherwise("articles")


def unit_id(entity_key) -> Column:
    return F.concat(F.lit("u_"), F.left(F.sha2(_c(entity_key), 256), F.lit(20)))


def blob_ref(content, suffix: str = "") -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(content), 256), F.lit(suffix))


def blob_path(ref) -> Column:
    """Where a content reference is stored: blobs/<first two digits>/<digits and suffix>."""
    name = F.regexp_replace(_c(ref), "^sha256:", "")
    return F.concat(F.lit("blobs/"), F.left(name, F.lit(2)), F.lit("/"), name)


def breadcrumb(titles, urls) -> Column:
    return F.array_join(F.transform(F.arrays_zip(_c(titles).alias("t"), _c(urls).alias("u")), lambda x: F.concat(F.lit("["), x["t"], F.lit("]("), x["u"], F.lit(")"))), " / ")
