"""Links and weight of HTML pages."""

from pyspark.sql import Column, DataFrame, functions as F

# What counts as a link.
SKIPPED = ("mailto:", "tel:", "javascript:", "data:", "#")
URL_META = ("og:image", "og:url", "twitter:image")
LINK_RELS = ("stylesheet", "icon", "apple-touch-icon", "canonical", "alternate", "manifest")
LINK_ATTRIBUTES = ("href", "src", "srcset")
# What counts as an asset, and the budget of a page.
ASSET_ENDINGS = (".css", ".js", ".png", ".svg", ".ico", ".woff", ".woff2", ".jpg")
ASSET_FOLDERS = ("/assets/", "/css/", "/js/")
ASSET_PREFIXES = ("http://", "https://", "#", "mailto:", "data:")
BUDGET_BYTES = 500 * 1024

_HIDDEN = r"(?is)<!--.*?-->|(<script\b[^>]*>).*?</script\s*>|(<style\b[^>]*>).*?</style\s*>"
_TAG = r"""(?is)<(?:a|link|img|script|iframe|source|meta)(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*+)?>"""


def _numeric_entities(value: Column) -> Column:
    """``&#233;`` and ``&#xe9;`` as characters; numbers that are none stay as they are."""
    codes = F.array_distinct(F.regexp_extract_all(value, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def resolve(text, code):
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        known = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(known, F.replace(text, F.concat(F.lit("&#"), code, F.lit(";")), char)).otherwise(text)

    return F.when(F.contains(value, F.lit("&#")), F.aggregate(codes, value, resolve)).otherwise(value)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quotes removed and entities resolved; NULL when absent."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    value = F.regexp_replace(raw, r"""\A["']|["']\z""", "")
    value = _numeric_entities(value)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(raw != "", value)


def raw_links(html: Column) -> Column:
    """Distinct link texts of a page; an empty text marks a list with a missing entry."""
    shown = F.regexp_replace(html, _HIDDEN, "$1$2")
    tags = F.regexp_extract_all(shown, F.lit(_TAG), F.lit(0))

    def of(tag):
        name = F.lower(F.regexp_extract(tag, r"(?i)^<([a-z]+)", 1))
        key = F.lower(F.coalesce(F.nullif(_attribute(tag, "property"), F.lit("")), _attribute(tag, "name"), F.lit("")))
        content = F.trim(F.coalesce(_attribute(tag, "content"), F.lit("")))
        meta = F.when(key.isin(*URL_META) & (content != ""), F.array(content))
        rels = F.filter(F.split(F.lower(F.coalesce(_attribute(tag, "rel"), F.lit(""))), r"\s+"), lambda r: r != "")
        unrelated = (name == "link") & (F.size(rels) > 0) & \
            ~F.arrays_overlap(rels, F.array(*[F.lit(r) for r in LINK_RELS]))
        parts = F.flatten(F.filter(F.array(*[
            F.when(F.coalesce(_attribute(tag, a), F.lit("")) != "", F.split(_attribute(tag, a), ","))
            for a in LINK_ATTRIBUTES]), lambda x: x.isNotNull()))
        words = F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*(\S*)", 1))
        return F.when(name == "meta", F.coalesce(meta, F.array().cast("array<string>"))) \
            .when(unrelated, F.array().cast("array<string>")).otherwise(words)

    return F.array_distinct(F.flatten(F.transform(tags, of)))


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)


def _folder(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))


def _clean_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    # a final dot segment still names a folder
    last = F.element_at(parts, -1)
    text = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & ~text.endswith("/"), F.concat(text, F.lit("/"))).otherwise(text)


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page, in absolute form."""
    site, folder = site_of(base), _folder(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z]+:)", 1)
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.substr(link, F.length(path) + 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    dots = path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    def resolved(p):
        return F.concat(site, F.when(dots, _clean_path(p)).otherwise(p), tail)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), resolved(path))
            .when(link.startswith("?"), F.concat(bare, link))
            .when(link == "", base)
            .otherwise(resolved(F.concat(folder, path))))


def _any_prefix(col: Column, prefixes) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | col.startswith(prefix)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """Links of every page: ``page_id, url, link, target, kind``; kind is ``page``, ``asset``
    or ``external``."""
    found = pages.select("page_id", "url", F.explode_outer(raw_links(F.col("html"))).alias("link")) \
        .filter(F.col("link").isNotNull() & (F.col("link") != "") & ~_any_prefix(F.col("link"), SKIPPED))
    rows = found.withColumn("target", absolute(F.col("url"), F.col("link"))) \
        .filter(_any_prefix(F.col("target"), ("http://", "https://")))
    inside = F.startswith("target", site_of(F.col("url")))
    kind = F.when(~inside, "external").when(F.col("target").rlike(r"(?:\.html|/)$"), "page").otherwise("asset")
    return rows.withColumn("kind", kind)


def _address(url: Column) -> Column:
    """A URL without its fragment, which is never sent."""
    return F.regexp_replace(url, "#.*", "")


def broken_links(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Internal links that lead to no known page: ``page_id, problem, target``.

    A page whose link list has an empty entry is reported as unreadable too; its other links
    are checked, unless ``strict`` leaves such pages at that.  The check is an anti join on
    the address; a much linked address is split by adaptive execution.
    """
    known = pages.select(_address(F.col("url")).alias("address")).distinct()
    missing = page_links(pages).filter(F.col("kind") != "external") \
        .withColumn("address", _address(F.col("target"))).join(known, "address", "left_anti") \
        .select("page_id", F.lit("BROKEN").alias("problem"), "target").distinct()
    unreadable = pages.filter(F.array_contains(raw_links(F.col("html")), "")) \
        .select("page_id", F.lit("PARSE ERROR").alias("problem"), F.col("url").alias("target"))
    if strict:
        missing = missing.join(unreadable.select("page_id"), "page_id", "left_anti")
    return missing.unionByName(unreadable)


def page_assets(pages: DataFrame) -> DataFrame:
    """Distinct assets of every page: ``page_id, asset``."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]+)"'), F.lit(1)))
    links = pages.select("page_id", "url", F.explode_outer(found).alias("link")).filter(F.col("link").isNotNull())
    own = F.startswith("link", F.col("url"))
    rows = links.filter(~_any_prefix(F.col("link"), ASSET_PREFIXES) | own) \
        .withColumn("asset", absolute(F.col("url"), F.col("link")))
    wanted = F.lit(False)
    for ending in ASSET_ENDINGS:
        wanted = wanted | F.col("asset").endswith(ending)
    for folder in ASSET_FOLDERS:
        wanted = wanted | F.contains("asset", F.lit(folder))
    return rows.filter(wanted).select("page_id", "asset").distinct()


def page_weight(pages: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """Bytes of every page with the assets that are known, and whether it is over budget."""
    sizes = pages.groupBy(F.col("url").alias("asset")).agg(F.max(F.octet_length("html")).alias("bytes"))
    used = page_assets(pages).join(sizes, "asset", "left").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("asset_bytes"))
    total = F.col("html_bytes") + F.col("asset_bytes")
    return pages.select("page_id", F.octet_length("html").alias("html_bytes")) \
        .join(used, "page_id", "left").na.fill(0, ["assets", "asset_bytes"]) \
        .withColumn("total_bytes", total.cast("long")).withColumn("over_budget", total > budget)
