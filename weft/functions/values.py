"""Small values: addresses, references, parameters, licences, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import col, strip_credentials, ticket

#: Roles of query parameters by name.
PARAMETER_ROLES = {
    ("pagination", "page"): "page p pagenumber pageindex pageno",
    ("pagination", "pageSize"): "pagesize page_size perpage per_page limit size take count",
    ("pagination", "offset"): "offset skip start from",
    ("pagination", "cursor"): "cursor after before next nexttoken continuation",
    ("sort", "param"): "sort sortby sort_by order orderby order_by ordering direction dir",
    ("search", "param"): "q query search term keyword keywords text s",
}
LOOPBACK = r"^(?:localhost|.*\.localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[::1?\])$"
SECRET_NAME = r"(?i)pass(?:word|wd)?|secret|token|api_?key|credential|private"


def application_key(url: Column | str) -> Column:
    """host:port of a web address, every loopback name one host, no dot at the end; null off the web."""
    u = F.lower(F.trim(col(url)))
    part = lambda i: F.regexp_extract(u, r"^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::(\d+))?(?:[/?#]|$)", i)
    host = F.regexp_replace(part(2), r"\.$", "")
    port = F.when(((part(1) == "http") & (part(3) == "80")) | ((part(1) == "https") & (part(3) == "443")), "").otherwise(part(3))
    return F.when(part(1) != "", F.concat(F.when(host.rlike(LOOPBACK), "loopback").otherwise(host), F.lit(":"), port))


def ticket_url(reference: Column | str, templates: dict[str, str]) -> Column:
    """Address of a ticket reference from its tool's https template with {id} and {repo} (H31), null without one."""
    ref, tool = col(reference), ticket(reference)
    number = F.regexp_extract(ref, r"#?([A-Z][A-Z0-9]+-\d+|\d+)$", 1)
    repo = F.array_join(F.transform(F.split(F.regexp_extract(ref, "^([^#]*)#", 1), "/"), lambda x: F.url_encode(x)), "/")
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        if template.startswith("https://") and "{id}" in template:
            out = F.when(tool == name, F.replace(F.replace(F.lit(template), F.lit("{id}"), F.url_encode(number)), F.lit("{repo}"), repo)).otherwise(out)
    return out


def parameter_role(name: Column | str) -> Column:
    """family and signal of a query parameter (H47); an unknown name is a filter."""
    n = F.lower(col(name))
    out = F.struct(F.lit("filter").alias("family"), F.lit("param").alias("signal"))
    for (family, signal), names in PARAMETER_ROLES.items():
        out = F.when(n.isin(*names.split()), F.struct(F.lit(family).alias("family"), F.lit(signal).alias("signal"))).otherwise(out)
    return out


def safe_value(value: Column | str, family: Column, field: Column) -> Column:
    """What of a value may be kept (H48): a number of up to eight digits, an order's direction, a schedule; nothing of a secret field or a long text."""
    v = F.trim(col(value))
    interval = r"^(?:\S+\s+){4,5}\S+$|^\d+\s*(?:ms|s|m|h|d|seconds?|minutes?|hours?|days?)$"
    few_digits = F.length(F.regexp_replace(v, r"\D", "")) < 9
    kept = F.when(v.rlike(r"^-?\d{1,8}$"), v).when((family == "sort") & v.rlike("(?i)^(?:asc|desc)$"), F.lower(v)).when((family == "schedule") & few_digits & v.rlike(interval), v)
    return F.when((F.length(col(value)) <= 200) & ~F.coalesce(field, F.lit("")).rlike(SECRET_NAME), kept)


def licence_name(licence: Column, licences: Column) -> Column:
    """The licence a package names (H38): the text, else the types of its list joined by OR; without user and password of an address."""
    listed = F.array_join(F.filter(licences, lambda x: x.isNotNull() & (x != "")), " OR ")
    return strip_credentials(F.coalesce(F.nullif(F.trim(licence), F.lit("")), F.nullif(listed, F.lit(""))))


def checksum(text: Column | str) -> Column:
    """CRC-32 of the UTF-8 bytes."""
    return F.crc32(col(text).cast("binary"))


def edits(first: Column | str, second: Column | str, most: int | None = None) -> Column:
    """Inserted, deleted and replaced characters between two texts (H21); -1 beyond ``most``."""
    return F.levenshtein(col(first), col(second)) if most is None else F.levenshtein(col(first), col(second), most)


def route_parameters(route: Column | str) -> Column:
    """Names of a route's parameters of any spelling, in order."""
    found = F.regexp_extract_all(col(route), F.lit(r"(:[A-Za-z_]\w*|\{[^}/]+\}|\[[^\]/]+\])"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^[:{\[](?:\.\.\.)?|[}\]]$", ""))


def zone_share(x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """A zone in pixels as per cent of its frame, cut at the frame's edges, two decimals."""
    part = lambda at, size, whole: (F.greatest(at, F.lit(0)), F.least(at + size, whole))
    (left, right), (top, bottom) = part(x, width, frame_width), part(y, height, frame_height)
    share = lambda n, whole: F.round(100 * F.greatest(n, F.lit(0)) / whole, 2)
    return F.struct(share(left, frame_width).alias("x"), share(top, frame_height).alias("y"), share(right - left, frame_width).alias("w"), share(bottom - top, frame_height).alias("h"))


def blocked_request(url: Column | str) -> Column:
    """A request without its query; paths of bot challenges are one."""
    bare = F.regexp_replace(col(url), r"[?#].*$", "")
    return F.regexp_replace(bare, r"(/cdn-cgi/challenge-platform)/.*$", "$1/…")
