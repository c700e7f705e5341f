"""Column functions over text, addresses and scores."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.rows import once

#: Fixed values.
PAYWALL_PHRASES = ("subscribe to continue reading", "subscribe to read", "to continue reading this story", "this article is for subscribers", "subscriber-only content", "members-only content")
FLAG_REASONS = ("thin", "js_shell", "paywall_challenge", "truncated", "wrong_body", "unrecoverable", "other")
SCORE_CAP = 0.3
THIN = 500
SNIPPET_RADIUS = 120
SOURCE_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
SOURCE_KEY_PREFIX = "trend-intelligence-brain:source:"
NO_TEXT = "NO_TEXT"
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def canonicalize_url(url: Column) -> Column:
    """Without outer blanks, query and fragment; scheme and authority in lower case, the path as it is."""
    scheme, host, path = (F.regexp_extract(F.trim(url), _URI, k) for k in (1, 2, 3))
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""), path)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 2))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 3)


def absolutize(link: Column, base: Column) -> Column:
    """A link as an absolute address on a page: absolute, scheme-relative, rooted or relative."""
    scheme = F.regexp_extract(base, _URI, 1)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/.*/|/)?)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))


def normalize_text(c: Column) -> Column:
    """Trimmed, runs of any white space as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@cache
def _named() -> str:
    """All named entities that end in a semicolon, as JSON."""
    return json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})


def _entity(name: Column) -> Column:
    """The character of what stands between & and ;, by number or by name; null for none."""
    hexa, digits = F.regexp_extract(name, "^#[xX]([0-9A-Fa-f]{1,6})$", 1), F.regexp_extract(name, r"^#(\d{1,7})$", 1)
    code = F.coalesce(F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("int"), F.nullif(digits, F.lit("")).cast("int"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.coalesce(number, F.element_at(F.from_json(F.lit(_named()), "map<string,string>"), name))


def unescape(c: Column) -> Column:
    """Entities as the characters they stand for; what isn't one stays."""
    pattern = "&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def plain(c: Column) -> Column:
        gaps, names = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        parts = F.zip_with(gaps, names, lambda g, n: F.concat(g, F.when(n.isNull(), "").otherwise(F.coalesce(_entity(n), F.concat(F.lit("&"), n, F.lit(";"))))))
        return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)

    return once(c, plain)


def strip_html(c: Column) -> Column:
    """Tags as blanks, entities as characters."""
    return normalize_text(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(normalize_text(title), F.lit("\n"), normalize_text(content)), 256)


def source_uuid(name: Column) -> Column:
    """UUID version 5 of a source in the address namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(SOURCE_NAMESPACE.replace("-", ""))), F.encode(F.concat(F.lit(SOURCE_KEY_PREFIX), name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_paywalled(content: Column) -> Column:
    low = F.lower(content)
    out = F.lit(False)
    for phrase in PAYWALL_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def effective_score(score: Column, flag_reason: Column, capped: Column) -> Column:
    """The score, at most SCORE_CAP for flagged or paywalled documents."""
    limit = (flag_reason.isNotNull() | capped) & (score > SCORE_CAP)  # a null score stays null
    return F.when(limit, F.lit(SCORE_CAP)).otherwise(score)


def parse_time(raw: Column) -> Column:
    """ISO 8601 or RFC 822; null for anything else."""
    plain = F.trim(F.regexp_replace(raw, r"^[A-Za-z]{3},?\s+", ""))
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def as_utc(c: Column) -> Column:
    """A time as ISO 8601 in UTC, microseconds only where there are any; sessions run in UTC, so a time without zone is UTC's."""
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != ".000000", fraction).otherwise(""), F.lit("+00:00"))


def snippet(content: Column, title: Column, keyword: str, radius: int = SNIPPET_RADIUS) -> Column:
    """The first place of a keyword with its surroundings; the beginning where it isn't found."""
    body = F.when(F.coalesce(content, F.lit("")) != "", content).otherwise(F.coalesce(title, F.lit("")))
    at = F.locate(keyword.lower(), F.lower(body))
    begin = F.greatest(at - radius, F.lit(1))
    stop = F.least(at + len(keyword) + radius, F.length(body) + 1)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.trim(F.substring(body, begin, stop - begin)), F.when(stop <= F.length(body), "…").otherwise(""))
    head = F.concat(F.substring(body, 1, 2 * radius), F.when(F.length(body) > 2 * radius, "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(head)


def is_thin(c: Column, threshold: int | Column = THIN) -> Column:
    return F.length(normalize_text(F.coalesce(c, F.lit("")))) < threshold


def cause_text(c: Column, most: int = 512) -> Column:
    return F.substring(normalize_text(c), 1, most)


def canonical_post_url(url: Column) -> Column:
    """A post's permalink: /reel/ as /p/, lower-case host, one slash at the end."""
    plain = F.regexp_replace(canonicalize_url(F.trim(url)), r"(?<=[a-z0-9])/reel/", "/p/")
    return F.when(plain.endswith("/") | (path_of(plain) == ""), plain).otherwise(F.concat(plain, F.lit("/")))


def post_title(caption: Column, handle: Column, code: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(caption, F.lit("")), r"\r\n|[\n\r]"), normalize_text), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), normalize_text(F.concat(F.lit("@"), handle, F.lit(" — "), code)))


def has_text(image_text: Column) -> Column:
    return image_text != NO_TEXT


def transcription(raw: Column) -> Column:
    """A model's answer as it is stored: the sentinel whatever its case and the blanks and dots around it."""
    return F.when(F.upper(F.regexp_replace(raw, r"^[ .\n\t]+|[ .\n\t]+$", "")) == NO_TEXT, F.lit(NO_TEXT)).otherwise(raw)


def normalize_language(raw: Column) -> Column:
    """en, pt or es of a label, by the whole label or what stands before the first separator; en for any other."""
    key = F.lower(F.trim(raw))
    out = F.lit("en")
    for part in (F.regexp_extract(key, "^[^-_ /]*", 0), key):
        out = F.when(part.isin("portuguese", "português", "portugues", "pt"), "pt").when(part.isin("spanish", "español", "espanol", "es"), "es").when(part.isin("english", "en"), "en").otherwise(out)
    return F.when(raw.isNull(), "en").otherwise(out)
