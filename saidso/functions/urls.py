"""URL columns: keys for joining, signed parameters, video ids, public hosts, deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saidso.functions.binding import let

# Query parameters that sign a URL for one reader (fixed values).
SIGNED_PARAM = r"(?i)^(?:authorization|signature|sig|token|access_token|id_token|policy|key-pair-id|x-amz-.+|x-goog-.+)$"
SOCIAL_HOSTS = r"(?i)(?:^|\.)(?:x\.com|twitter\.com|linkedin\.com|threads\.net|facebook\.com|instagram\.com|tiktok\.com)$"
LOCAL_HOSTS = r"\.(?:localhost|local|internal|lan|home\.arpa)$"
AUDIO_EXTENSIONS = r"\.(?:mp3|m4a|wav|webm|mp4|mpeg|mpga|ogg|flac)$"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
KEY_SHAPED = r"(?<![A-Za-z0-9])sk-(?=[A-Za-z0-9_*-]{20})(?=[a-z0-9_*-]*[A-Z])[A-Za-z0-9_*-]+"
HTTP_URL = r"https?://[^\s\"'\\<>]+"


_PARTS = r"(?is)^(https?)://((?:[^/?#\\\\]*@)?)(\[[^\]/?#]*\]|[^/?#:@\\\\]+)(:\d*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_CUT = "\x01"


def parse(url: Column) -> Column:
    """STRUCT<ok, scheme, user, host, port, path, search, fragment, params>; one regular expression match per URL."""
    cut = F.split(F.regexp_replace(F.trim(url), _PARTS, _CUT.join(f"${i}" for i in range(1, 8))), _CUT)

    def fields(a: Column) -> Column:
        route = F.replace(F.get(a, 4), F.lit("\\"), F.lit("/"))
        search = F.get(a, 5)
        return F.struct(
            (F.size(a) == 7).alias("ok"),
            F.lower(F.get(a, 0)).alias("scheme"),
            F.get(a, 1).alias("user"),
            F.lower(F.get(a, 2)).alias("host"),
            F.get(a, 3).alias("port"),
            F.concat(F.when(route.startswith("/"), "").otherwise("/"), route).alias("path"),
            search.alias("search"),
            F.get(a, 6).alias("fragment"),
            F.when(search == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(F.substr(search, F.lit(2)), "&"), lambda p: p != "")).alias("params"),
        )

    return let(cut, fields)


def is_http(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_PARTS), F.lit(False))


def _name(param: Column) -> Column:
    return F.substring_index(param, "=", 1)


def _param(u: Column, name: str) -> Column:
    first = F.try_element_at(F.filter(u["params"], lambda p: _name(p) == name), F.lit(1))
    return F.when(F.contains(first, F.lit("=")), F.regexp_replace(first, r"^[^=]*=", "")).when(first.isNotNull(), "")


def _search(u: Column, kept: Column) -> Column:
    """The query string after dropping parameters; untouched when none was dropped."""
    rewritten = F.array_join(
        F.transform(
            kept,
            lambda p: F.replace(F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))), F.lit("%20"), F.lit("+")),
        ),
        "&",
    )
    same = F.when(u["search"] == "?", "").otherwise(u["search"])
    return F.when(F.size(kept) == F.size(u["params"]), same).when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), rewritten))


def _authority(u: Column) -> Column:
    """User info as written, host in lower case, no default port."""
    default = (u["port"] == ":") | ((u["scheme"] == "http") & (u["port"] == ":80")) | ((u["scheme"] == "https") & (u["port"] == ":443"))
    return F.concat(u["user"], u["host"], F.when(default, "").otherwise(u["port"]))


def _clean(u: Column, url: Column) -> Column:
    kept = F.filter(u["params"], lambda p: ~_name(p).rlike(SIGNED_PARAM))
    rebuilt = let(kept, lambda k: F.concat(u["scheme"], F.lit("://"), _authority(u), u["path"], _search(u, k), u["fragment"]))
    return F.when(u["ok"] & F.exists(u["params"], lambda p: _name(p).rlike(SIGNED_PARAM)), rebuilt).otherwise(url)


def strip_signed_params(url: Column) -> Column:
    """`url` without signing parameters; anything else comes back unchanged."""
    return F.when(F.contains(url, F.lit("?")), let(parse(url), lambda u: _clean(u, url))).otherwise(url)


def scrub_text(text: Column) -> Column:
    """Signing parameters stripped from every URL inside `text`, key-shaped tokens redacted."""
    safe = F.regexp_replace(text, KEY_SHAPED, "sk-REDACTED")
    urls = F.array_distinct(F.regexp_extract_all(safe, F.lit(f"({HTTP_URL})"), F.lit(1)))
    # Longest first, so a URL that is a prefix of another never rewrites it.
    ordered = F.transform(
        F.sort_array(F.transform(urls, lambda u: F.struct((-F.length(u)).alias("n"), u.alias("u")))), lambda x: x["u"]
    )
    return F.aggregate(ordered, safe, lambda acc, u: F.replace(acc, u, strip_signed_params(u)))


def _key(u: Column) -> Column:
    kept = F.filter(u["params"], lambda p: ~F.lower(_name(p)).startswith("utm_") & ~_name(p).rlike(SIGNED_PARAM))
    page = F.concat(F.regexp_replace(u["host"], r"^www\.", ""), F.rtrim(u["path"], F.lit("/")))
    return F.when(u["ok"], F.concat(page, F.when(u["search"] == "", "").otherwise(let(kept, lambda k: _search(u, k)))))


def url_key(url: Column) -> Column:
    """Join key of a page: host without 'www.', path without trailing slashes, no hash, no tracking or signing parameters."""
    return let(parse(url), _key)


def page_ref(url: Column, missing: str = "") -> Column:
    """STRUCT<url, key>: the URL without signing parameters and its key, from one parse; `missing` stands for no key.

    A key that is never NULL gives the optimizer no null check to push below the
    parse, which would run it twice.
    """
    return let(parse(url), lambda u: F.struct(_clean(u, F.trim(url)).alias("url"), F.coalesce(_key(u), F.lit(missing)).alias("key")))


def _site(u: Column) -> Column:
    return F.regexp_replace(u["host"], r"^(?:www|m|music)\.", "")


def _on_youtube(u: Column) -> Column:
    return u["ok"] & _site(u).isin("youtube.com", "youtu.be", "youtube-nocookie.com")


def is_youtube(url: Column) -> Column:
    return F.coalesce(let(parse(url), _on_youtube), F.lit(False))


def youtube_id(url: Column) -> Column:
    """The 11-character video id of any YouTube URL form, else NULL."""

    def video(u: Column) -> Column:
        parts = F.filter(F.split(u["path"], "/"), lambda p: p != "")
        first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
        in_path = F.when(first.isin("live", "embed", "shorts", "v", "e"), second)
        found = F.when(_site(u) == "youtu.be", first).otherwise(F.coalesce(_param(u, "v"), in_path))
        return F.when(_on_youtube(u), F.when(found.rlike(VIDEO_ID), found))

    return F.when(F.lower(url).rlike("youtu"), let(parse(url), video))


def source_key(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("youtube:"), youtube_id(url)), url_key(url))


def transcript_key(source: Column) -> Column:
    """Store key of a transcript: the video, else the URL without hash and signing parameters, else the file."""
    page = F.regexp_replace(strip_signed_params(F.trim(source)), "#.*$", "")
    key = F.coalesce(
        F.concat(F.lit("youtube:"), youtube_id(source)), F.when(is_http(source), page).otherwise(F.concat(F.lit("file:"), source))
    )
    return F.substring(F.sha2(key, 256), 1, 16)


def _ipv4_number(host: Column) -> Column:
    """The value of a numeric host in any spelling (dotted, short, octal, hex), else NULL; parts too long for 32 bits give one beyond them."""
    parts = F.split(host, r"\.")
    numeric = host.rlike(r"^(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}$")

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0x0*|^0+", "")
        digits = F.when(digits == "", "0").otherwise(digits)
        number = F.when(p.startswith("0x"), F.conv(digits, 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(digits, 8, 10)).otherwise(digits)
        return F.when(F.length(digits) > 11, F.lit(1 << 34)).otherwise(F.least(number.try_cast("long"), F.lit(1 << 34)))

    value = F.transform(parts, part)
    n = F.size(parts)
    placed = F.transform(
        value, lambda v, i: v * F.when(i == n - 1, F.lit(1.0)).otherwise(F.pow(F.lit(256.0), 3 - i)).cast("long")
    )
    return F.when(numeric, F.aggregate(placed, F.lit(0).cast("long"), lambda a, v: a + v))


def _private_v4(number: Column) -> Column:
    a = F.floor(number / (1 << 24))
    b = F.floor(number / (1 << 16)) % 256
    return (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | (a >= 224)
    )


def _private_v6(host: Column) -> Column:
    h = F.regexp_replace(host, r"^\[|\]$", "")
    dotted = F.regexp_extract(h, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    hi = F.conv(F.regexp_extract(h, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 1), 16, 10).try_cast("long")
    lo = F.conv(F.regexp_extract(h, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 2), 16, 10).try_cast("long")
    mapped = F.coalesce(_ipv4_number(dotted), hi * 65536 + lo)
    return (
        h.isin("::", "::1")
        | h.rlike(r"^(?:f[cd]|fe[89ab]|ff)")
        | F.when(h.startswith("::ffff:"), F.coalesce(_private_v4(mapped), F.lit(True))).otherwise(False)
    )


def public_url(url: Column) -> Column:
    """http(s), no user info, a dotted host that is neither local nor in a private, loopback or link-local range."""

    def public(u: Column) -> Column:
        def by_host(host: Column) -> Column:
            named = F.contains(host, F.lit(".")) & (host != "localhost") & ~host.rlike(LOCAL_HOSTS)
            numeric = let(_ipv4_number(host), lambda v4: F.when(v4.isNull(), named).otherwise(~_private_v4(v4) & (v4 < (1 << 32))))
            return F.when(host.startswith("["), ~_private_v6(host)).when(host.rlike(r"^[\dx]"), numeric).otherwise(named)

        return u["ok"] & (u["user"] == "") & let(F.regexp_replace(u["host"], r"\.$", ""), by_host)

    return F.coalesce(let(parse(url), public), F.lit(False))


def mirror_to_canonical(url: Column) -> Column:
    """A video mirror's /watch?v= link names the same video: point it at the original."""

    def canonical(u: Column) -> Column:
        video = _param(u, "v")
        mirror = u["ok"] & ~_on_youtube(u) & video.rlike(VIDEO_ID) & u["path"].rlike(r"/watch/?$")
        return F.when(F.coalesce(mirror, F.lit(False)), F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(url)

    return let(parse(url), canonical)


def transcript_source(url: Column, claimed: Column) -> Column:
    def where(u: Column) -> Column:
        return (
            F.when(_on_youtube(u), "youtube")
            .when(~u["ok"], "unknown")
            .when(F.lower(u["path"]).rlike(AUDIO_EXTENSIONS), "audio")
            .when(claimed == "youtube", "page")
            .otherwise(claimed)
        )

    return let(parse(url), where)


def is_social(url: Column) -> Column:
    return F.coalesce(parse(url)["host"].rlike(SOCIAL_HOSTS), F.lit(False))


def is_short(url: Column) -> Column:
    return F.coalesce(let(parse(url), lambda u: _on_youtube(u) & u["path"].startswith("/shorts/")), F.lit(False))


def deep_link(url: Column, sec: Column) -> Column:
    """Watch and short links with t=<sec>s, replacing an existing t; NULL elsewhere."""
    at = F.concat(F.lit("t="), F.floor(sec).cast("long").cast("string"), F.lit("s"))

    def link(u: Column) -> Column:
        watch = (_site(u) == "youtube.com") & (u["path"] == "/watch") & _param(u, "v").isNotNull()
        short = (_site(u) == "youtu.be") & (F.length(u["path"]) > 1)
        params = u["params"]
        first_t = F.array_position(F.transform(params, _name), "t")
        # The first t keeps its place, later ones go; without one it is appended.
        swapped = F.filter(F.transform(params, lambda p, i: F.when(_name(p) != "t", p).when(i + 1 == first_t, at)), lambda p: p.isNotNull())
        query = F.array_join(F.when(first_t > 0, swapped).otherwise(F.concat(params, F.array(at))), "&")
        full = F.concat(u["scheme"], F.lit("://"), _authority(u), u["path"], F.lit("?"), query, u["fragment"])
        return F.when(u["ok"] & (watch | short), full)

    return F.when((sec >= 0) & ~F.isnan(sec.cast("double")), let(parse(url), link))
