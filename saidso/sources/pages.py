"""Web pages to readable text and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.functions.wording import WS

# Named entities decoded besides numeric ones (fixed values).
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™",
    "eacute": "é", "egrave": "è", "aacute": "á", "agrave": "à", "ouml": "ö", "uuml": "ü", "auml": "ä", "ccedil": "ç", "ntilde": "ñ",
}
# Elements whose whole content is boilerplate (fixed values).
DROPPED_ELEMENTS = (
    "script", "style", "noscript", "template", "svg", "head", "title", "nav", "header", "footer", "aside", "form", "iframe",
)
# Character references and block tags (fixed values).
_ENTITY = r"(?i)&(?:#x[0-9a-f]+|#\d+|[a-z]+);"
_DROP = rf"(?is)<({'|'.join(DROPPED_ELEMENTS)})\b[^>]*>.*?</\1\s*>"
_BLOCK_END = r"(?i)</(?:p|div|section|article|main|blockquote|li|ul|ol|h[1-6]|tr|table|pre|figure|figcaption|dd|dt)\s*>"
_BLOCK_START = r"(?i)<(?:p|div|section|article|main|blockquote|li|h[1-6]|tr|pre|figure|dd|dt)\b[^>]*>"


def collapse_spaces(s: Column) -> Column:
    """Runs of spaces, tabs and no-break spaces become one; ends are trimmed of any whitespace."""
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\x{A0}]+", " "), f"^{WS}+|{WS}+$", "")


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _decode_one(entity: Column) -> Column:
    name = F.lower(F.regexp_extract(entity, "^&(.*);$", 1))
    table = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
    # Leading zeros say nothing; what is left beyond eight digits is no character.
    written = F.regexp_extract(name, "^#x?0*([0-9a-f]*)$", 1)
    kept = F.when(F.length(written) <= 8, F.when(written == "", "0").otherwise(written))
    digits = F.when(name.startswith("#x"), F.conv(kept, 16, 10)).otherwise(kept).try_cast("long")
    number = F.when(digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF), _code_point(digits))
    return F.coalesce(F.when(name.startswith("#"), number).otherwise(F.try_element_at(table, name)), entity)


def decode_entities(s: Column) -> Column:
    """One left-to-right pass: decoded text is never decoded again."""
    plain = F.split(s, _ENTITY)
    entities = F.regexp_extract_all(s, F.lit(f"({_ENTITY})"), F.lit(1))
    joined = F.array_join(F.zip_with(plain, F.concat(entities, F.array(F.lit(""))), lambda p, e: F.concat(p, F.when(e == "", "").otherwise(_decode_one(e)))), "")
    return F.when(F.contains(s, F.lit("&")), joined).otherwise(s)


def _without_boilerplate(s: Column) -> Column:
    """Boilerplate elements go, again and again until none is left: every pass that changes anything takes a closing tag with it."""
    closing = F.greatest(F.size(F.split(s, "</")) - 1, F.lit(1))
    start = F.struct(s.alias("s"), F.lit(False).alias("done"))

    def once(state: Column, _: Column) -> Column:
        again = ~state["done"] & state["s"].rlike(_DROP)
        return F.when(again, F.struct(F.regexp_replace(state["s"], _DROP, " ").alias("s"), F.lit(False).alias("done"))).otherwise(F.struct(state["s"].alias("s"), F.lit(True).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), closing), start, once, lambda state: state["s"])


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`."""
    df = pages.withColumn("_s", _without_boilerplate(F.regexp_replace(html, r"(?s)<!--.*?-->", "")))
    t = F.regexp_replace("_s", r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, _BLOCK_END, "\n\n"), _BLOCK_START, "\n\n")
    df = df.withColumn("_t", F.regexp_replace(t, r"<[^>]+>", ""))
    lines = F.transform(F.split(decode_entities(F.col("_t")), "\n"), collapse_spaces)
    text = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), f"^{WS}+|{WS}+$", "")
    return df.withColumn("text", text).drop("_s", "_t")


def page_title(html: Column) -> Column:
    """og:title, else the title element; NULL when empty."""
    og = F.nullif(F.regexp_extract(html, r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']", 1), F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(collapse_spaces(decode_entities(F.coalesce(og, title))), F.lit(""))
