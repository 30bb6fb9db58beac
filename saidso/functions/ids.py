"""Slugs, normalized claim text and stable claim ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saidso.functions.dates import iso
from saidso.functions.unicode import nfkc, nfkd
from saidso.functions.wording import WS


def slugify(name: Column) -> Column:
    """'Élan O’Brien' -> 'elan-obrien'."""
    s = F.lower(F.regexp_replace(nfkd(name), r"[\x{0300}-\x{036F}]", ""))
    s = F.regexp_replace(F.regexp_replace(s, "['‘’]", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def normalize_claim(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    s = F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}" + WS[1:], "")
    return F.trim(F.regexp_replace(s, f"{WS}+", " "))


def claim_id(slug: Column, said: Column, claim: Column) -> Column:
    """First 12 hex digits of sha1(slug | day said | normalized claim)."""
    return F.substring(F.sha1(F.concat_ws("|", slug, iso(said), normalize_claim(claim)).cast("binary")), 1, 12)
