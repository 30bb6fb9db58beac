"""Secret scans: leftmost matches of strong patterns, and weak parts of credentials linked by an interval join.

Strong findings (`assign`, `access`, `hex`) count by themselves. Weak parts (a user or client identifier, a bare token
of forty characters, a service endpoint) say little alone and are reported only where complementary parts stand in one
scope: an identifier with a secret, and an endpoint with both. The scopes of a text are its blocks, between blank lines, heads of
sections, rules and code fences, however long a block is; beside that, parts stand together that are at most SCOPE characters
apart, which is the only scope of a text without such borders. Parts of a block meet by an equi-join on (document, block);
others on (document, cell of SCOPE characters) over neighbouring cells, then by their real distance. So neither a long document
nor a document with thousands of parts is compared with itself all to all, and places are summed up in chunks.

Positions are code points, ends exclusive. Defined results: a null or empty text has no findings and the digest of the
empty string; repeated rows each get their findings; null ids are ids like any other; input columns that carry the
names of results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saidso.functions.binding import let
from saidso.session import materialize

# The strong patterns, the shortest finding of each, and what is measured.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be listed to be dropped
STRONG = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
WEAK = (
    ("identifier", r"""(?i:(?:access_key_id|client_id|account_id|user_name|username|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""),
    ("bare", r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"),
    ("endpoint", r"(?i:(?:https?|jdbc:[a-z0-9]+|amqps?|mongodb|redis|ftps?)://)[A-Za-z0-9@:._-]{4,}"),
)
KINDS = [k for k, _ in STRONG + WEAK]
#: What ends a block: a blank line, a section's head, a rule or a code fence.
BORDER = r"\n[ \t\r]*(?=\n)|\n(?=[ \t]*\[[^\]\n]{1,80}\][ \t\r]*(?:\n|$))|\n(?=(?:-{3,}|={3,}|`{3,}))"
#: Characters between two parts that are one scope across borders.
SCOPE = 400
#: Findings whose places are summed up at once.
CHUNK = 128
SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _spans(text: Column, kind: str, pattern: str, matches: Column) -> Column:
    """Where `matches`, all matches of `pattern` in order, stand: the pieces between them are what split leaves.

    Chunks of matches are summed first, then places are counted from the start of each chunk, so time grows with the matches
    and not with their square.
    """
    widths = F.transform(matches, F.length)
    pairs = F.slice(F.zip_with(F.transform(F.split(text, pattern, -1), F.length), widths, lambda g, w: F.struct(g.alias("gap"), w.alias("width"))), F.lit(1), F.size(matches))
    ints = F.expr("cast(array() as array<int>)")

    def ends(chunk: Column, start: Column) -> Column:
        """Where each match of a chunk ends."""
        first = F.struct(start.alias("at"), ints.alias("out"))

        def step(state: Column, pair: Column) -> Column:
            end = state["at"] + pair["gap"] + pair["width"]
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(end)).alias("out"))

        return F.aggregate(chunk, first, step, lambda s: s["out"])

    def placed(all_pairs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / CHUNK).cast("int"))
        chunks = F.transform(cuts, lambda c: F.slice(all_pairs, c * CHUNK + 1, F.lit(CHUNK)))
        sums = lambda cs: F.transform(cs, lambda c: F.struct(F.aggregate(c, F.lit(0), lambda s, p: s + p["gap"] + p["width"]).alias("gap"), F.lit(0).alias("width")))
        every = let(chunks, lambda cs: F.flatten(F.zip_with(cs, F.concat(F.array(F.lit(0)), ends(sums(cs), F.lit(0))), lambda c, start: F.when(c.isNotNull(), ends(c, start)).otherwise(ints))))
        span = lambda p, end: F.struct(F.lit(kind).alias("kind"), (end - p["width"]).alias("start"), end.alias("stop"))
        return F.zip_with(all_pairs, every, span)

    return let(pairs, placed)


def found(docs: DataFrame) -> DataFrame:
    """`docs` with `strong` and `weak`, arrays of (kind, start, stop) ordered by place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.withColumns({f"_m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in STRONG + WEAK})
    spans = {k: F.when(F.size(f"_m_{k}") > 0, _spans(text, k, p, F.col(f"_m_{k}"))).otherwise(F.expr(f"cast(array() as {SPAN})")) for k, p in STRONG + WEAK}
    width = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, "access": lambda m: F.length(m) >= 20}
    for kind, keeps in width.items():
        spans[kind] = _where(spans[kind], F.transform(F.col(f"_m_{kind}"), keeps))
    mixed = F.transform(F.col("_m_bare"), lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))
    spans["bare"] = _where(spans["bare"], mixed)
    strong = _ordered(F.concat(*(spans[k] for k, _ in STRONG)))
    weak = _ordered(F.concat(*(spans[k] for k, _ in WEAK)))
    some = F.exists(F.array(*(F.size(f"_m_{k}") > 0 for k, _ in WEAK)), lambda x: x)
    cuts = F.regexp_extract_all(text, F.lit(BORDER), F.lit(0))
    borders = F.when(some & text.rlike(BORDER), F.transform(_spans(text, "border", BORDER, cuts), lambda s: s["stop"])).otherwise(F.expr("cast(array() as array<int>)"))
    return listed.withColumns({"strong": strong, "weak": weak, "borders": borders}).drop(*(f"_m_{k}" for k in KINDS))


def _where(spans: Column, keeps: Column) -> Column:
    both = F.zip_with(spans, keeps, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    return F.transform(F.filter(both, lambda b: b["k"]), lambda b: b["s"])


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(rank), lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that complementary parts support.

    `parts`: key, role (`id`, `secret` or `endpoint`), weak, kind, start, stop, block (null without borders). Returns key and
    `added`, the supported weak parts of the key.
    """
    part = ["key", "role", "kind", "start", "stop"]
    cells = F.sequence(F.floor(F.col("start") / scope) - 1, F.floor((F.col("stop") - 1) / scope) + 1)
    wanting = parts.where("weak").select(*part, F.explode(cells).alias("cell"))
    # Only the outermost parts of a role in a cell can be nearest to anything outside it, and inside it any will do.
    there = parts.select("key", "role", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))).alias("cell"))
    there = there.groupBy("key", "cell", F.col("role").alias("other")).agg(F.min(F.struct("start", "stop")).alias("low"), F.max(F.struct("stop", "start")).alias("high"))
    gap = lambda s, e: F.greatest(F.col("start") - e, s - F.col("stop"))  # noqa: E731  negative where they overlap
    near = (gap(F.col("low.start"), F.col("low.stop")) <= scope) | (gap(F.col("high.start"), F.col("high.stop")) <= scope)
    met = wanting.join(there, ["key", "cell"]).where((F.col("role") != F.col("other")) & near).select(*part, "other")
    blocks = parts.where("block IS NOT NULL").select("key", "block", F.col("role").alias("other")).distinct()
    within = parts.where("weak AND block IS NOT NULL").join(blocks, ["key", "block"]).where("role <> other").select(*part, "other")
    seen = met.unionByName(within).groupBy(*part).agg(F.bool_or(F.col("other") == "id").alias("i"), F.bool_or(F.col("other") == "secret").alias("s"))
    held = seen.where("(role = 'id' AND s) OR (role = 'secret' AND i) OR (role = 'endpoint' AND i AND s)")
    return held.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))


def _parts(scanned: DataFrame) -> DataFrame:
    """The parts of documents that have a weak one, with their roles and blocks; a weak part that a strong one covers is none."""
    known = {"access": "id", "identifier": "id", "endpoint": "endpoint"}
    role = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("kind")), F.lit("secret"))
    some = scanned.where(F.size("weak") > 0)
    listed = lambda c, weak: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(weak).alias("weak"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    edges = F.transform("borders", lambda b: F.struct(b.alias("start"), F.lit(None).cast("boolean").alias("weak"), F.lit("border").alias("kind"), b.alias("stop")))
    rows = some.select("key", F.size("borders").alias("cuts"), F.explode(F.concat(listed(F.col("weak"), True), listed(F.col("strong"), False), edges)).alias("p")).select("key", "cuts", "p.*").distinct()
    # One row a part of one document, in order; borders (weak is null) come first where they meet.
    order = ("start", "weak", "stop", "kind")
    before = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A frame of all rows that follow takes time with their square; the same rows from the end do not.
    after = Window.partitionBy("key").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    strong = ~F.col("weak")
    rows = rows.withColumns({"_reach": F.max(F.when(strong, F.col("stop"))).over(before), "_next": F.min(F.when(strong, F.col("start"))).over(after), "_block": F.count_if(F.col("weak").isNull()).over(before)})
    covered = F.col("weak") & ((F.coalesce("_reach", F.lit(0)) > F.col("start")) | (F.coalesce("_next", "stop") < F.col("stop")))
    block = F.when(F.col("cuts") > 0, F.col("_block")).alias("block")
    return rows.where(F.col("weak").isNotNull() & ~covered).select("key", "weak", "kind", "start", "stop", block, role.alias("role"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`docs` without text, with `strong` (the strong findings) and `spans` (these and the supported weak parts), by place."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    scanned = found(docs.drop("strong", "weak", "borders", "spans", "added", "key", *(f"_m_{k}" for k in KINDS)).withColumn("key", key))
    scanned = materialize(scanned.drop("text"))
    added = linked(_parts(scanned), scope)
    # A document is named by id and text together; equal rows get equal findings.
    joined = scanned.join(added.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
    every = _ordered(F.concat("strong", F.coalesce("added", F.expr(f"cast(array() as {SPAN})"))))
    return joined.withColumn("spans", every).drop("weak", "borders", "added", "_key")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def written(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """`text` with every span, or stretch of overlapping spans, replaced by `mark`."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def masked(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """`docs` with every finding in `text` replaced by `mark`, and n_chars, where there is one, the new length; null texts stay."""
    found_in = scan_secrets(docs.select("doc_id", "text"), scope).where(F.size("spans") > 0)
    # Equal rows have equal findings, so one of them is enough.
    hits = found_in.groupBy("key").agg(F.first("spans").alias("__secret_spans")).select(F.col("key.doc_id").alias("__secret_id"), F.col("key.text").alias("__secret_key"), "__secret_spans")
    hits = materialize(hits)
    same = docs["doc_id"].eqNullSafe(F.col("__secret_id")) & (F.xxhash64(docs["text"]) == F.col("__secret_key"))
    joined = docs.join(hits, same, "left")
    clean = joined.withColumn("text", F.when(F.col("__secret_spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__secret_spans"), mark)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("__secret_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return clean.select(docs.columns)
