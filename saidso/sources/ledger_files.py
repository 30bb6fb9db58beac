"""Ledger files in and out: JSON ledgers, part files, the transcript store, episode metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saidso.functions.dates import calendar_date
from saidso.functions.ids import claim_id
from saidso.functions.urls import transcript_key
from saidso.schemas import CLAIMS
from saidso.sources.json_arrays import elements

# Ledger JSON as written by the application: camelCase, dates as strings.
_EV = "array<struct<url:string,title:string,date:string,snippet:string>>"
CLAIM_JSON = (
    "struct<id:string,person:string,personSlug:string,quote:string,quoteVerified:boolean,claim:string,type:string,topic:string,saidDate:string,"
    "targetDate:string,targetDateInferred:boolean,resolutionCriteria:string,hedge:string,impliedProbability:double,specificity:int,"
    "source:struct<title:string,url:string,date:string,kind:string,timestampSec:double,deepLink:string>,verdict:string,"
    f"grading:struct<verdict:string,confidence:double,rationale:string,evidence:{_EV},resolvedOn:string,latenessMonths:double,gradedAt:string,"
    "gradedBy:string,judges:array<struct<judge:string,verdict:string,confidence:double>>,disputed:boolean>,"
    "drift:struct<label:string,previousClaimId:string,note:string,labeledBy:string>,origin:string,extractedAt:string>"
)


def _as_claims(df: DataFrame, raw: Column) -> DataFrame:
    """Claim JSON strings to the claims schema. An absent lateness and a null one differ, so both are kept."""
    c = df.withColumn("_raw", raw).withColumn("c", F.from_json("_raw", CLAIM_JSON))
    g = F.col("c.grading")
    keys = F.json_object_keys(F.get_json_object("_raw", "$.grading"))
    graded = F.struct(
        g["verdict"].alias("verdict"), g["confidence"].alias("confidence"), g["rationale"].alias("rationale"),
        F.transform(g["evidence"], lambda e: F.struct(e["url"].alias("url"), e["title"].alias("title"), calendar_date(e["date"]).alias("date"), e["snippet"].alias("snippet"))).alias("evidence"),
        calendar_date(g["resolvedOn"]).alias("resolved_on"), F.array_contains(keys, "latenessMonths").alias("lateness_applies"),
        g["latenessMonths"].alias("lateness_months"), F.try_to_timestamp(g["gradedAt"]).alias("graded_at"), g["gradedBy"].alias("graded_by"),
        g["judges"].alias("judges"), g["disputed"].alias("disputed"),
    )
    s, d = F.col("c.source"), F.col("c.drift")
    return c.select(
        *[x for x in df.columns],
        F.col("c.id").alias("id"), F.col("c.person").alias("person"), F.col("c.personSlug").alias("person_slug"), F.col("c.quote").alias("quote"),
        F.col("c.quoteVerified").alias("quote_verified"), F.col("c.claim").alias("claim"), F.col("c.type").alias("type"), F.col("c.topic").alias("topic"),
        calendar_date(F.col("c.saidDate")).alias("said_date"), calendar_date(F.col("c.targetDate")).alias("target_date"),
        F.col("c.targetDateInferred").alias("target_date_inferred"), F.col("c.resolutionCriteria").alias("resolution_criteria"),
        F.col("c.hedge").alias("hedge"), F.col("c.impliedProbability").alias("implied_probability"), F.col("c.specificity").alias("specificity"),
        F.struct(s["title"].alias("title"), s["url"].alias("url"), calendar_date(s["date"]).alias("date"), s["kind"].alias("kind"),
                 s["timestampSec"].alias("timestamp_sec"), s["deepLink"].alias("deep_link")).alias("source"),
        F.col("c.verdict").alias("verdict"), F.when(g.isNotNull(), graded).alias("grading"),
        F.when(d.isNotNull(), F.struct(d["label"].alias("label"), d["previousClaimId"].alias("previous_claim_id"), d["note"].alias("note"), d["labeledBy"].alias("labeled_by"))).alias("drift"),
        F.lit(None).cast(CLAIMS["link"].dataType).alias("link"), F.col("c.origin").alias("origin"), F.try_to_timestamp(F.col("c.extractedAt")).alias("extracted_at"),
    )


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """JSON ledgers `{"version": 1, "claims": [...]}`; a missing path is an empty ledger, another version fails the job.

    A file is read by many tasks, so one ledger may be as large as a file system allows.
    """
    try:
        found, files = elements(spark, path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return spark.createDataFrame([], CLAIMS)
        raise
    ends = F.concat("head", "tail")
    fine = ~F.col("listed") & ends.rlike(r'"version"\s*:\s*1(?!\d|\.[0-9]*[1-9])') & F.col("head").rlike(r'"claims"\s*:\s*\[')
    files = files.select("file", "some", fine.alias("fine"))
    wrong = F.raise_error(F.lit('not a version 1 ledger ({ "version": 1, "claims": [...] })')).cast("boolean")
    # Elements are never dealt by file; files without any are checked on their own.
    empty = files.where("NOT some").select(F.lit(None).cast("string").alias("json"), "fine")
    each = found.join(files, "file").select("json", "fine").unionByName(empty)
    checked = each.where(F.when(F.col("fine"), F.col("json").isNotNull()).otherwise(wrong))
    return _as_claims(checked.select(F.col("json").alias("_json")), F.col("_json")).drop("_json")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Every part file of a folder (an object or a bare list), ids recomputed; `part` is the file name and `given_id` the id as shipped."""
    found, _ = elements(spark, path)
    part = F.element_at(F.split("file", "/"), -1).alias("part")
    c = _as_claims(found.select(part, F.col("json").alias("_json")), F.col("_json")).drop("_json")
    return c.withColumn("given_id", F.nullif("id", F.lit(""))).withColumn("id", claim_id(F.col("person_slug"), F.col("said_date"), F.col("claim")))


def part_problems(parts: DataFrame) -> DataFrame:
    """Ids found in more than one place: (id, parts). A merge is sound when this is empty."""
    return parts.groupBy("id").agg(F.count("*").alias("copies"), F.sort_array(F.collect_set("part")).alias("parts")).where(F.col("copies") > 1)


def write_transcripts(segments: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Append the transcripts the store does not hold yet; returns the keys written.

    `segments` by transcript_id, `sources`: transcript_id, source. Stored whole, never trimmed.
    """
    spark = segments.sparkSession
    keyed = sources.withColumn("key", transcript_key(F.col("source")))
    try:
        held = spark.read.parquet(path).select("key").distinct()
        fresh = keyed.join(held, "key", "left_anti")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        fresh = keyed
    # Two sources with one key are one transcript: the smallest id speaks for it.
    chosen = fresh.groupBy("key").agg(F.min(F.struct("transcript_id", "source")).alias("t")).select("key", "t.*")
    segments.join(chosen, "transcript_id").write.mode("append").parquet(path)
    return chosen.select("key", "transcript_id")


def _yyyymmdd(s: Column) -> Column:
    form = r"^(\d{4})(\d{2})(\d{2})$"
    return F.when(F.trim(s).rlike(form), F.regexp_replace(F.trim(s), form, "$1-$2-$3"))


def episode_metadata(files: DataFrame) -> DataFrame:
    """(file, id, title, url, date, channel, duration_sec) from downloader metadata files (file, content)."""
    m = F.from_json(
        "content",
        "struct<id:string,title:string,webpage_url:string,original_url:string,upload_date:string,release_date:string,timestamp:double,"
        "release_timestamp:double,channel:string,uploader:string,duration:double>",
    )

    def text(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"m.{name}")), F.lit(""))

    epoch = F.coalesce("m.timestamp", "m.release_timestamp")
    day = F.when(epoch.isNotNull(), F.date_from_unix_date(F.floor(epoch / 86400).cast("int")))
    return files.withColumn("m", m).select(
        "file", text("id").alias("id"), text("title").alias("title"), F.coalesce(text("webpage_url"), text("original_url")).alias("url"),
        F.coalesce(F.try_to_date(_yyyymmdd(F.col("m.upload_date"))), F.try_to_date(_yyyymmdd(F.col("m.release_date"))), day).alias("date"),
        F.coalesce(text("channel"), text("uploader")).alias("channel"), F.col("m.duration").alias("duration_sec"),
    )


def _language_rank(lang: Column) -> Column:
    return (
        F.when(lang == "en", 0).when(F.lower(lang).isin("en-us", "en-gb"), 1).when(lang == "en-orig", 3).when(lang.startswith("en"), 2).otherwise(4)
    )


def best_track(tracks: DataFrame) -> DataFrame:
    """Per video the English caption track to use: manual before automatic, then language, then listing order.

    `tracks`: video_id, ordinal, language, kind ('asr' when automatic).
    """
    english = tracks.where(F.lower("language").startswith("en"))
    order = F.struct(F.col("kind").eqNullSafe("asr").alias("auto"), _language_rank(F.col("language")).alias("rank"), "ordinal")
    row = F.struct(*tracks.columns)
    return english.groupBy(F.col("video_id").alias("_v")).agg(F.min_by(row, order).alias("t")).select("t.*")


def best_subtitle_file(files: DataFrame) -> DataFrame:
    """Per video the subtitle file to use, by language then name. `files`: video_id, name ('<id>.<lang>.vtt')."""
    lang = F.regexp_extract("name", r"\.([^.]+)\.vtt$", 1)
    return (
        files.where(F.col("name").endswith(".vtt") & F.col("name").startswith(F.concat("video_id", F.lit("."))))
        .groupBy("video_id")
        .agg(F.min_by("name", F.struct(_language_rank(lang).alias("r"), F.col("name"))).alias("name"))
    )


# Model output schemas, by recorded schema name.
MODEL_OUTPUT = {
    "extract_claims": "struct<claims:array<struct<quote:string,claim:string,type:string,topic:string,targetDate:string,targetDateInferred:boolean,resolutionCriteria:string,hedge:string,specificity:int>>>",
    "grade_claim": f"struct<verdict:string,confidence:double,rationale:string,resolvedOn:string,evidence:{_EV}>",
    "drift_labels": "struct<transitions:array<struct<claimId:string,label:string,note:string>>>",
    "discover_appearances": "struct<candidates:array<struct<title:string,show:string,host:string,date:string,url:string,kind:string,duration_min:double,transcript_source:string,why:string>>>",
    "ask_answer": "struct<answer:string,cited_claim_ids:array<string>>",
    "ask_answer_v2": "struct<answer:string,cited_claim_ids:array<string>>",
}
_REQUIRED = {
    "extract_claims": "data.claims IS NOT NULL AND forall(data.claims, c -> c.quote IS NOT NULL AND c.claim IS NOT NULL AND c.type IN ('prediction','stance','factual') AND c.topic IS NOT NULL AND c.hedge IS NOT NULL AND c.specificity IS NOT NULL)",
    "grade_claim": "data.verdict IN ('correct','incorrect','partial','unresolvable','too_early') AND data.confidence IS NOT NULL AND data.rationale IS NOT NULL AND data.evidence IS NOT NULL",
    "drift_labels": "data.transitions IS NOT NULL AND forall(data.transitions, t -> t.claimId IS NOT NULL AND t.label IN ('reaffirmed','pushed_later','pulled_earlier','goalposts_moved','reversed','escalated','softened') AND t.note IS NOT NULL)",
    "discover_appearances": "data.candidates IS NOT NULL AND forall(data.candidates, c -> c.title IS NOT NULL AND c.url IS NOT NULL AND c.why IS NOT NULL)",
    "ask_answer": "data.answer IS NOT NULL AND data.cited_claim_ids IS NOT NULL",
    "ask_answer_v2": "data.answer IS NOT NULL AND data.cited_claim_ids IS NOT NULL",
}


def read_model_output(files: DataFrame, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Recorded model answers (file, content) of one schema, and a quarantine table of those that do not fit it."""
    head = F.from_json("content", "struct<request:struct<schemaName:string,variant:string,user_excerpt:string>,response:struct<data:string,citations:array<struct<url:string,title:string>>,searched:array<struct<url:string,title:string>>,model:string>>")
    r = files.withColumn("h", head).where(F.col("h.request.schemaName").eqNullSafe(schema_name) | F.col("h").isNull() | F.col("h.response").isNull())
    r = r.withColumn("data", F.from_json("h.response.data", MODEL_OUTPUT[schema_name]))
    r = r.withColumn("fits", F.coalesce(F.expr(_REQUIRED[schema_name]), F.lit(False)))
    key = F.regexp_extract("file", r"([0-9a-f]{16})\.json$", 1)
    good = r.where("fits").select(
        "file", key.alias("key"), F.lit(schema_name).alias("schema_name"), F.col("h.request.variant").alias("variant"), F.col("h.request.user_excerpt").alias("user_excerpt"),
        "data", F.coalesce("h.response.citations", F.array().cast("array<struct<url:string,title:string>>")).alias("citations"), F.col("h.response.searched").alias("searched"),
        F.coalesce("h.response.model", F.lit("unknown")).alias("model"),
    )
    named = F.coalesce(F.col("h.request.schemaName") == schema_name, F.lit(True))
    bad = r.where(~F.col("fits") & named).select("file", F.lit(f"response.data is missing or is not {schema_name}").alias("reason"), "content")
    return good, bad


def response_key(schema_name: Column, variant: Column, system: Column, user: Column, web_search: Column) -> Column:
    """Content key of a model call: 16 hex digits over its identity as JSON."""
    identity = F.to_json(
        F.struct(schema_name.alias("schemaName"), variant.alias("variant"), system.alias("system"), user.alias("user"), F.coalesce(web_search, F.lit(False)).alias("webSearch")),
        {"ignoreNullFields": "false"},
    )
    return F.substring(F.sha2(identity, 256), 1, 16)


def lookup_responses(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (with `key`) answered by recorded responses, and the misses."""
    return requests.join(responses, "key"), requests.join(responses.select("key"), "key", "left_anti")


def same_question(misses: DataFrame, recorded: DataFrame, claims: DataFrame) -> DataFrame:
    """Fallback for questions: the newest recorded answer to the same words and day whose cited claims all still exist.

    `misses`: question_id, question, today (string); `recorded`: question, today, answer, cited ARRAY<STRING>, recorded_at.
    """

    def norm(q: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.lower(q), "[‘’]", "'"), "[^a-z0-9' ]+", " ")
        return F.trim(F.regexp_replace(s, r"\s+", " "))

    r = recorded.withColumn("cited", F.array_distinct("cited")).withColumn("rid", F.xxhash64("question", "answer", "recorded_at"))
    alive = (
        r.select("rid", F.explode("cited").alias("id")).join(claims.select("id"), "id", "left_semi").groupBy("rid").agg(F.count("*").alias("alive"))
    )
    whole = r.join(alive, "rid").where((F.col("alive") == F.size("cited")) & (F.trim("answer") != ""))
    m = misses.withColumn("n", norm(F.col("question"))).alias("m")
    j = m.join(whole.withColumn("n", norm(F.col("question"))).alias("r"), "n").where(F.col("r.today").isNull() | (F.trim("r.today") == F.col("m.today")))
    return j.groupBy("m.question_id").agg(F.max_by(F.struct(F.trim("r.answer").alias("answer"), F.col("r.cited").alias("cited")), F.struct("r.recorded_at", "r.rid")).alias("a")).select("question_id", "a.*")


