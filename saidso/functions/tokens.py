"""Match tokens: the words two texts are compared by, and what a list of them says about numbers, negation, time and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saidso.functions.binding import let
from saidso.functions.unicode import nfkd
from saidso.functions.wording import WS

# A word keeps apostrophes inside it, separators inside numbers, and a closing percent sign.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['‘’ʼ][\p{L}\p{M}\p{N}]+|(?<=\p{N})[.,]\p{N}+)*%?"

# Filler words, number words, negations, time words.
FILLERS = ("uh", "uhh", "uhm", "um", "umm", "erm", "er", "ah", "hmm", "mm", "mhm")
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
MULTIPLIERS = {"hundred": 100, "dozen": 12}
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
PLURAL_SCALES = {"dozens": 12, "hundreds": 100, "thousands": 1000, "millions": 10**6, "billions": 10**9, "trillions": 10**12}
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
)
# Words that negate, and words of time (fixed values).
NEGATIONS = (
    "not", "no", "never", "none", "nobody", "nothing", "nowhere", "neither", "nor", "cannot", "cant", "dont",
    "doesnt", "didnt", "wont", "wouldnt", "isnt", "arent", "wasnt", "werent", "havent", "hasnt", "hadnt",
    "shouldnt", "couldnt", "mustnt", "neednt", "shant", "aint",
)
TIME_WORDS = (
    "this", "next", "last", "previous", "early", "mid", "middle", "late", "end", "start", "beginning",
    "today", "tonight", "tomorrow", "yesterday", "soon", "now",
    "day", "week", "month", "quarter", "half", "year", "decade", "century",
    "spring", "summer", "fall", "autumn", "winter",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
# Which kind of number word may follow which inside one number.
FOLLOWS = {
    "digits": ("multiplier", "scale"),
    "unit": ("multiplier", "scale"),
    "tens": ("unit", "multiplier", "scale"),
    "multiplier": ("unit", "tens", "scale", "and"),
    "scale": ("unit", "tens", "digits", "and"),
    "and": ("unit", "tens"),
}

_SEP = "\x00"
# Space-like and opening characters skipped when looking back for the end of a sentence.
LOOK_BACK = WS[:-1] + r"\"“”'‘’(\[\-]+$"
# The last character that is none of them; found from the end, where LOOK_BACK is tried at every place.
LAST_SEEN = "(?s)^.*([^" + LOOK_BACK[1:-2] + ")"


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _norms(words: Column) -> Column:
    """Normalized forms, one per raw word; the list is joined so each rewrite runs once per text, and only where it can change one."""

    def forms(joined: Column) -> Column:
        folded = F.when(joined.rlike(r"[^\x{00}-\x{7F}]"), F.regexp_replace(nfkd(joined), r"\p{M}", "")).otherwise(joined)
        s = F.lower(folded)
        for quote in "'‘’ʼ":
            s = F.replace(s, F.lit(quote), F.lit(""))
        return F.split(let(s, lambda x: F.when(F.contains(x, F.lit(",")), F.regexp_replace(x, r"(?<=\d),(?=\d)", "")).otherwise(x)), _SEP)

    return let(F.array_join(words, _SEP), lambda j: F.when(j != "", forms(j)).otherwise(F.array().cast("array<string>")))


def numbered_norms(words: Column) -> Column:
    """ARRAY<STRUCT<norm, word>>: normalized tokens with the position of the raw word each came from; '5%' gives two."""
    plain = F.transform(_norms(words), lambda w, i: F.struct(w.alias("norm"), i.alias("word")))
    split = F.flatten(
        F.transform(
            plain,
            lambda t: F.when(
                t["norm"].endswith("%"),
                F.array(
                    F.struct(F.regexp_replace(t["norm"], "%$", "").alias("norm"), t["word"].alias("word")),
                    F.struct(F.lit("percent").alias("norm"), t["word"].alias("word")),
                ),
            ).otherwise(F.array(t)),
        )
    )
    return F.when(F.exists(words, lambda w: w.endswith("%")), split).otherwise(plain)


def keep_tokens(tokens: Column, before: Column, after: Column) -> Column:
    """Tokens without fillers and without 'you know' pairs; `before`/`after` are the neighbours outside the list.

    `tokens` is looked into by index: pass a column or a bound value, not an expression.
    """

    def kept(t: Column, i: Column) -> Column:
        following = F.when(i + 1 < F.size(tokens), F.get(tokens, i + 1)["norm"]).otherwise(after)
        preceding = F.when(i > 0, F.get(tokens, i - 1)["norm"]).otherwise(before)
        return ~(
            t["norm"].isin(*FILLERS)
            | ((t["norm"] == "you") & following.eqNullSafe(F.lit("know")))
            | ((t["norm"] == "know") & preceding.eqNullSafe(F.lit("you")))
        )

    return F.filter(tokens, kept)


def match_tokens(text: Column) -> Column:
    """ARRAY<STRUCT<norm, word>> of one text."""
    none = F.lit(None).cast("string")
    return let(let(raw_words(text), numbered_norms), lambda t: keep_tokens(t, none, none))


def match_words(text: Column) -> Column:
    """ARRAY<STRING> of one text: lower case, no punctuation, no fillers."""
    none = F.lit(None).cast("string")
    dropped = F.array(*map(F.lit, (*FILLERS, "know")))

    def forms(raw: Column) -> Column:
        kept = let(numbered_norms(raw), lambda t: F.transform(keep_tokens(t, none, none), lambda x: x["norm"]))
        # Most texts have nothing to split or to drop, and their forms are their words.
        return let(_norms(raw), lambda n: F.when(F.contains(text, F.lit("%")) | F.arrays_overlap(n, dropped), kept).otherwise(n))

    return let(raw_words(text), forms)


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def _number_text(v: Column) -> Column:
    """Twelve significant digits, no trailing zeros; powers of ten from 21 up and from -7 down are written as such."""
    form = F.format_string("%.11e", v)
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(form, "e", 1), r"\.", ""), "0+$", "")
    power = F.substring_index(form, "e", -1).try_cast("int")

    def place(d: Column) -> Column:
        n = F.length(d)
        head, tail = F.substr(d, F.lit(1), power + 1), F.substr(d, power + 2)
        mantissa = F.when(n == 1, d).otherwise(F.concat(F.left(d, F.lit(1)), F.lit("."), F.substr(d, F.lit(2))))
        sign = F.when(power < 0, "e-").otherwise("e+")
        return (
            F.when((power >= 21) | (power < -6), F.concat(mantissa, sign, F.abs(power).cast("string")))
            .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), d))
            .when(n <= power + 1, F.concat(d, F.repeat(F.lit("0"), power + 1 - n)))
            .otherwise(F.concat(head, F.lit("."), tail))
        )

    return F.when(v == 0, "0").when(v == float("inf"), "Infinity").otherwise(let(digits, place))


def number_signature(words: Column) -> Column:
    """Sorted canonical numbers of a token list: 'ten thousand' and '10,000' both give '10000'."""
    return let(words, _number_signature)


def _number_signature(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("next")))
    scales = [*SCALES, *MULTIPLIERS]
    no_run = F.lit("")
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(0.0).alias("total"), F.lit(0.0).alias("current"), no_run.alias("last")
    )
    values = _table({**UNITS, **TENS, **MULTIPLIERS, **SCALES})

    def kind(w: Column, nxt: Column, in_run: Column) -> Column:
        return (
            F.when(w.rlike(r"^\d+(?:\.\d+)?$"), "digits")
            .when(w.isin(*UNITS) | (w.isin("a", "an") & F.coalesce(nxt.isin(*scales), F.lit(False))), "unit")
            .when(w.isin(*TENS), "tens")
            .when(w.isin(*MULTIPLIERS), "multiplier")
            .when(w.isin(*SCALES), "scale")
            .when((w == "and") & in_run & F.coalesce(nxt.isin(*UNITS, *TENS), F.lit(False)), "and")
            .otherwise("")
        )

    def flush(acc: Column) -> Column:
        return F.when(acc["last"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(_number_text(acc["total"] + acc["current"]))))

    def state(out: Column, total: Column, current: Column, last: Column) -> Column:
        return F.struct(out.alias("out"), total.alias("total"), current.alias("current"), last.alias("last"))

    plurals = F.create_map(*[F.lit(x) for k, v in PLURAL_SCALES.items() for x in (k, str(v))])
    allowed = [f"{a}>{b}" for a, bs in FOLLOWS.items() for b in bs]

    def other(acc: Column, w: Column) -> Column:
        extra = F.coalesce(
            F.try_element_at(plurals, w), F.when(w.isin(*ORDINALS) | (w.rlike(r"\d") & w.rlike(r"\p{L}")), w)
        )
        out = F.concat(flush(acc), F.when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<string>")))
        return state(out, F.lit(0.0), F.lit(0.0), no_run)

    def number(acc: Column, w: Column, k: Column) -> Column:
        breaks = (acc["last"] != "") & ~F.concat(acc["last"], F.lit(">"), k).isin(*allowed)
        base = F.when(breaks, state(flush(acc), F.lit(0.0), F.lit(0.0), no_run)).otherwise(acc)

        def add(b: Column) -> Column:
            v = F.coalesce(F.try_element_at(values, w), F.lit(1.0))
            had = F.when(b["current"] == 0, F.lit(1.0)).otherwise(b["current"])
            current = (
                F.when(k == "digits", w.try_cast("double")).when(k.isin("unit", "tens"), b["current"] + v)
                .when(k == "multiplier", had * v).when(k == "scale", F.lit(0.0)).otherwise(b["current"])
            )
            total = F.when(k == "scale", b["total"] + had * v).otherwise(b["total"])
            return state(b["out"], total, current, k)

        return let(base, add)

    def step(acc: Column, p: Column) -> Column:
        return let(
            kind(p["w"], p["next"], acc["last"] != ""),
            lambda k: F.when(k == "", other(acc, p["w"])).otherwise(number(acc, p["w"], k)),
        )

    # Words that neither are nor touch a number leave the state alone: most texts skip the fold.
    numeric = r"^\d|\d"
    any_number = F.exists(
        words, lambda w: w.rlike(numeric) | w.isin(*UNITS, *TENS, *MULTIPLIERS, *SCALES, *PLURAL_SCALES, *ORDINALS)
    )
    folded = F.array_sort(F.aggregate(pairs, start, step, flush))
    return F.when(any_number, folded).otherwise(F.array().cast("array<string>"))


def negation_count(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*NEGATIONS)))


def time_words(words: Column) -> Column:
    """Time tokens in order, plurals folded."""
    singular = F.transform(
        words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    return F.filter(singular, lambda w: w.isin(*TIME_WORDS))


def _listed(words: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(words, ", "), F.lit("]"))


def meaning_change(quote: Column, span: Column) -> Column:
    """Why two token lists say different things (numbers, negations), or NULL."""

    def numbers(n: Column) -> Column:
        q, s = n["q"], n["s"]
        return F.when(
            q != s, F.concat(F.lit("number mismatch: quote has "), _listed(q), F.lit(", transcript has "), _listed(s))
        )

    nums = let(F.struct(number_signature(quote).alias("q"), number_signature(span).alias("s")), numbers)
    qn, sn = negation_count(quote), negation_count(span)
    neg = F.when(
        qn != sn,
        F.concat(F.lit("negation mismatch: quote has "), qn.cast("string"), F.lit(" negation(s), transcript has "), sn.cast("string")),
    )
    return F.coalesce(nums, neg)


def time_change(quote: Column, span: Column) -> Column:
    q, s = time_words(quote), time_words(span)
    return F.when(q != s, F.concat(F.lit("time mismatch: quote has "), _listed(q), F.lit(", transcript has "), _listed(s)))


def entity_flags(text: Column, words: Column, opening: Column) -> Column:
    """ARRAY<BOOLEAN> per raw word: capitalized, no digits, not 'I…', and not first in its sentence.

    `opening` is the last visible character before the text ('' at the very start).
    """
    def all_flags(gaps: Column) -> Column:
        def flag(w: Column, i: Column) -> Column:
            lead = F.regexp_replace(F.get(gaps, i), LOOK_BACK, "")
            last = F.when(lead != "", F.right(lead, F.lit(1))).when(i == 0, opening).otherwise("x")
            # Most words are not capitalized and are settled by the first test.
            return F.when(~w.rlike(r"^\p{Lu}"), False).otherwise(
                ~w.rlike(r"\d|^I(?:['‘’ʼ].*)?$") & let(last, lambda c: (c != "") & ~c.isin(".", "!", "?", ":"))
            )

        return F.transform(words, flag)

    return let(F.split(text, WORD), all_flags)


def entity_words(text: Column) -> Column:
    """Distinct normalized names in one standalone text."""
    both = F.struct(match_tokens(text).alias("tokens"), entity_flags(text, raw_words(text), F.lit("")).alias("flags"))
    return let(
        both,
        lambda b: F.array_distinct(F.transform(F.filter(b["tokens"], lambda t: F.get(b["flags"], t["word"])), lambda t: t["norm"])),
    )


def same_spelling(a: Column, b: Column) -> Column:
    """One name in two spellings: an edit per four letters is a slip, not another name."""
    budget = F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 4).cast("int"))
    return (a == b) | (F.levenshtein(a, b) <= budget)


def name_change(quote_names: Column, quote: Column, span_names: Column, span: Column) -> Column:
    missing = F.concat(
        F.filter(quote_names, lambda w: ~F.exists(span, lambda o: same_spelling(w, o))),
        F.filter(span_names, lambda w: ~F.exists(quote, lambda o: same_spelling(w, o))),
    )
    return F.when(F.size(missing) > 0, F.concat(F.lit("name mismatch: "), _listed(missing), F.lit(" is not on both sides")))


# Short words that sit before a number without naming a product (fixed values).
NOT_A_CODE_PREFIX = (
    "a", "an", "at", "by", "in", "of", "on", "or", "to", "up", "is", "as", "be", "so", "we", "me", "my", "us", "go", "do", "no", "if", "it", "the",
    "and", "for", "top", "per", "all", "are", "was", "our", "its", "has", "had", "but", "not", "x",
)


def join_product_codes(words: Column) -> Column:
    """Adjacent 'h', '20' become 'h20'.

    A code is a short word followed by a number; a short word is never a number,
    so pairs cannot overlap and every word can look at its neighbours alone.
    """

    return let(words, _joined_codes)


def _joined_codes(words: Column) -> Column:
    def prefix(w: Column) -> Column:
        return F.coalesce(w.rlike("^[a-z]{1,3}$") & ~w.isin(*NOT_A_CODE_PREFIX), F.lit(False))

    def digits(w: Column) -> Column:
        return F.coalesce(w.rlike(r"^\d{1,4}$"), F.lit(False))

    def one(w: Column, i: Column) -> Column:
        nxt, prev = F.get(words, i + 1), F.when(i > 0, F.get(words, i - 1))
        return F.when(prefix(w) & digits(nxt), F.concat(w, nxt)).when(~(digits(w) & prefix(prev)), w)

    return F.array_compact(F.transform(words, one))


# Labels that name a part and no person (fixed values).
ANONYMOUS = r"(?i)^(?:speaker|spk|voice|person|unknown|participant)\s*[a-z]?\s*\d*$"
INTERVIEWER = r"(?i)^(?:host|co-?host|interviewer|moderator|anchor|presenter|q|question)\s*\d*$"
ANSWERER = r"(?i)^(?:guest|interviewee|a|answer)\s*\d*$"


def same_speaker(a: Column, b: Column) -> Column:
    """Word lists of two names: the shorter one's words all appear in the longer."""
    short_in_long = F.when(F.size(a) <= F.size(b), F.size(F.array_except(a, b)) == 0).otherwise(F.size(F.array_except(b, a)) == 0)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & short_in_long, F.lit(False))


def label_problem(label: Column, label_words: Column, wanted: Column, wanted_words: Column, host: Column, host_words: Column) -> Column:
    """Why a line labelled `label` cannot be `wanted`'s words, or NULL when it can."""
    is_wanted = F.coalesce(wanted.isNotNull() & (label_words == wanted_words), F.lit(False))
    trimmed = F.trim(label)
    in_line = F.concat(F.lit("quote is in a line "), F.lit("by "), label)
    return (
        F.when(~is_wanted & (F.coalesce(host, F.lit("")) != "") & same_speaker(label_words, host_words), F.concat(in_line, F.lit(", the host")))
        .when((F.coalesce(wanted, F.lit("")) == "") | is_wanted | trimmed.rlike(ANONYMOUS), F.lit(None).cast("string"))
        .when(
            trimmed.rlike(INTERVIEWER), F.concat(F.lit("quote is in a line labeled "), label, F.lit(", the interviewer, not "), wanted)
        )
        .when(trimmed.rlike(ANSWERER) | same_speaker(label_words, wanted_words), F.lit(None).cast("string"))
        .otherwise(F.concat(in_line, F.lit(", not "), wanted))
    )
