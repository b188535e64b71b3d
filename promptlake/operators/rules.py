"""Policy rules: keyword rules, heuristics, dictionary lookups, compilation, conflicts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlake.functions.guarded import compiles
from promptlake.functions.patterns import BLANK, BLANKS, SOLID, ZWNJ
from promptlake.functions.text import sha256
from promptlake.session import ship_package

SEVERITY = {"LOW": 0.3, "MEDIUM": 0.5, "HIGH": 0.8, "CRITICAL": 1.0}
STRICTNESS = {"FLAG_REVIEW": 1, "MASK": 2, "BLOCK_EXTERNAL": 3}

# Families of telling words: weight, category, keywords.
FAMILIES = [
    (
        10,
        "jailbreak_injection",
        [
            "نادیده بگیر",
            "دستورات قبلی را",
            "ignore previous",
            "ignore all previous",
            "disregard previous",
            "disregard all",
            "بدون هیچ محدودیت",
            "بدون محدودیت پاسخ",
            "system prompt",
            "پرامپت سیستمی",
            "jailbreak",
            "prompt injection",
            "developer mode",
            "dan mode",
            "تو را آزاد کن از",
            "قوانین را دور بزن",
            "نقش یک هوش مصنوعی بدون",
            "tell me your instructions",
        ],
    ),
    (6, "board_minutes_budget", ["صورتجلسه", "صورت جلسه", "هیئت مدیره", "بودجه", "حسابرسی نشده", "ارقام مالی داخلی"]),
    (6, "customer_behavior_analysis", ["تحلیل رفتار مشترک", "رفتار مشترکین", "رفتار کاربران", "سگمنت مشترکین", "لیست مشترکین"]),
    (5, "cdr_traffic", ["ریز مکالمات", "ریز‌مکالمات", "cdr", "لاگ اینترنت", "ip log", "ترافیک مشترک", "صورتحساب مشترک"]),
    (
        5,
        "source_code_systems",
        ["سورس", "source code", "کانکشن استرینگ", "connection string", "رمز دیتابیس", "پسورد دیتابیس", "توکن دسترسی", "api token", "کلید رمزنگاری"],
    ),
    (3, "network_infrastructure", ["فیبر نوری", "dwdm", "نقشه شبکه", "توپولوژی", "دکل bts", "زیرساخت مخابراتی", "سوییچ مرکزی", "روتینگ داخلی"]),
    (3, "tenders_contracts", ["مناقصه", "قرارداد", "هوآوی", "huawei", "نوکیا", "nokia", "زدتی ای", "zte", "وندور"]),
    (2, "personal_data", ["کد ملی", "شناسنامه", "آدرس منزل", "اطلاعات هویتی"]),
]


def rank(values: dict[str, float], column: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[column], F.lit(0))


def phrase_pattern(keyword: Column) -> Column:
    """A keyword's words with any blanks between, standing alone; a joiner in it counts as a blank.

    The first word comes first and the look back from it after: a search that begins with a class of blanks is slow.
    """
    words = F.filter(F.split(F.replace(keyword, F.lit(ZWNJ), F.lit(" ")), f"{BLANK}+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?i)"), quoted[0], F.lit(f"(?<!{SOLID}"), quoted[0], F.lit(")"), F.array_join(F.transform(F.slice(quoted, 2, 1 << 30), lambda w: F.concat(F.lit(f"{BLANK}+"), w)), ""), F.lit(f"(?!{SOLID})")))


#: Keywords that may become patterns of a plan; more than a policy's list holds.
MAX_KEYWORDS = 10_000


def keyword_hits(rules: DataFrame, max_keywords: int = MAX_KEYWORDS) -> Callable[[Column], Column]:
    """Active rules as a column function: normal text to array<struct<code, severity, score>> of the rules with a keyword that stands in it.

    rules (code, keywords, severity, is_active) is the policy's bounded list: it is read
    first, each rule becomes one pattern of all its keywords (compiled once in a task),
    and no pair of text and rule is made. A list beyond the bound is refused.
    """
    active = rules.where("is_active").select("code", "severity", F.explode("keywords").alias("keyword"))
    listed = active.select("code", "severity", phrase_pattern(F.col("keyword")).alias("pattern")).where("pattern IS NOT NULL").limit(max_keywords + 1).collect()
    if len(listed) > max_keywords:
        raise ValueError("more keywords than a plan may hold as patterns")
    patterns: dict[tuple[str, str | None], list[str]] = {}
    for r in listed:
        patterns.setdefault((r.code, r.severity), []).append(r.pattern)
    empty = F.expr("cast(array() as array<struct<code: string, severity: string, score: double>>)")
    of = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).cast("string").alias("severity"), F.lit(SEVERITY.get(severity, 0.5)).alias("score"))
    hit = lambda normal: [F.when(normal.rlike("|".join(p)), of(*named)) for named, p in sorted(patterns.items(), key=repr)]
    return lambda normal: F.array_compact(F.array(*hit(normal))) if patterns else empty


def keyword_rules(docs: DataFrame, rules: DataFrame, key: str, normal: str, max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """(key, codes, score) of every document by `keyword_hits`."""
    told = docs.select(key, keyword_hits(rules, max_keywords)(F.col(normal)).alias("hit"))
    score = F.coalesce(F.array_max(F.transform("hit", lambda r: r["score"])), F.lit(0.0))
    return told.select(key, F.array_sort(F.array_distinct(F.transform("hit", lambda r: r["code"]))).alias("codes"), score.alias("score"))


def heuristic(text: Column, families=None) -> Column:
    """struct<category, score, risk>: the best family's weight, plus one for each further keyword up to two; the first wins ties."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for i, (weight, category, keywords) in enumerate(families or FAMILIES):
        n = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
        score = F.when(n > 0, weight + F.least(n - 1, F.lit(2))).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(category).alias("category")))
    best = F.array_max(F.array(*scored))
    some = best["score"] > 0
    risk = F.when(best["score"] >= 8, "critical").when(best["score"] >= 5, "high").when(best["score"] >= 3, "medium").otherwise("low")
    return F.struct(F.when(some, best["category"]).otherwise("general").alias("category"), best["score"].alias("score"), risk.alias("risk"))


def route_of_risk(risk: Column) -> Column:
    return F.when(risk == "critical", "BLOCKED").when(risk.isin("high", "medium"), "LOCAL").otherwise("EXTERNAL")


#: Terms that are sent to every task; more meet the runs by a shuffle.
BROADCAST_TERMS = 100_000
#: Letters and digits, \p{L} and \p{N}.
_RUN_OF_LETTERS = re.compile(r"[^\W_]+")


def _small(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _words(text: Column) -> Column:
    return F.filter(F.split(_small(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _every_run(w: Column, lengths: list[int]) -> Column:
    """array<string>: each run of so many words (null where the text ends before)."""
    each = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.when(F.size(w) >= i + n - 1, F.array_join(F.slice(w, i, n), " ")))
    return F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), each))


def term_runs(text: str, listed: set[str], begun: dict[str, list[int]]) -> list[str]:
    """The runs of a text in small letters that are listed; `begun`: the first words of these, with the numbers of words."""
    words = _RUN_OF_LETTERS.findall(text)
    found = []
    for i in [i for i, w in enumerate(words) if w in begun]:
        for n in begun[words[i]]:
            run = " ".join(words[i : i + n])
            # a run that the text's end cuts short would be another term's
            if run in listed and i + n <= len(words):
                found.append(run)
    return found


def _runs_among(listed: list[str]) -> Callable[[Column], Column]:
    """Text in small letters to array<string>: its runs of words that are listed; no other run leaves Python."""
    begun: dict[str, set[int]] = {}
    for run in listed:
        words = run.split(" ")
        begun.setdefault(words[0], set()).add(len(words))
    told, wanted = {w: sorted(n) for w, n in begun.items()}, set(listed)

    @F.arrow_udf("array<string>")
    def runs(texts: pa.Array) -> pa.Array:
        return pa.array([term_runs(t, wanted, told) for t in texts.to_pylist()], pa.list_(pa.string()))

    return runs


def dictionary_lookup(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, term, n): terms of a large dictionary, by hash join of word runs (a small one is one pattern instead).

    The dictionary is read first: runs have as many words as its terms, however many that are. Up to
    BROADCAST_TERMS terms go to the tasks, which find their runs; for more, every run is built and shuffled.
    """
    ship_package(docs.sparkSession)
    split = terms.select("kind", "term", _words(F.col("term")).alias("w")).where("size(w) > 0")
    named = split.select("kind", "term", F.size("w").alias("words"), F.array_join("w", " ").alias("run")).distinct()
    found = {r.words: r["count"] for r in named.groupBy("words").count().collect()}
    few, named = sum(found.values()) <= BROADCAST_TERMS, named.drop("words")
    if few:
        runs = docs.select(key, _runs_among([r.run for r in named.select("run").distinct().collect()])(_small(F.col(text))).alias("runs"))
    else:
        runs = docs.select(key, _words(F.col(text)).alias("w")).select(key, _every_run(F.col("w"), sorted(found)).alias("runs"))
    # an outer explode infers no filter that would build the runs twice; runs that are no terms go before anything is shuffled by document
    seen = runs.select(key, F.explode_outer("runs").alias("run")).where("run IS NOT NULL")
    return seen.join(F.broadcast(named) if few else named, "run").groupBy(key, "kind", "term").agg(F.count("*").alias("n"))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with skip_reason (null: they run), by priority; a pattern that can't be read is skipped."""
    # read by the engine that will run them
    bad = F.when((F.col("detector_type") == "REGEX") & (F.length("regex_source") > 0), ~compiles(F.col("regex_source"))).otherwise(False)
    kind, blank = F.col("detector_type"), lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    reason = (
        F.when((kind == "REGEX") & blank("regex_source"), "REGEX rule missing source")
        .when((kind == "REGEX") & bad, "invalid regex source")
        .when((kind == "CHECKSUM") & blank("checksum_kind"), "CHECKSUM rule missing kind")
        .when((kind == "SEMANTIC") & (F.size(F.filter(F.coalesce("keywords", F.array()), lambda k: F.trim(k) != "")) == 0), "SEMANTIC rule missing keywords")
    )
    return rules.withColumn("skip_reason", reason).orderBy("priority", "ordinal")


def identity_hash(label: Column, detector_type: Column, regex_source: Column, checksum_kind: Column, keywords: Column) -> Column:
    """What makes two proposals the same rule."""
    return sha256(
        F.concat_ws(
            "§",
            F.regexp_replace(F.lower(label), f"[{BLANKS}{ZWNJ}]+", "_"),
            detector_type,
            F.when(detector_type == "REGEX", F.coalesce(regex_source, F.lit(""))).otherwise(""),
            F.coalesce(checksum_kind, F.lit("")),
            F.lower(F.array_join(F.coalesce(keywords, F.array()), "|")),
        )
    )


def deduplicated(proposals: DataFrame, hashed: str = "identity_hash", label: str = "label", order: str = "ordinal") -> DataFrame:
    """proposals with `verdict` ACCEPT or DUPLICATE, and the label of the first of the same hash.

    `order` tells the rows of one hash apart (rows that tie for the first place are all
    accepted). Firsts are found by aggregation and joined back, so a hash that a third
    of all rows share is never one task's. A null hash is a hash like any other.
    """
    first = F.min(F.struct(F.col(order).alias("order"), F.col(label).alias("label"))).alias("first__")
    firsts = proposals.groupBy(F.col(hashed).alias("hash__")).agg(first)
    told = proposals.join(firsts, F.col(hashed).eqNullSafe(F.col("hash__")), "left")
    is_first = F.col(order).eqNullSafe(F.col("first__.order"))
    told = told.withColumn("verdict", F.when(is_first, "ACCEPT").otherwise("DUPLICATE")).withColumn("duplicate_of", F.when(~is_first, F.col("first__.label")))
    return told.drop("hash__", "first__")


def conflicts(rules: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, ordinal, conflict_group) of rules that share a keyword but not the action; the last pair names the group.

    A rule's last pair is that with the largest ordinal it conflicts with, so no pairs are made: of each
    keyword the largest ordinals of its two leading actions are enough, and every rule meets one of the two.
    Ordinals tell the rules of `within` (columns without nulls) apart. Rules without an action conflict with none.
    """
    same = list(within)
    words = rules.where("action IS NOT NULL").select(*same, "ordinal", "action", "identity_hash", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("keyword"))
    last = words.groupBy(*same, "keyword", "action").agg(F.max(F.struct("ordinal", "identity_hash")).alias("last"))
    # one entry for each action that rules may have
    leading = last.groupBy(*same, "keyword").agg(F.slice(F.sort_array(F.collect_list(F.struct("last.ordinal", "last.identity_hash", "action")), asc=False), 1, 2).alias("top")).where(F.size("top") == 2)
    met = words.join(leading, [*same, "keyword"])
    other = F.when(F.col("top")[0]["action"] != F.col("action"), F.col("top")[0]).otherwise(F.col("top")[1])
    pairs = met.groupBy(*same, "ordinal").agg(F.max(F.struct(other["ordinal"].alias("ordinal"), other["identity_hash"].alias("hash"))).alias("other"), F.first("identity_hash").alias("own"))
    later = F.col("other.ordinal") > F.col("ordinal")
    named = F.when(later, F.concat_ws("~", "own", "other.hash")).otherwise(F.concat_ws("~", "other.hash", "own"))
    return pairs.select(*same, "ordinal", F.substring(sha256(named), 1, 16).alias("conflict_group"))


def strictest_first(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc(rank(STRICTNESS, F.col("action"))), "scope_size", "priority", "ordinal")


# Moves between a document's states.
TRANSITIONS = [("DRAFT", "REVIEW"), ("DRAFT", "ARCHIVED"), ("REVIEW", "ACTIVE"), ("REVIEW", "DRAFT"), ("ACTIVE", "ARCHIVED")]


def can_move(old: Column, new: Column) -> Column:
    return F.coalesce(F.concat_ws(">", old, new).isin(*(f"{a}>{b}" for a, b in TRANSITIONS)), F.lit(False))


# Reviewers decide on these states.
REVIEWABLE = ("DRAFT", "PENDING_LLM", "REVIEW")


def reviewed(status: Column, verdict: Column) -> Column:
    """The state after ACCEPT or REJECT; null where that isn't allowed."""
    open_ = status.isin(*REVIEWABLE)
    return F.when(open_ & (verdict == "ACCEPT"), "ACTIVE").when(open_ & (verdict == "REJECT"), "REJECTED")
