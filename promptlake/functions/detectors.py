"""Detectors: each gives an array of hits of one text.

A hit is struct<detector_type, rule_id, label, category, confidence, start, end,
text>. Offsets count code points of the scanned text (normalised for identifiers
and phrases, the original for secrets and dictionaries).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlake.functions.checksums import card_ok, flat, iban_ok, national_id_ok
from promptlake.functions.guarded import SECONDS, RowFunction, guarded, pattern_spans
from promptlake.functions.lexicon import term_spans
from promptlake.functions.patterns import AFTER, BEFORE, BLANK, BLANKS, SOLID, ZWNJ, found, has_any, quote, spans, text_of
from promptlake.functions.text import ascii_digits, strip

HIT = "struct<detector_type: string, rule_id: string, label: string, category: string, confidence: double, start: int, end: int, text: string>"
#: A hit with what follows from it.
GRADED = f"{HIT[:-1]}, always_block: boolean, severity: string>"

# Confidence of each kind of hit.
CHECKSUM, SECRET, DICTIONARY, KEYWORD, BULK, JAILBREAK, DECLARED = 0.95, 0.92, 0.88, 0.85, 0.8, 0.95, 0.98

# Phrases of attempts to get round the rules.
JAILBREAK_PHRASES = [
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
    "قوانین را دور بزن",
    "tell me your instructions",
]

# Patterns of secrets: label, category, pattern.
SECRETS = [
    ("کلید API", "api_key", f"{BEFORE}sk-[A-Za-z0-9]{{20,}}{AFTER}"),
    ("کلید AWS", "api_key", f"{BEFORE}AKIA[A-Z0-9]{{16}}{AFTER}"),
    ("کلید خصوصی", "private_key", r"-----BEGIN[\s\S]*?PRIVATE KEY-----"),
    ("اعتبارنامه اتصال", "credential", f"(?i){BEFORE}(?:password|passwd|secret|token){BLANK}*[=:]{BLANK}*{SOLID}+"),
    ("رشته اتصال پایگاه داده", "connection_string", rf"(?i){BEFORE}(?:mongodb|mysql|postgres(?:ql)?|redis|amqp)(?:\+{SOLID}*)?://{SOLID}+"),
]

# begins where its run of signs does, or where the last address ended: from inside a run no more is found than from its first sign
EMAIL = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# Values that a text declares as its author's, and the words one of which comes before a secret.
DECLARING = ["رمز", "گذرواژه", "پسورد", "کلید", "توکن"]
_SECRET_DECLARED = (
    rf"(?i)(?:رمز{BLANK}*(?:عبور)?|گذرواژه|پسورد|کلید{BLANK}*api|توکن{BLANK}*دسترسی){BLANK}*(?:(?:من|ما|حساب|سرور){BLANK}*)?"
    rf"(?:[:=]{BLANK}*)?([a-z0-9_!@#$%^&*+.\-]{{4,}})"
)
_PHONE_DECLARED = (
    rf"(?i)(?:(?:شماره{BLANK}*(?:تماس|تلفن|همراه|موبایل)?|تلفن|موبایل|همراه){BLANK}*(?:شخصی(?:{BLANK}*من)?|من)"
    rf"|(?:my|personal|private){BLANK}+(?:phone|mobile)(?:{BLANK}+number)?){BLANK}*(?:is|است|:|=)?{BLANK}*(\+?[0-9][0-9 ()\-]{{6,}}[0-9])"
)


def hits(kind: str, label: str, category: str, confidence: float, found_spans: Column, rule_id: str | None = None) -> Column:
    return F.transform(
        found_spans,
        lambda s: F.struct(
            F.lit(kind).alias("detector_type"),
            F.lit(rule_id).cast("string").alias("rule_id"),
            F.lit(label).alias("label"),
            F.lit(category).alias("category"),
            F.lit(confidence).cast("double").alias("confidence"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["text"].alias("text"),
        ),
    )


def none() -> Column:
    return F.expr(f"cast(array() as array<{HIT}>)")


def _spans_if(test: Column, text: Column, pattern: str) -> Column:
    """spans where a cheap test, which every match passes, holds; most texts hold none."""
    return F.when(F.coalesce(test, F.lit(False)), spans(text, pattern)).otherwise(F.expr("cast(array() as array<struct<start: int, end: int, text: string>>)"))


def national_ids(normal: Column) -> Column:
    runs = _spans_if(normal.rlike("[0-9]{10}"), normal, r"(?<![0-9.])[0-9]{10}(?![0-9.])")
    return hits("CHECKSUM", "کد ملی", "national_id", CHECKSUM, F.filter(runs, lambda s: national_id_ok(s["text"])))


def bank_cards(normal: Column) -> Column:
    # sixteen digits with four marks between them at most have four that touch
    runs = _spans_if(normal.rlike("[0-9]{4}"), normal, rf"(?<![0-9.])[0-9][0-9\-{BLANKS}]{{14,18}}[0-9](?![0-9.])")
    return hits("CHECKSUM", "شماره کارت بانکی", "ir_bank_card", CHECKSUM, F.filter(runs, lambda s: card_ok(flat(s["text"]))))


def ibans(normal: Column) -> Column:
    """Iranian numbers by their checksum; others only where `iban` follows from 40 characters before their first place."""
    runs = _spans_if(normal.rlike("[0-9]{2}[0-9A-Za-z]{11}"), normal, f"(?i){BEFORE}(?:IR[0-9]{{2}}[0-9]{{21}}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}){AFTER}")

    def valid(s):
        around = normal.substr(F.greatest(F.instr(normal, s["text"]) - 40, F.lit(1)), F.length(normal))
        return F.when(F.lower(s["text"]).startswith("ir"), iban_ok(s["text"])).otherwise(around.rlike("(?i)شبا|iban"))

    return hits("CHECKSUM", "شماره شبا", "iban", CHECKSUM, F.filter(runs, valid))


def declared_values(normal: Column) -> Column:
    tests = {_SECRET_DECLARED: has_any(normal, DECLARING), _PHONE_DECLARED: normal.rlike("[0-9][0-9 ()\\-]{6}")}
    plain = lambda pattern: F.filter(_spans_if(tests[pattern], normal, pattern), lambda s: ~F.regexp_extract(s["text"], pattern, 1).rlike(r"(?i)\A(?:password|api_key|token|secret)\z"))
    return F.concat(
        hits("REGEX", "رمز عبور اعلام‌شده", "credential", DECLARED, plain(_SECRET_DECLARED)),
        hits("REGEX", "شماره تماس شخصی اعلام‌شده", "personal_contact", DECLARED, plain(_PHONE_DECLARED)),
    )


#: Fixed value: a text's hits of one secret pattern beyond these aren't listed.
MAX_SECRETS = 5


def _may_hold(text: Column, pattern: str) -> Column:
    """False where a text lacks a literal that every match of a secret's pattern holds."""
    for literal in ("sk-", "AKIA", "-----BEGIN", "://"):
        if literal in pattern:
            return F.coalesce(F.contains(text, F.lit(literal)), F.lit(False))
    held = F.contains(text, F.lit("="))
    return F.coalesce(held | F.contains(text, F.lit(":")) if "[=:]" in pattern else held, F.lit(False))


def secrets(text: Column) -> Column:
    """The first five of every pattern, without those that only name a placeholder."""
    empty = F.expr("cast(array() as array<struct<start: int, end: int, text: string>>)")
    # a literal that every match holds is searched first: most texts hold none
    told = lambda pattern: F.when(_may_hold(text, pattern), spans(text, pattern)).otherwise(empty)
    parts = [hits("REGEX", label, category, SECRET, F.slice(told(pattern), 1, MAX_SECRETS)) for label, category, pattern in SECRETS]
    value = lambda h: F.regexp_replace(strip(F.regexp_extract(h["text"], r"(?s)\A[^=:]*[=:](.*)\z", 1)), r"[\"',;]+\z", "")
    named = lambda h: value(h).rlike(r"(?i)\A<?(?:PASSWORD|API_KEY|TOKEN|SECRET)>?\z")
    return F.filter(F.concat(*parts), lambda h: (h["category"] != "credential") | ~named(h))


def bulk_contacts(text: Column, normal: Column) -> Column:
    """Three or more addresses, or mobile numbers, in one text."""

    def bulk(label, category, count, unit):
        one = F.filter(F.array(count), lambda n: n >= 3)  # counted once
        told = F.transform(one, lambda n: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.concat_ws(" ", n.cast("string"), F.lit(unit)).alias("text")))
        return hits("REGEX", label, category, BULK, told)

    mails = F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(EMAIL))).otherwise(0)
    mobiles = F.when(~F.contains(normal, F.lit("09")), 0).otherwise(F.size(found(normal, r"(?:\A|[^0-9])(09[0-9]{9})(?![0-9])")))
    return F.concat(bulk("آدرس ایمیل (انبوه)", "bulk_email", mails, "ایمیل"), bulk("شماره موبایل (انبوه)", "bulk_mobile", mobiles, "موبایل"))


def phrases(normal: Column, terms: list[str], kind: str, label: str, category: str, confidence: float, rule_id: str | None = None) -> Column:
    """The first place of every term that occurs."""
    low = F.lower(normal)
    place = lambda t: (F.instr(low, F.lit(t.lower())) - 1).alias("start")
    places = F.array(*(F.struct(place(t), (F.instr(low, F.lit(t.lower())) - 1 + len(t)).alias("end"), F.lit(t).alias("text")) for t in terms))
    return hits(kind, label, category, confidence, F.filter(places, lambda p: p["start"] >= 0), rule_id)


def jailbreaks(normal: Column) -> Column:
    found_in = lambda low: phrases(low, JAILBREAK_PHRASES, "SEMANTIC", "تلاش دور زدن فیلتر", "jailbreak_injection", JAILBREAK)
    # small letters are made once, not for each phrase
    return F.flatten(F.transform(F.array(F.lower(normal)), lambda low: F.when(~has_any(low, JAILBREAK_PHRASES), none()).otherwise(found_in(low))))


def variants(term: str) -> str:
    """A term's pattern that takes its spellings: yeh and kaf, blanks or joiners, hyphens or none."""
    loose = {"ی": "[یي]", "ک": "[کك]", " ": f"[{BLANKS}{ZWNJ}]+", "-": f"[\\-{ZWNJ}]?"}
    return "".join(loose.get(c) or quote(c) for c in term)


def alternation(terms: list[str]) -> str | None:
    """One pattern of all terms of two characters or more, longest first."""
    kept = sorted((t.strip() for t in terms if len(t.strip()) >= 2), key=len, reverse=True)
    return "(?iu)" + "|".join(map(variants, kept)) if kept else None


# Kinds of dictionary terms: label of a hit, category, mask.
DICTIONARY_KINDS = {
    "SENIOR_OFFICER": ("مدیر ارشد", "senior_officer"),
    "TELCO_HUB_NODE": ("مرکز مخابراتی", "telco_hub_node"),
    "PROPRIETARY_SERVICE": ("سرویس انحصاری", "proprietary_service"),
}


#: Hits of dictionary terms in one text, and of one compiled pattern, beyond these aren't listed.
MAX_DICTIONARY, MAX_PATTERN = 201, 3


#: Terms that may be one pattern; more are an automaton.
PATTERN_TERMS = 200


def dictionary(text: Column, terms: dict[str, list[str]], limit: int = MAX_DICTIONARY, pattern_terms: int = PATTERN_TERMS) -> Column:
    """Terms by kind, over kinds at most `limit` hits. Few terms are one pattern of a kind, many one automaton of all kinds; both find the same."""
    if sum(map(len, terms.values())) > pattern_terms:
        kinds = list(DICTIONARY_KINDS)
        found = term_spans(text, [(i, t) for i, kind in enumerate(kinds) for t in terms.get(kind, [])])
        of_kind = lambda i: F.filter(found, lambda s: s["kind"] == i)
        named = [of_kind(i) for i in range(len(kinds))]
        return F.slice(F.concat(none(), *(hits("DICTIONARY", *DICTIONARY_KINDS[k], DICTIONARY, n) for k, n in zip(kinds, named, strict=True))), 1, limit)
    parts = [none()]
    for kind, (label, category) in DICTIONARY_KINDS.items():
        pattern = alternation(terms.get(kind, []))
        if pattern:
            parts.append(hits("DICTIONARY", label, category, DICTIONARY, spans(text, pattern)))
    return F.slice(F.concat(*parts), 1, limit)


def checked_rules(normal: Column, rules: list[dict], limit: int = MAX_PATTERN, seconds: float = SECONDS) -> Column:
    """struct<hits, error> of a policy's REGEX rules, the first `limit` hits of each.

    A rule that can't be read has no hits; one that takes too long on a text is that text's error.
    """
    listed = [(r["id"], r["pattern"]) for r in rules if r["detector_type"] == "REGEX" and r.get("pattern")]
    if not listed:
        return F.struct(none().alias("hits"), F.lit(None).cast("string").alias("error"))
    told = guarded(pattern_spans(listed, limit), "array<struct<id: string, start: int, end: int, text: string>>", seconds)(normal)
    as_hit = lambda s: F.struct(
        F.lit("REGEX").alias("detector_type"),
        s["id"].alias("rule_id"),
        F.lit("قاعدهٔ سیاست").alias("label"),
        F.lit("policy_regex").alias("category"),
        F.lit(KEYWORD).cast("double").alias("confidence"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        s["text"].alias("text"),
    )
    return F.struct(F.coalesce(F.transform(told["value"], as_hit), none()).alias("hits"), told["error"].alias("error"))


def foreign(function: RowFunction, seconds: float = SECONDS):
    """A detector from outside as a step of `dlp_outcome`: function(text, deadline) lists hits as dicts of HIT's fields, or raises."""

    def step(text: Column) -> Column:
        told = guarded(function, f"array<{HIT}>", seconds)(text)
        return F.struct(F.coalesce(told["value"], none()).alias("hits"), told["error"].alias("error"))

    return step


def compiled_rules(normal: Column, rules: list[dict], limit: int = MAX_PATTERN) -> Column:
    """Hits of a policy's compiled rules: REGEX (`limit` at most), then SEMANTIC (first keyword found) and CHECKSUM."""
    parts = [checked_rules(normal, rules, limit)["hits"]]
    for rule in rules:
        kind, rule_id = rule["detector_type"], rule["id"]
        if kind == "SEMANTIC" and rule.get("keywords"):
            parts.append(F.slice(phrases(normal, rule["keywords"], "SEMANTIC", "قاعدهٔ معنایی سیاست", "policy_semantic", KEYWORD, rule_id), 1, 1))
        elif kind == "CHECKSUM":
            known = {"IR_NATIONAL_ID": national_ids, "IR_BANK_CARD": bank_cards, "IBAN": ibans}.get(rule.get("checksum_kind"))
            if known:
                parts.append(known(normal))
    return F.concat(*parts)


#: What begins every identifier: four digits of a card, two digits and eleven more signs of an account, a declared telephone's first seven signs.
_NUMBERS = r"[0-9](?:[0-9]{3}|[0-9][0-9A-Za-z]{11}|[0-9 ()\-]{6})"


def may_hit(text: Column, normal: Column) -> Column:
    """False where none of the detectors that need no terms, rules or steps can find anything: most texts, by searches that every hit passes."""
    held = has_any(text, ["@", "=", ":", "sk-", "AKIA", "-----BEGIN"])
    words = [*DECLARING, *JAILBREAK_PHRASES]
    persian = normal.rlike("[\u0600-\u06ff]") & has_any(normal, [w for w in words if not w.isascii()])
    return F.coalesce(normal.rlike(_NUMBERS) | held | persian | has_any(F.lower(normal), [w for w in words if w.isascii()]), F.lit(False))


# Categories whose hits are critical, and the one that always blocks.
CRITICAL = ("personal_contact", "national_id", "ir_bank_card", "iban", "api_key", "private_key", "credential", "connection_string", "jailbreak_injection")
ALWAYS_BLOCK = ("jailbreak_injection",)
#: The first pipeline's set lacks declared contacts.
CRITICAL_V1 = CRITICAL[1:]


def dlp_outcome(text: Column, normal: Column, terms: dict[str, list[str]] | None = None, rules: list[dict] | None = None, steps: dict | None = None, seconds: float = SECONDS) -> Column:
    """struct<hits, failed>: all detectors' hits with always_block and severity, and the names of the steps that failed.

    One step's failure takes no other's hits. Officers' names alone are no hits here; of the
    compiled rules only patterns run. `steps` adds detectors from outside by name (see `foreign`), which
    get the original text.
    """
    rules = [r for r in rules or [] if r["detector_type"] == "REGEX"]
    named = {k: v for k, v in (terms or {}).items() if k != "SENIOR_OFFICER"}
    blocking = [r["id"] for r in rules if r.get("action") == "BLOCK_EXTERNAL"]
    checked = {"compiled_rules": checked_rules(normal, rules, seconds=seconds)} if rules else {}
    checked |= {name: step(text) for name, step in (steps or {}).items()}
    every = F.concat(
        national_ids(normal),
        bank_cards(normal),
        ibans(normal),
        declared_values(normal),
        secrets(text),
        bulk_contacts(text, normal),
        dictionary(text, named),
        *(c["hits"] for c in checked.values()),
        jailbreaks(normal),
    )

    def graded(h):
        critical = h["category"].isin(*CRITICAL) | F.coalesce(h["rule_id"].isin(*blocking) if blocking else F.lit(False), F.lit(False))
        severity = F.when(critical, "critical").when(h["confidence"] >= 0.85, "high").otherwise("medium")
        return h.withField("always_block", h["category"].isin(*ALWAYS_BLOCK)).withField("severity", severity)

    # most texts hold nothing: what hits have in common is searched first, and the detectors run for the others
    some = may_hit(text, normal) if not named else F.lit(True)
    for c in checked.values():
        some = some | (F.size(c["hits"]) > 0)
    graded_hits = F.when(some, F.transform(every, graded)).otherwise(F.expr(f"cast(array() as array<{GRADED}>)"))
    failed = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(c["error"].isNotNull(), F.lit(name)) for name, c in checked.items())))
    return F.struct(graded_hits.alias("hits"), failed.alias("failed"))


def dlp(text: Column, normal: Column, terms: dict[str, list[str]] | None = None, rules: list[dict] | None = None) -> Column:
    """The hits of `dlp_outcome`."""
    return dlp_outcome(text, normal, terms, rules)["hits"]


def legacy_layer(text: Column, normal: Column) -> Column:
    """struct of the first pipeline's counts, score and codes."""
    # counted only where a cheap test says that there may be something
    digits, mail = normal.rlike("[0-9]{10}"), F.contains(text, F.lit("@"))
    count = lambda t, p, ok=None: F.when(digits if t is normal else mail, F.size(found(t, p) if ok is None else F.filter(found(t, p), ok))).otherwise(0)
    secret_patterns = [
        f"{BEFORE}sk-[a-zA-Z0-9]{{20,}}{AFTER}",
        f"{BEFORE}AKIA[A-Z0-9]{{16}}{AFTER}",
        r"-----BEGIN[\s\S]*?PRIVATE KEY-----",
        f"(?i){BEFORE}(?:password|passwd|secret|token){BLANK}*={BLANK}*{SOLID}+",
        rf"(?i){BEFORE}(?:mongodb|mysql|postgres|redis|amqp)\+?{SOLID}*://{SOLID}+",
        rf"(?i){BEFORE}host{BLANK}*={BLANK}*{SOLID}+[\s\S]*?(?:port|password){BLANK}*={BLANK}*{SOLID}+",
    ]
    family = F.lit(0)
    for i in range(len(secret_patterns), 0, -1):
        family = F.when(_may_hold(text, secret_patterns[i - 1]) & text.rlike(secret_patterns[i - 1]), i).otherwise(family)
    n = {
        "national_ids": count(normal, f"{BEFORE}[0-9]{{10}}{AFTER}", national_id_ok),
        "ibans": count(normal, f"(?i){BEFORE}IR[0-9]{{24}}{AFTER}"),
        "cards": count(normal, f"{BEFORE}[0-9]{{16}}{AFTER}", card_ok),
        "emails": count(text, EMAIL),
        "mobiles": count(normal, f"{BEFORE}09[0-9]{{9}}{AFTER}"),
        "secret_family": family,
    }
    critical = (n["national_ids"] > 0) | (n["ibans"] > 0) | (n["cards"] > 0) | (family > 0)
    high = (n["emails"] >= 3) | (n["mobiles"] >= 3)
    return F.struct(*(c.alias(k) for k, c in n.items()), F.when(critical, 1.0).when(high, 0.8).otherwise(0.0).alias("score"), (critical | high).alias("blocked"))


# Orders to rewrite, signs of confidential matter, words for organisations.
REWRITE = ["بازنویسی کن", "بازنویسی", "خلاصه کن", "ترجمه کن", "پارافریز"]
CONFIDENTIAL = ["صورت جلسه", "قرارداد", "محرمانه", "داخلی", "طبقه بندی شده", "حقوق و دستمزد", "سرمایه گذاری", "مالی", "بودجه"]
ORGANISATION = ["سازمان", "شرکت", "مدیر", "هیئت", "دستگاه", "وزارت", "اداره", "معاونت", "بخش", "واحد", "ستاد", "دولت"]


def _places(text: Column, word: str) -> Column:
    """How often a word stands in a text, overlapping places too."""
    if not word or any(word.startswith(word[-i:]) for i in range(1, len(word))):
        return F.regexp_count(text, F.lit(f"(?={quote(word)})"))
    # places of such a word can't overlap: what is gone without it tells their number
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def behaviour(text: Column, normal: Column, rewrite=None, confidential=None, organisation=None, min_length: int = 500, density: float = 5.0) -> Column:
    """struct: an order to rewrite confidential matter; words for organisations per 1000 characters of a long text."""
    rewriting = has_any(normal, rewrite or REWRITE) & has_any(normal, confidential or CONFIDENTIAL)
    n = sum((_places(normal, w) for w in (organisation or ORGANISATION)), F.lit(0))
    dense = F.when(F.length(text) > min_length, n * 1000.0 / F.length(text)).otherwise(0.0)
    return F.struct(rewriting.alias("rewriting"), n.alias("mentions"), dense.alias("density"), F.when(rewriting, 1.0).when(dense > density, 0.8).otherwise(0.0).alias("score"))


# Requests that are harmless as a whole.
_GREETING = (
    rf"(?iu)\A(?:please{BLANK}+)?(?:write|draft|compose){BLANK}+(?:a{BLANK}+)?birthday{BLANK}+(?:greeting|message|wish){BLANK}+(?:to|for){BLANK}+"
    rf"(\p{{L}}+(?:{BLANK}+\p{{L}}+){{0,2}})[.!]?\z"
)
_GREETING_FA = rf"(?u)\A(?:لطفاً{BLANK}+)?(?:یک{BLANK}+)?(?:پیام{BLANK}+)?تبریک{BLANK}+تولد{BLANK}+(?:برای|به){BLANK}+(\p{{L}}+(?:{BLANK}+\p{{L}}+){{0,2}}){BLANK}+بنویس[.!؟]?\z"
_NO_NAME = (
    rf"(?iu)(?:{BEFORE}(?:and|with|include|salary|pay|phone|number|email|address|contact|confidential){AFTER}"
    rf"|(?:\A|{BLANK})(?:و|با|حقوق|شماره|تماس|تلفن|محرمانه|آدرس)(?:{BLANK}|\z))"
)
_CONTACT = (
    rf"(?i)\A(?:(?:شماره{BLANK}*(?:تماس|تلفن|همراه|موبایل)?|تلفن|موبایل|همراه){BLANK}*(?:شخصی{BLANK}+)?من{BLANK}*(?:[:=]{BLANK}*)?\+?[0-9][0-9 ()\-]{{6,}}[0-9]{BLANK}*(?:است)?"
    rf"|my{BLANK}+(?:personal{BLANK}+|private{BLANK}+)?(?:phone|mobile)(?:{BLANK}+number)?{BLANK}*(?:is|:|=){BLANK}*\+?[0-9][0-9 ()\-]{{6,}}[0-9])[.!。]*\z"
)
_REFERENCE = (
    rf"(?i)\A(?:شماره{BLANK}+(?:سفارش|پیگیری){BLANK}+غیرمالی{BLANK}+(?:من{BLANK}+)?[0-9۰-۹٠-٩]{{6,}}{BLANK}*(?:است)?"
    rf"|(?:my{BLANK}+)?non[\- ]?financial{BLANK}+(?:order|tracking){BLANK}+(?:number|id){BLANK}*(?:is|:|=){BLANK}*[0-9]{{6,}})[.!。]*\z"
)


def is_greeting(text: Column) -> Column:
    """A birthday greeting to a bare name, nothing else."""
    t = strip(text_of(text))
    name = F.coalesce(F.nullif(F.regexp_extract(t, _GREETING, 1), F.lit("")), F.nullif(F.regexp_extract(t, _GREETING_FA, 1), F.lit("")))
    return F.coalesce(~name.rlike(_NO_NAME), F.lit(False))


def is_contact_declaration(text: Column) -> Column:
    return strip(ascii_digits(text_of(text))).rlike(_CONTACT)


def is_plain_reference(text: Column) -> Column:
    return strip(text_of(text)).rlike(_REFERENCE)
