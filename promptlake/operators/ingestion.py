"""Policy documents: pages to lines, units and chunks; rules found in them; quotes checked against them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from promptlake.functions.patterns import AFTER, BLANK, BLANKS, SOLID, found, has_any, spans, text_of
from promptlake.functions.text import BLANK_CHARACTERS, normalize, normalized_literal, sentences, sha256, squeeze, strip

# Words that make a chunk, or a unit, a candidate for rules.
CHUNK_WORDS = [
    "ممنوع",
    "محرمانه",
    "نباید",
    "مجاز نیست",
    "باید",
    "الزام",
    "اجباری",
    "طبقه‌بندی",
    "سرّی",
    "سری",
    "دسترسی",
    "افشا",
    "انتشار",
    "اشتراک‌گذاری",
    "کد ملی",
    "شماره کارت",
    "شبا",
    "رمز",
    " backup",
    "لاگ",
    "CDR",
    "ریز مکالمات",
    "صورتجلسه",
    "قرارداد",
    "مناقصه",
    "بودجه",
]
UNIT_WORDS = [
    "ممنوع",
    "محرمانه",
    "نباید",
    "مجاز نیست",
    "طبقه‌بندی",
    "طبقه بندی",
    "سرّی",
    "سری",
    "حفاظت",
    "حریم خصوصی",
    "افشا",
    "افشای",
    "مسدود",
    "رمز",
    "رمز عبور",
    "کلید خصوصی",
    "توکن",
    "کد ملی",
    "کدملی",
    "شماره کارت",
    "شبا",
    "حساب بانکی",
    "اطلاعات تماس",
    "تلفن همراه",
    "موبایل",
    "ip داخلی",
    "نشانی سرور",
]


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MARKS = re.compile(rf"[0-9{BLANKS}\-–—/().،,:؛|صفحه]+")


def _is_boilerplate(text: str) -> bool:
    t = text.strip(BLANK_CHARACTERS)
    size = len(t)
    if size < 40:
        return True
    # a fifth of plain letters settles it; only other texts pay for the larger class
    raw = t.encode()
    if (len(raw) - len(raw.translate(None, _LETTERS))) / size < 0.2 and len(_MARKS.sub("", t)) / size < 0.2:
        return True
    lines = [x for x in (x.strip(BLANK_CHARACTERS) for x in t.split("\n")) if x]
    n = len(lines)
    if n < 3:
        return False
    # a line that is more than half of all stands in the middle once they are sorted
    most = lines.count(sorted(lines)[n // 2])
    return most >= 3 and most / n > 0.5


@F.arrow_udf(BooleanType())
def _boilerplate(texts: pa.Array) -> pa.Array:
    return pa.array([_is_boilerplate(t or "") for t in texts.to_pylist()], pa.bool_())


def boilerplate(text: Column) -> Column:
    """Too short, mostly digits and marks, or one line over half of at least three lines and three times."""
    return _boilerplate(text)


def candidate(text: Column, words: list[str] | None = None) -> Column:
    return has_any(normalize(text), [normalized_literal(w) for w in words or CHUNK_WORDS])


_CHUNKS = "array<struct<ordinal: int, span_start: int, span_end: int, text: string>>"
_BREAK = re.compile(r"(?<=[.!؟?؛;۔])\s|\n")


def _windows(text: str, smallest: int, largest: int, overlap: int) -> list[dict]:
    """Sliding windows that end at the last sentence end past `smallest`, if there is one."""
    ends = [m.end() for m in _BREAK.finditer(text)]
    out, start, at = [], 0, 0
    while start < len(text):
        end = min(start + largest, len(text))
        if end < len(text):
            while at < len(ends) and ends[at] < start + smallest:
                at += 1
            last = at
            while last < len(ends) and ends[last] <= end:
                last += 1
            if last > at:
                end = ends[last - 1]
        piece = text[start:end].strip()
        if piece:
            out.append({"ordinal": len(out), "span_start": start, "span_end": end, "text": piece})
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def _unpadded(text: Column) -> Column:
    """Lines without blanks at their ends; most texts have none, which a look back from each line break tells."""
    return F.when(text.rlike(f"\n(?<={BLANK}\n)"), F.regexp_replace(text, f"{BLANK}+\n", "\n")).otherwise(text)


def page_table(pages: DataFrame, key: str = "document_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, full_text, pages array<struct<page, start, end>>): a document's pages joined by line breaks."""
    told = pages.select(F.col(key), F.col(page).alias("page"), strip(_unpadded(text_of(F.col(text)))).alias("text")).where("text <> ''")
    one = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<page: int, start: int, end: int>>)").alias("out"))

    def step(s, x):
        end = s["at"] + F.length(x["text"]) + 1
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(x["page"].cast("int").alias("page"), s["at"].alias("start"), end.alias("end")))).alias("out"))

    return one.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("full_text"), F.aggregate("p", start, step, lambda s: s["out"]).alias("pages"))


def page_of(offset: Column, pages: Column) -> Column:
    """The page whose range holds an offset."""
    return F.get(F.filter(pages, lambda p: (offset >= p["start"]) & (offset < p["end"])), F.lit(0))["page"]


def chunks(documents: DataFrame, key: str = "document_id", text: str = "full_text", pages: str | None = "pages", smallest: int = 800, largest: int = 1200, ratio: float = 0.17, words: list[str] | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, *beside, ordinal, span_start, span_end, text, text_hash, page, is_boilerplate, is_candidate)."""
    overlap = round(smallest * ratio)

    @F.arrow_udf(_CHUNKS)
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("text", pa.string())]))
        return pa.array([_windows(t.as_py() or "", smallest, largest, overlap) for t in texts], kind)

    kept = [key, *beside] + ([pages] if pages else [])
    each = documents.select(*kept, F.explode(cut(F.col(text))).alias("c")).select(*kept, "c.*")
    each = each.withColumn("text_hash", sha256(F.col("text"))).withColumn("is_boilerplate", boilerplate(F.col("text")))
    each = each.withColumn("is_candidate", ~F.col("is_boilerplate") & candidate(F.col("text"), words))
    each = each.withColumn("page", page_of(F.col("span_start"), F.col(pages)) if pages else F.lit(None).cast("int"))
    return each.drop(pages) if pages else each


# Words that make a small chunk a restricted one.
RESTRICTED = ["ممنوع", "محرمانه", "نباید", "مجاز نیست", "طبقه‌بندی‌شده", "سرّی", "محرمانگی", "طبقه بندی شده"]


def small_chunks(text: Column, smallest: int = 100, largest: int = 800, overlap: int = 50) -> Column:
    """array<struct<content, is_restricted>>: paragraphs, long ones by sentences, packed up to `largest` (native folds)."""
    cut = lambda t: F.filter(F.split(t, rf"(?<=[.٬؟!]){BLANK}*"), lambda s: strip(s) != "")
    paragraphs = F.filter(F.split(text_of(text), r"\n\n+"), lambda p: strip(p) != "")
    segments = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > largest, cut(p)).otherwise(F.array(p))))

    def packed(parts: Column, joiner: str, roomy) -> Column:
        empty = F.struct(F.lit("").alias("buffer"), F.expr("cast(array() as array<string>)").alias("out"))

        def step(s, part):
            buffer = s["buffer"]
            fits, full = roomy(buffer, part), F.length(buffer) >= smallest
            tail = F.concat(F.substring(buffer, -overlap, overlap), F.lit(" "), part)
            grown = F.when(buffer == "", part).when(fits, F.concat(buffer, F.lit(joiner), part)).when(full, tail).otherwise(F.concat(buffer, F.lit(" "), part))
            done = (buffer != "") & ~fits & full
            return F.struct(grown.alias("buffer"), F.when(done, F.concat(s["out"], F.array(buffer))).otherwise(s["out"]).alias("out"))

        return F.aggregate(parts, empty, step, lambda s: F.when(strip(s["buffer"]) != "", F.concat(s["out"], F.array(strip(s["buffer"])))).otherwise(s["out"]))

    fits = lambda buffer, part: F.length(buffer) + F.length(part) + 1 <= largest
    first = packed(F.transform(segments, strip), "\n", fits)
    again = F.flatten(F.transform(first, lambda c: F.when(F.length(c) > largest, F.transform(packed(cut(c), " ", fits), strip)).otherwise(F.array(c))))
    restricted = lambda c: has_any(c, RESTRICTED)
    return F.transform(again, lambda c: F.struct(c.alias("content"), restricted(c).alias("is_restricted")))


# How lines of a policy look.
_METADATA = [
    rf"(?i)\A:?{BLANK}*(?:Sensitivity|Action|Status|Version|Policy{BLANK}*ID){AFTER}",
    rf"(?i)\A:?{BLANK}*(?:ALLOW_EXTERNAL|ROUTE_LOCAL|MASK_AND_ALLOW_EXTERNAL|BLOCK|EXTERNAL_DIRECT|EXTERNAL_MASKED|LOCAL|BLOCKED){AFTER}",
]
_EXAMPLES = rf"(?i)\A(?:Positive{BLANK}*Examples|Negative{BLANK}*Examples|Positive{BLANK}*/{BLANK}*Allowed{BLANK}*Examples|Allowed{BLANK}*Examples|Positive{BLANK}*/{BLANK}*Forbidden{BLANK}*Examples)"
_NUMBERED = [rf"\A(?:فصل|بخش|پیوست|قسمت){BLANK}+[۰-۹0-9IVXLCDMivxlcdm]+(?:{BLANK}*[:ـ\-–—.]|{BLANK}+)", rf"\A[.\-–—]?[۰-۹0-9]+[\-.)]?{BLANK}+"]
_BULLET = [rf"\A[•*\-–—]{BLANK}+", rf"\A[۰-۹0-9]+[\-.)]{BLANK}+", rf"(?i)\A[الف-یabc]\){BLANK}+"]
_CLAUSE = rf"\A(?:ماده|بند|تبصره|قاعده|اصل|تعریف|نکته){BLANK}+[۰-۹0-9A-Za-z_\-]*[:ـ\-–—.]?"
_TABLE = [rf"(?i)\AID{BLANK}+سناریو", rf"(?i)\AT[0-9]+{BLANK}+"]


def _any(line: Column, patterns: list[str]) -> Column:
    told = line.rlike(patterns[0])
    for p in patterns[1:]:
        told = told | line.rlike(p)
    return told


def line_flags(line: Column, following: Column) -> dict[str, Column]:
    """What a trimmed line is, seen with the next one (null at the end)."""
    example = line.rlike(_EXAMPLES)
    meta_of = lambda x: _any(x, [*_METADATA, _EXAMPLES])
    meta = meta_of(line)
    table = (F.contains(line, F.lit("|")) & (line.startswith("|") | line.endswith("|"))) | _any(line, _TABLE)
    bullet, clause = _any(line, _BULLET), line.rlike(_CLAUSE)
    open_end = ~line.rlike(r"[.!؟?؛]\z") & ~line.endswith(":")
    numbered = (line != "") & (F.length(line) <= 80) & ~meta & open_end & _any(line, _NUMBERED)
    titled = F.coalesce(meta_of(following), F.lit(False)) & ~numbered
    n_words = F.size(F.split(line, f"{BLANK}+"))
    short = (F.length(line) <= 60) & open_end & ~line.startswith(":") & n_words.between(2, 8)
    heading = (line != "") & (F.length(line) <= 120) & ~meta & ~table & ~titled & (numbered | (~clause & ~bullet & short))
    level = line.rlike(rf"\Aسطح{BLANK}+") | titled
    return {"heading": heading, "numbered": numbered, "metadata": meta, "example": example, "table": table, "bullet": bullet, "clause": clause, "level": level}


FLAGS = ["heading", "metadata", "example", "table", "bullet", "clause", "level"]


def lines(documents: DataFrame, key: str = "document_id", text: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """(key, *order, line_no, line, flags): non-empty trimmed lines of every page, classified."""
    keys = [key, *order]
    trimmed = F.filter(F.transform(F.split(text_of(F.col(text)), "\n"), strip), lambda x: x != "")
    pairs = F.zip_with(trimmed, F.slice(trimmed, 2, 1 << 30), lambda a, b: F.struct(a.alias("line"), b.alias("following")))
    # outer, here and below: an inner generator's inferred filter would work its array out a second time
    each = documents.select(*keys, F.posexplode_outer(pairs).alias("line_no", "p")).where("line_no IS NOT NULL")
    flags = line_flags(F.col("p.line"), F.col("p.following"))
    return each.select(*keys, "line_no", F.col("p.line").alias("line"), *(c.alias(n) for n, c in flags.items()))


_UNIT = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("first", IntegerType()),
            StructField("last", IntegerType()),
            StructField("carried", ArrayType(IntegerType())),
        ]
    )
)


def _ends(line: str, marks: str) -> bool:
    return line[-1:] in marks


def _units(rows: list[dict]) -> list[dict]:
    """Runs of one page's classified lines that form a unit; metadata lines are carried into the next one."""
    out: list[dict] = []
    carried: list[int] = []
    n, i = len(rows), 0

    def run(kind: str, start: int, stop: int):
        nonlocal carried
        out.append({"kind": kind, "first": start, "last": stop - 1, "carried": carried})
        carried = []

    breaks = lambda r, *flags: any(r[f] for f in ("heading", "table", "level", *flags))
    while i < n:
        row, j = rows[i], i + 1
        if row["heading"]:
            carried = []
            run("HEADING", i, j)
        elif row["metadata"] and not row["example"]:
            carried.append(i)
        elif row["table"]:
            while j < n and rows[j]["table"]:
                j += 1
            run("TABLE", i, j)
        elif row["level"]:
            while j < n and not breaks(rows[j], "bullet"):
                j += 1
                if _ends(rows[j - 1]["line"], ".!؟?"):
                    break
            run("CLAUSE", i, j)
        elif row["bullet"] or row["example"]:
            marked = row["example"]
            while j < n and not breaks(rows[j], "example"):
                j += 1
                if not rows[j - 1]["bullet"] and not marked and _ends(rows[j - 1]["line"], "."):
                    break
            run("BULLET_GROUP", i, j)
        else:
            while j < n and not breaks(rows[j], "bullet", "example", "clause"):
                j += 1
            run("CLAUSE" if row["clause"] or carried else "PARAGRAPH", i, j)
        i = j
    return out


@F.arrow_udf(_UNIT)
def _unit_runs(pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("carried", pa.list_(pa.int32()))]))
    return pa.array([_units(p.as_py() or []) for p in pages], kind)


def packed_sentences(text: Column, largest: int) -> Column:
    """Sentences packed up to a length (each counts one more for its joint); never cut."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("buffer"), F.lit(0).alias("size"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s, x):
        full = (s["size"] + F.length(x) > largest) & (F.size(s["buffer"]) > 0)
        return F.struct(
            F.when(full, F.array(x)).otherwise(F.concat(s["buffer"], F.array(x))).alias("buffer"),
            (F.when(full, 0).otherwise(s["size"]) + F.length(x) + 1).alias("size"),
            F.when(full, F.concat(s["out"], F.array(F.array_join(s["buffer"], " ")))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(sentences(text), start, step, lambda s: F.concat(s["out"], F.array(F.array_join(s["buffer"], " "))))


def units(pages: DataFrame, key: str = "document_id", page: str = "page", text: str = "text", largest: int = 1200, words: list[str] | None = None) -> DataFrame:
    """(key, ordinal, page, section_title, text, unit_type, span_start, span_end, is_candidate).

    Lines are classified by Spark; only the runs of a page's lines are found in
    Python. Offsets count units one after another, not places in the source.
    """
    trimmed = F.filter(F.transform(F.split(text_of(F.col(text)), "\n"), strip), lambda x: x != "")
    pairs = F.zip_with(trimmed, F.slice(trimmed, 2, 1 << 30), lambda a, b: F.struct(a.alias("line"), b.alias("following")))
    flagged = F.transform(pairs, lambda p: F.struct(p["line"].alias("line"), *(c.alias(n) for n, c in line_flags(p["line"], p["following"]).items() if n in FLAGS)))
    told = pages.select(F.col(key), F.col(page).alias("page"), flagged.alias("lines"))
    told = told.withColumn("runs", _unit_runs("lines"))
    each = told.select(key, "page", "lines", F.posexplode_outer("runs").alias("run_no", "u")).where("run_no IS NOT NULL")
    line = lambda i: F.get(F.col("lines"), i)["line"]
    joined = F.array_join(F.transform(F.concat("u.carried", F.sequence("u.first", "u.last")), line), "\n")
    each = each.select(key, "page", "run_no", F.col("u.kind").alias("unit_type"), joined.alias("joined"))
    split = F.col("unit_type").isin("CLAUSE", "PARAGRAPH") & (F.length("joined") > largest)
    parts = F.when(split, packed_sentences(F.col("joined"), largest)).otherwise(F.array("joined"))
    each = each.select(key, "page", "run_no", "unit_type", F.posexplode_outer(parts).alias("part", "text")).where("part IS NOT NULL")
    order = Window.partitionBy(key).orderBy("page", "run_no", "part")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns(
        {
            "ordinal": F.row_number().over(order) - 1,
            "section_title": F.last(F.when(F.col("unit_type") == "HEADING", F.col("text")), ignorenulls=True).over(before),
            "span_start": (F.sum(F.length("text") + 1).over(before) - F.length("text") - 1).cast("int"),
        }
    )
    return each.withColumn("span_end", F.col("span_start") + F.length("text")).withColumn("is_candidate", candidate(F.col("text"), words or UNIT_WORDS)).drop("run_no", "part")


# Phrases by severity, words by category, and words that are never keywords.
SEVERE = {
    "CRITICAL": ["مطلقاً ممنوع", "به‌هیچ‌وجه", "به هیچ وجه"],
    "HIGH": ["ممنوع", "نباید", "مجاز نیست"],
    "MEDIUM": ["باید مراقب باشید", "با احتیاط"],
}
RESTRICTION = ["ممنوع", "محرمانه", "نباید", "مجاز نیست", "حذف شود", "عدم افشای", "جایز نیست"]
CATEGORIES = {
    "داده‌های شخصی": ["شخصی", "هویت", "نام", "آدرس", "تلفن", "ایمیل", "کد ملی", "شناسنامه"],
    "اطلاعات مالی": ["مالی", "حساب", "بانک", "تراکنش", "وجه", "بودجه", "قرارداد", "فروش", "خرید"],
    "امنیت": ["امنیت", "رمز", "احراز", "دسترسی", "ویروس", "حمله", "نفوذ", "فایروال", "رمزنگاری"],
    "محرمانگی": ["محرمانه", "طبقه‌بندی", "سرّی", "سری", "محدود", "دسترسی محدود"],
}
STOP_WORDS = (
    "و در به از که این آن با برای هم تا را همه هر یک باید است می توان شود نمی خواهد کرد دارد نبود بود شد نشود کنند نیز اما یا پس همچنین "
    "ضمناً البته اگر چون چرا چه کدام هرگز همواره همیشه گاهی غالباً معمولاً مثلاً یعنی لطفاً حتماً فقط بسیار بیشتر کمتر حداقل حداکثر حدود "
    "تقریباً نسبتاً کاملاً قسمتاً عملاً نظری عملی فنی اداری قانونی حقوقی مربوط مورد ذیر ذاتی ماجرا بخش ماده بند تبصره فصل قسمت"
).split()


def _clean_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(text_of(text), r"[\-\[\](){}*+?.\\^$|]", " "), f"{BLANK}+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"[۰-۹0-9.,;:!?؟،؛«»\"'()\[\]{}]", "")), lambda w: F.length(w) >= 3)


def keywords(text: Column, n: int = 8) -> Column:
    """The most frequent words of three letters or more that aren't stop words; ties by first place. For chunks."""
    placed = F.array_sort(F.transform(_clean_words(text), lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    empty = F.expr("cast(array() as array<struct<n: int, at: int, w: string>>)")
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("at"), F.lit(0).alias("n"), empty.alias("out"))
    ended = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct((-s["n"]).alias("n"), s["at"].alias("at"), s["w"].alias("w"))))).otherwise(s["out"])

    def step(s, x):
        same = F.coalesce(x["w"] == s["w"], F.lit(False))
        return F.struct(
            x["w"].alias("w"), F.when(same, s["at"]).otherwise(x["at"]).alias("at"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), F.when(same, s["out"]).otherwise(ended(s)).alias("out")
        )

    return F.transform(F.slice(F.array_sort(F.aggregate(placed, start, step, ended)), 1, n), lambda x: x["w"])


def top_keywords(docs: DataFrame, key: str, text: str, n: int = 8) -> DataFrame:
    """(key, keywords) of long texts: words are counted by Spark's aggregation, the best n kept per text.

    Texts are dealt out by key once, so neither words nor their counts are shuffled.
    """
    dealt = docs.select(key, text).repartition(key)
    words = dealt.select(key, F.posexplode_outer(_clean_words(F.col(text))).alias("at", "w")).where("w IS NOT NULL")
    counts = words.groupBy(key, "w").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    kept = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    told = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("k")).select(key, F.transform("k", lambda x: x["w"]).alias("keywords"))
    return docs.select(key).join(told, key, "left").withColumn("keywords", F.coalesce("keywords", F.array()))


def _numbered(text: Column) -> Column:
    """The first numbered part that a chunk names; its words are looked for first."""
    part = F.regexp_extract(text, rf"(?:بند|ماده|ماده{BLANK}*[0-9]|تبصره|قانون|بخش){BLANK}*[0-9۰-۹]+", 0)
    return F.when(has_any(text, ["بند", "ماده", "تبصره", "قانون", "بخش"]), part).otherwise("")


def heuristic_fires(text: Column) -> Column:
    """Whether anything in a chunk restricts, numbers or lists."""
    return has_any(text, RESTRICTION) | (_numbered(text) != "") | text.rlike(r"(?m)^[\-•●▪►◆*]")


def heuristic_rule(text: Column, index: Column) -> Column:
    """struct<title, keywords, severity, category>, or null where nothing in the chunk restricts, numbers or lists."""
    numbered, fires = _numbered(text), heuristic_fires(text)
    severity = F.when(has_any(text, SEVERE["CRITICAL"]), "CRITICAL").when(has_any(text, SEVERE["HIGH"]), "HIGH").when(has_any(text, SEVERE["MEDIUM"]), "MEDIUM").otherwise("LOW")
    votes = [F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("c")) for i, (c, words) in enumerate(CATEGORIES.items())]
    best = F.array_max(F.array(*votes))
    first = F.substring(strip(F.regexp_extract(text, r"\A(.{10,80}?(?:[.٬؟]|\z))", 1)), 1, 80)
    title = F.when(first != "", first).when(numbered != "", numbered).otherwise(F.concat(F.lit("قاعده "), (index + 1).cast("string")))
    rule = F.struct(title.alias("title"), keywords(text).alias("keywords"), severity.alias("severity"), F.when(best["n"] > 0, best["c"]).otherwise("امنیت").alias("category"))
    return F.when(fires, rule)


# A structured rule's header (its word comes before the look back, so that a search looks for the word), a section's, and categories by code.
_RULE_HEADER = rf"قاعده(?<!{SOLID}قاعده){BLANK}+[A-Za-z]{{2,8}}[\-–—]?{BLANK}?[0-9]{{1,4}}{BLANK}*[ـ–—\-]*{BLANK}*[^\n]{{2,100}}"
_RULE_PARTS = rf"قاعده{BLANK}+([A-Za-z]{{2,8}})[\-–—]?{BLANK}?([0-9]{{1,4}}){BLANK}*[ـ–—\-]*{BLANK}*([^\n]{{2,100}})"
_SECTION_HEADER = rf"(?<!{SOLID})[۰-۹0-9]{{1,2}}{BLANK}*[.)–]{BLANK}*[^\n]{{2,80}}"
CODE_CATEGORY = {
    "SEC": "امنیت",
    "PII": "داده‌های شخصی",
    "FIN": "اطلاعات مالی",
    "HR": "منابع انسانی",
    "MED": "سلامت",
    "PRJ": "محرمانگی",
    "BIZ": "اطلاعات مالی",
    "DOC": "محرمانگی",
}


def structured_rules(documents: DataFrame, key: str = "document_id", text: str = "full_text", pages: str = "pages") -> DataFrame:
    """(key, policy_code, title, body, page, severity, category, keywords, text_hash) of documents with two rule headers or more.

    A rule's body runs to the next header; the first of equal codes counts.
    """
    headers = spans(F.col(text), _RULE_HEADER)
    # a header's word is looked for first: most texts hold none
    held = documents.where(F.contains(F.col(text), F.lit("قاعده")))
    told = held.select(key, F.col(text).alias("t"), F.col(pages).alias("pages"), headers.alias("headers")).where(F.size("headers") >= 2)
    sections = F.filter(spans(F.col("t"), _SECTION_HEADER), lambda s: ~F.exists("headers", lambda h: F.abs(h["start"] - s["start"]) < 3))
    starts = F.array_sort(F.concat(F.transform("headers", lambda h: h["start"]), F.transform(sections, lambda s: s["start"])))
    told = told.withColumn("starts", starts)
    each = told.select(key, "t", "pages", "starts", F.explode("headers").alias("h"))
    part = lambda i: F.regexp_extract("h.text", _RULE_PARTS, i)
    code = F.concat_ws("-", F.upper(part(1)), part(2))
    following = F.array_min(F.filter("starts", lambda s: s > F.col("h.start")))
    body = squeeze(F.substring(F.col("t"), F.col("h.end") + 1, F.coalesce(following, F.length("t")) - F.col("h.end")))
    each = each.select(
        key,
        F.col("h.start").alias("start"),
        code.alias("policy_code"),
        F.upper(part(1)).alias("prefix"),
        F.substring(squeeze(F.concat(F.lit("قاعده "), code, F.lit(" ـ "), strip(part(3)))), 1, 120).alias("title"),
        strip(F.substring(strip(body), 1, 1200)).alias("body"),
        F.element_at(F.filter("pages", lambda p: p["start"] <= F.col("h.start")), -1)["page"].alias("page"),
    )
    first = Window.partitionBy(key, "policy_code").orderBy("start")
    each = each.withColumn("n__", F.row_number().over(first)).where("n__ = 1 AND length(body) >= 20")
    blocked, local = F.contains("body", F.lit("BLOCKED")), F.col("body").rlike(rf"LOCAL[\-_ ]?ONLY|فقط{BLANK}+محلی")
    known = F.create_map(*(F.lit(x) for kv in CODE_CATEGORY.items() for x in kv))
    return each.where(blocked | local).select(
        key,
        "policy_code",
        "title",
        "body",
        "page",
        F.when(blocked, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.coalesce(known[F.col("prefix")], F.lit("امنیت")).alias("category"),
        keywords(F.col("body")).alias("keywords"),
        sha256(F.concat_ws("§", "policy_code", normalize(F.col("body")))).alias("text_hash"),
    )


_EXPLICIT = rf"(?i)\A{BLANK}*(?:قاعده|Rule){BLANK}+([A-Z]+-[0-9]+){BLANK}*[ـ:–—\-]?{BLANK}*([^\n]*)"
_ACTIONS = r"(?<![0-9A-Za-z_])(LOCAL_ONLY|ROUTE_LOCAL|ALLOW_EXTERNAL|BLOCKED|BLOCK|MASK_AND_ALLOW_EXTERNAL)(?![0-9A-Za-z_])"


def explicit_rule(text: Column) -> Column:
    """struct<concept_key, name, name_fa, description, action, sensitivity, conditions>, or null unless exactly one action is named."""
    head = F.regexp_extract(text, _EXPLICIT, 0)
    name, title = F.regexp_extract(text, _EXPLICIT, 1), strip(F.regexp_extract(text, _EXPLICIT, 2))
    body = strip(F.substring(text, F.length(head) + 1, F.length(text)))
    same = {"LOCAL_ONLY": "ROUTE_LOCAL", "BLOCKED": "BLOCK"}
    actions = F.array_distinct(F.transform(found(body, _ACTIONS, 1), lambda a: F.coalesce(F.create_map(*(F.lit(x) for kv in same.items() for x in kv))[a], a)))
    action = F.get(actions, F.lit(0))
    said = F.filter(F.transform(F.split(body, rf"(?<=[.!؟]){BLANK}+"), lambda s: strip(squeeze(s))), lambda s: s != "")
    conditions = F.filter(said, lambda s: s.rlike("(?i)نیست|نمی|مشمول|به تنهایی|به‌تنهایی|مانند|except|placeholder"))
    rule = F.struct(
        F.replace(F.lower(name), F.lit("-"), F.lit("_")).alias("concept_key"),
        name.alias("name"),
        F.when(title != "", title).otherwise(name).alias("name_fa"),
        body.alias("description"),
        action.alias("action"),
        F.when(action == "ALLOW_EXTERNAL", "PUBLIC").otherwise("CONFIDENTIAL").alias("sensitivity"),
        conditions.alias("conditions"),
    )
    return F.when((name != "") & (F.size(actions) == 1), rule)


def is_policy_metadata(text: Column, section: Column) -> Column:
    """Definitions and scope that restrict nothing by themselves."""
    named = F.coalesce(section, F.lit("")).rlike("هدف و دامنه|تصمیم.?های مجاز")
    told = strip(text).rlike(rf"(?i)\A(?:ALLOW_EXTERNAL|LOCAL_ONLY|BLOCKED){BLANK}*:") | strip(text).startswith("سیاست حفاظت از داده و استفاده از سرویس")
    return ~text.rlike(rf"(?i)\A{BLANK}*(?:قاعده|Rule){BLANK}+") & (named | told)


def _bare_quote(quote: Column) -> Column:
    q = strip(F.regexp_replace(strip(text_of(quote)), r"\A[«\"']+|[»\"']+\z", ""))
    return strip(F.regexp_replace(q, rf"(?i)\Aبخش/عنوان:{BLANK}*[^\n]+\n*", ""))


def best_sentence(wanted: Column, text: Column) -> Column:
    """struct<score, sentence>: the sentence with the largest share of the wanted words (repeats count); the first of equals."""
    parts = F.filter(F.transform(F.split(text_of(text), r"[\n.!؟؛]+"), strip), lambda s: F.length(s) > 5)

    def scored(s, i):
        words = F.split(F.lower(squeeze(s)), " ")
        share = F.size(F.filter(wanted, lambda w: F.array_contains(words, w))) / F.size(wanted)
        return F.struct(share.alias("score"), (-i).alias("order"), s.alias("sentence"))

    best = F.array_max(F.transform(parts, scored))
    return F.when((F.size(wanted) > 0) & (best["score"] > 0), F.struct(best["score"].alias("score"), best["sentence"].alias("sentence")))


def with_how(df: DataFrame, quote: str, source: str, least: float = 0.7) -> DataFrame:
    """df with `how` (exact, normalized, similar, or null) a quote is found in its source, and the `sentence` most like it."""
    q = _bare_quote(F.col(quote))
    told = df.withColumns({"q__": q, "t__": strip(text_of(F.col(source))), "nq__": normalize(q), "nt__": normalize(F.col(source))})
    told = told.withColumn("wanted__", F.filter(F.split("nq__", f"{BLANK}+"), lambda w: F.length(w) > 1))
    told = told.withColumn("best__", best_sentence(F.col("wanted__"), F.col(source)))
    given = strip(F.regexp_replace(strip(text_of(F.col(quote))), r"\A[«\"']+|[»\"']+\z", "")) != ""
    how = (
        F.when(~(given & (F.col("t__") != "")), F.lit(None).cast("string"))
        .when(F.contains("t__", F.col("q__")), "exact")
        .when(F.contains("nt__", F.col("nq__")), "normalized")
        .when(F.col("best__.score") >= least, "similar")
    )
    return told.withColumn("how", how).withColumn("sentence", F.col("best__.sentence")).drop("q__", "t__", "nq__", "nt__", "wanted__", "best__")


def with_provenance(concepts: DataFrame, units_: DataFrame, unit_key: str = "unit_id") -> DataFrame:
    """concepts with `verdict` ACCEPTED or REJECTED; a similar quote is replaced by its sentence, a missing page filled."""
    source = units_.select(unit_key, F.col("text").alias("source__"), F.col("page").alias("page__"))
    told = with_how(concepts.join(source, unit_key, "left"), "source_quote", "source__")
    return (
        told.withColumn("verdict", F.when(F.col("how").isNotNull(), "ACCEPTED").otherwise("REJECTED"))
        .withColumn("source_quote", F.when(F.col("how") == "similar", F.col("sentence")).otherwise(F.col("source_quote")))
        .withColumn("source_page", F.coalesce("source_page", "page__"))
        .drop("source__", "page__", "sentence")
    )


CONCEPT = (
    "struct<conceptKey: string, name: string, nameFa: string, descriptionFa: string, category: string, sensitivity: string, action: string, "
    "positiveExamples: array<string>, negativeExamples: array<string>, conditions: array<string>, keywords: array<string>, sourceQuote: string, "
    "sourcePage: int, confidence: double, flags: array<string>>"
)
SENSITIVITIES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "HIGHLY_CONFIDENTIAL")
CONCEPT_ACTIONS = ("ALLOW_EXTERNAL", "MASK_AND_ALLOW_EXTERNAL", "ROUTE_LOCAL", "BLOCK")


def json_part(raw: Column, lists: bool = False) -> Column:
    """A model's answer without thoughts and fences, from its first to its last bracket."""
    clean = strip(F.regexp_replace(text_of(raw), r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(clean, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    clean = F.when(clean.rlike(r"(?is)```.*```"), fenced).otherwise(clean)
    inner = F.regexp_extract(clean, r"(?s)[\[{].*[\]}]" if lists else r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(clean)


def extracted_concepts(raw: Column, source: Column | None = None) -> Column:
    """array<struct<concept, errors, flags>> of a model's answer (a list, or an object with concepts or rules, or one concept)."""
    text = json_part(raw, lists=True)
    many = F.from_json(F.when(text.startswith("["), text), f"array<{CONCEPT}>")
    wrapped = F.from_json(F.when(text.startswith("{"), text), f"struct<concepts: array<{CONCEPT}>, rules: array<{CONCEPT}>>")
    single = F.from_json(F.when(text.startswith("{"), text), CONCEPT)
    alone = F.when(single["conceptKey"].isNotNull() | single["name"].isNotNull(), F.array(single))
    listed = F.coalesce(many, wrapped["concepts"], wrapped["rules"], alone, F.expr(f"cast(array() as array<{CONCEPT}>)"))

    def judged(c):
        missing = lambda name: F.when(F.coalesce(F.length(F.trim(c[name])), F.lit(0)) == 0, F.lit(f"{name} missing"))
        errors = F.array_compact(
            F.array(
                missing("conceptKey"),
                missing("name"),
                missing("sourceQuote"),
                F.when(~F.coalesce(c["sensitivity"].isin(*SENSITIVITIES), F.lit(False)), F.lit("sensitivity unknown")),
                F.when(~F.coalesce(c["action"].isin(*CONCEPT_ACTIONS), F.lit(False)), F.lit("action unknown")),
                F.when(~F.coalesce(c["confidence"].between(0, 1), F.lit(True)), F.lit("confidence out of range")),
            )
        )
        size = F.length(c["sourceQuote"])
        broad = size > 350
        if source is not None:
            broad = broad | ((size / F.greatest(F.length(source), F.lit(1)) > 0.6) & (size > 150))
        unlike = ((c["sensitivity"] == "PUBLIC") & (c["action"] != "ALLOW_EXTERNAL")) | ((c["sensitivity"] != "PUBLIC") & (c["action"] == "ALLOW_EXTERNAL"))
        flags = F.array_distinct(
            F.concat(
                F.coalesce(c["flags"], F.expr("cast(array() as array<string>)")),
                F.array_compact(F.array(F.when(broad, F.lit("LOOKS_TOO_BROAD")), F.when(unlike, F.lit("SENSITIVITY_ACTION_MISMATCH")))),
            )
        )
        return F.struct(c.alias("concept"), errors.alias("errors"), flags.alias("flags"))

    return F.transform(listed, judged)


def merged_concepts(found_concepts: DataFrame, key: str = "concept_key", order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(concepts, sources): the first of each key is the concept, every row is one of its sources."""
    first = Window.partitionBy(key).orderBy(order)
    concepts = found_concepts.withColumn("n__", F.row_number().over(first)).where("n__ = 1").drop("n__")
    sources = found_concepts.select(key, "source_quote", sha256(strip(F.col("source_quote"))).alias("quote_hash")).dropDuplicates([key, "quote_hash"])
    return concepts, sources


_WORD = re.compile(r"\S+")
_DROP = re.compile(r"[‌\-_:،.؛!?\"'«»()\[\]]")


def _alike(a: str, b: str) -> bool:
    """Equal, one inside the other, or seven in ten letters shared."""
    if a == b or (a and b and (a in b or b in a)):
        return True
    letters = set(a)
    return bool(a and b) and 2 * sum(c in letters for c in b) / (len(a) + len(b)) >= 0.7


def _anchored(chunk: str, anchor: str) -> str | None:
    wanted = [w for w in (_DROP.sub("", x).lower() for x in anchor.split()) if w]
    places = list(_WORD.finditer(chunk))
    if not wanted or not places:
        return None
    # which anchor words each place of the chunk is like; a window's score is the size of their union
    like = [{i for i, w in enumerate(wanted) if _alike(_DROP.sub("", m[0]).lower(), w)} for m in places]
    best, at = 0, -1
    for i in range(len(places)):
        seen: set[int] = set()
        for size in range(1, min(len(places) - i, len(wanted) + 4) + 1):
            seen = seen | like[i + size - 1]
            if size >= max(1, len(wanted) - 2) and len(seen) > best:
                best, at = len(seen), i
    if at < 0 or best / len(wanted) < 0.5:
        return None
    start = places[at].start()
    header = re.compile(r"\s+قاعده\s+[A-Z0-9_-]+").search(chunk, start + 5)
    return chunk[start : header.start() if header else len(chunk)].strip() or None


@F.arrow_udf(StringType())
def anchor_quote(chunks_: pa.Array, anchors: pa.Array) -> pa.Array:
    """The passage of a chunk that begins like the anchor, up to the next rule header; null if none is alike enough."""
    return pa.array([_anchored(c.as_py() or "", a.as_py() or "") for c, a in zip(chunks_, anchors, strict=True)], pa.string())


def admissible_upload(files: DataFrame, largest: int = 10 << 20) -> DataFrame:
    """binaryFile rows with file_type, clean_name and refusal (null: admitted)."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.upper(F.regexp_extract(name, r"\.([A-Za-z]+)\z", 1))
    kind = F.when(kind.isin("PDF", "TXT", "MD"), kind).when(kind == "MARKDOWN", "MD")
    magic = F.substring("content", 1, 4) == F.lit(b"%PDF")
    nul = F.contains("content", F.lit(b"\x00"))
    refusal = (
        F.when(kind.isNull(), "type")
        .when(F.length("content") > largest, "size")
        .when((kind == "PDF") & ~magic, "not a PDF")
        .when((kind != "PDF") & nul, "not text")
    )
    return files.withColumns({"file_type": kind, "clean_name": F.regexp_replace(name, r"[^0-9A-Za-z._؀-ۿ-]", "_"), "refusal": refusal})


def page_lines(items: DataFrame, key: str = "page") -> DataFrame:
    """(key, text) from positioned items (key, ordinal, str, x, y, eol): a new line where y moves by over 4 or after eol; right to left."""
    order = Window.partitionBy(key).orderBy("ordinal")
    solid = items.where(F.length(strip(F.col("str"))) > 0)
    turn = (F.abs(F.col("y") - F.lag("y").over(order)) > 4) | F.coalesce(F.lag("eol").over(order), F.lit(False))
    told = solid.withColumn("new__", F.coalesce(turn, F.lit(True)).cast("int"))
    told = told.withColumn("line", F.sum("new__").over(order))
    each = told.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("x"), "ordinal", "str"))).alias("w"))
    each = each.select(key, "line", strip(F.array_join(F.transform("w", lambda w: w["str"]), " ")).alias("said"))
    page = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("lines"))
    said = F.transform("lines", lambda x: x["said"])
    numbers = F.reverse(F.transform(said, lambda s: s.rlike(r"\A[0-9۰-۹\-– ]+\z")))
    trailing = F.coalesce(F.nullif(F.array_position(numbers, F.lit(False)), F.lit(0)) - 1, F.size(said)).cast("int")
    return page.select(key, F.array_join(F.slice(said, F.lit(1), F.size(said) - trailing), "\n").alias("text"))


def units_to_extract(units_: DataFrame, least: int = 20, bullets: int = 30) -> DataFrame:
    """Units from which concepts are drawn: candidates, clauses and paragraphs, bullet groups of some length; no headings, none too short."""
    kind, size = F.col("unit_type"), F.length("text")
    wanted = F.col("is_candidate") | kind.isin("CLAUSE", "PARAGRAPH") | ((kind == "BULLET_GROUP") & (size > bullets))
    return units_.where((kind != "HEADING") & wanted & (size >= least))


# What a proposed rule may name, and the reasons why an answer is refused.
DETECTOR_TYPES = ("REGEX", "CHECKSUM", "DICTIONARY", "SEMANTIC")
CHECKSUM_KINDS = ("IR_NATIONAL_ID", "IR_BANK_CARD", "IBAN")
RULE_ACTIONS = ("BLOCK_EXTERNAL", "MASK", "FLAG_REVIEW")
REJECTIONS = ("MALFORMED_RESPONSE", "INVALID_RULE", "ANCHOR_NOT_FOUND_IN_SOURCE", "QUOTE_NOT_FOUND_IN_SOURCE")

PROPOSAL = (
    "struct<label: string, category: string, detectorType: string, regex: struct<source: string, flags: string>, checksumKind: string, action: string, "
    "priority: int, keywordsHint: array<string>, confidence: double, anchor: string>"
)


def _proposals(raw: Column) -> Column:
    return F.from_json(json_part(raw), f"struct<sourceQuote: string, rules: array<{PROPOSAL}>>")


def _quoted(told: Column, chunk: Column) -> Column:
    """Whether the proposals' quote stands in the chunk, blanks apart."""
    quote = strip(F.coalesce(told["sourceQuote"], F.lit("")))
    return (quote != "") & (F.contains(chunk, quote) | F.contains(squeeze(chunk), squeeze(quote)))


def validated_extraction(raw: Column, chunk: Column) -> Column:
    """array<struct<rule, quote, rejection>> of a model's answer about a chunk: every proposed rule with its quote, or why it is refused.

    An answer that is no object with a list of rules is one MALFORMED_RESPONSE.
    """
    return _validated(_proposals(raw), _quoted(_proposals(raw), chunk))


def _validated(told: Column, quoted: Column) -> Column:
    quote = strip(F.coalesce(told["sourceQuote"], F.lit("")))
    between = lambda c, lo, hi: F.coalesce(F.length(c).between(lo, hi), F.lit(False))
    among = lambda c, known: F.coalesce(c.isin(*known), F.lit(False))
    hints = lambda r: F.coalesce((F.size(r["keywordsHint"]) <= 12) & F.forall(r["keywordsHint"], lambda k: F.length(k).between(2, 60)), F.lit(True))

    def fits(r):
        typed = F.when(r["detectorType"] == "REGEX", between(r["regex"]["source"], 1, 500)).when(r["detectorType"] == "CHECKSUM", among(r["checksumKind"], CHECKSUM_KINDS)).otherwise(True)
        known = r["checksumKind"].isNull() | among(r["checksumKind"], CHECKSUM_KINDS)
        shaped = between(r["label"], 3, 120) & between(r["category"], 2, 80) & among(r["detectorType"], DETECTOR_TYPES) & among(r["action"], RULE_ACTIONS)
        return shaped & typed & known & hints(r) & F.coalesce(r["priority"].between(1, 1000) & r["confidence"].between(0, 1), F.lit(False))

    def judged(r):
        rejection = (
            F.when(~F.coalesce(fits(r), F.lit(False)), REJECTIONS[1])
            .when((F.coalesce(r["anchor"], F.lit("")) == "") & ~quoted, REJECTIONS[3])
        )
        return F.struct(r.alias("rule"), F.when(rejection.isNull() & (F.coalesce(r["anchor"], F.lit("")) == ""), quote).alias("quote"), rejection.alias("rejection"))

    nothing = F.array(F.struct(F.lit(None).cast(PROPOSAL).alias("rule"), F.lit(None).cast("string").alias("quote"), F.lit(REJECTIONS[0]).alias("rejection")))
    return F.coalesce(F.transform(told["rules"], judged), nothing)


def extraction(df: DataFrame, raw: str, chunk: str) -> DataFrame:
    """df, one row for each proposed rule: rule, quote, rejection. Anchors are looked up in the chunk."""
    # what all rules of an answer share is worked out once, outside the function over its rules
    told = df.withColumn("told__", _proposals(F.col(raw)))
    told = told.withColumn("quoted__", _quoted(F.col("told__"), text_of(F.col(chunk))))
    each = told.withColumn("e__", F.explode_outer(_validated(F.col("told__"), F.col("quoted__")))).drop("told__", "quoted__").where("e__ IS NOT NULL")
    anchored = F.col("e__.rejection").isNull() & (F.coalesce(F.col("e__.rule.anchor"), F.lit("")) != "")
    # only chunks that an anchor is looked up in go to Python
    given = lambda c: F.when(anchored, c)
    each = each.withColumn("at__", given(anchor_quote(given(F.col(chunk)), given(F.col("e__.rule.anchor")))))
    rejection = F.when(anchored & F.col("at__").isNull(), REJECTIONS[2]).otherwise(F.col("e__.rejection"))
    return each.withColumns({"rule": F.col("e__.rule"), "quote": F.coalesce("e__.quote", "at__"), "rejection": rejection}).drop("e__", "at__")
