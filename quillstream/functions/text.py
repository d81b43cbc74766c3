"""Scalar text functions as column expressions; nothing here leaves the JVM.

Regular expressions are written so that Java's and RE2's engines agree with Unicode-aware ones: letters, digits and white
space are named as classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, word characters and digits as classes.
WS = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"
CYRILLIC, LATIN = "[а-яёА-ЯЁ]", "[a-zA-Z]"

#: Topics and the substrings that bring them in, in order (fixed values).
TOPIC_KEYWORDS = {
    "laboratory": ("лаборатория", "laboratory", "анализ", "analysis", "test", "тест"),
    "diagnostics": ("диагностика", "diagnostics", "диагноз", "diagnosis"),
    "medicine": ("медицина", "medicine", "врач", "doctor", "лечение", "treatment"),
    "research": ("исследование", "research", "study", "научный", "scientific"),
    "equipment": ("оборудование", "equipment", "прибор", "device", "аппарат"),
    "methodology": ("метод", "method", "методика", "methodology", "протокол", "protocol"),
    "quality": ("качество", "quality", "контроль", "control", "стандарт", "standard"),
    "education": ("обучение", "training", "курс", "course", "семинар", "seminar"),
    "news": ("новость", "news", "анонс", "announcement", "событие", "event"),
    "technology": ("технология", "technology", "инновация", "innovation", "цифровой", "digital"),
}
#: Entity kinds in the order of the result: pattern, confidence (fixed values).
ENTITY_PATTERNS = {
    "email": (rf"[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{W}+", 0.95),
    "url": (rf"https?://[^\t-\r\x{{1c}}-\x{{1f}} \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+", 0.95),
    "phone": (rf"\+7(?:{WS}|-)?\(?{D}{{3}}\)?(?:{WS}|-)?{D}{{3}}(?:{WS}|-)?{D}{{2}}(?:{WS}|-)?{D}{{2}}", 0.9),
    "date": (rf"{D}{{1,2}}[./]{D}{{1,2}}[./]{D}{{2,4}}", 0.85),
    "name_ru": (rf"[А-ЯЁ][а-яё]+(?:{WS}+[А-ЯЁ][а-яё]+)+", 0.6),
    "name_en": (rf"[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)+", 0.6),
    "hashtag": (rf"#{W}+", 0.99),
    "mention": (rf"@{W}+", 0.99),
}
#: What every match of a kind holds; texts without it are not searched.
ENTITY_MARKS = {"email": "@", "url": "http", "phone": "+7", "hashtag": "#", "mention": "@"}
#: Substrings of error messages, checked in this order (fixed values).
RETRYABLE = ("timeout", "connection", "network", "rate limit", "flood", "server error", "503", "502", "500")
FINAL = ("not found", "access denied", "forbidden", "unauthorized", "invalid", "credential")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """Trimmed, each run of white space one space; null and blank: empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " "))


def language(clean: Column) -> Column:
    """ru if Cyrillic letters outnumber Latin ones, else en if there are Latin ones, else unknown."""
    letters = lambda which: F.length(clean) - F.length(F.regexp_replace(clean, which + "+", ""))
    some = F.when(clean.rlike(LATIN), "en").otherwise("unknown")
    # most texts have letters of one kind, so that they are only counted where there are Cyrillic ones
    return F.when(~clean.rlike(CYRILLIC), some).when(letters(CYRILLIC) > letters(LATIN), "ru").otherwise(some)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is evaluated once for a row however often `use` names it, also where a filter is moved below the
    projection that c stands in and so carries what c is made of."""
    # get() would work out the type of all that is in `use` again for every row
    return F.element_at(F.transform(F.array(c), use), 1)


def keyword_topics(low: Column, most: int = 5, keywords: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Topics of which a keyword occurs as a substring of a lower-cased text, in the table's order, `most` at most."""

    def found(t: Column) -> Column:
        topics = []
        for topic, words in (keywords or TOPIC_KEYWORDS).items():
            hit = F.contains(t, F.lit(words[0]))
            for w in words[1:]:
                hit = hit | F.contains(t, F.lit(w))
            topics.append(F.when(hit, F.lit(topic)))
        return F.slice(F.array_compact(F.array(*topics)), 1, most)

    return once(low, found)


def lead_summary(clean: Column) -> Column:
    """The first piece of a clean text before . ! or ?, if longer than 10 characters as it stands; over 150 it is cut to
    147 and '...'."""
    piece = F.get(F.split(clean, "[.!?]", 2), F.lit(0))
    kept = F.trim(piece)
    return F.when(F.length(piece) > 10, F.when(F.length(kept) > 150, F.concat(F.substring(kept, 1, 147), F.lit("..."))).otherwise(kept))


def entities_of(c: Column, kind: str) -> Column:
    """All matches of one kind; of names the first five matches, those longer than five characters."""
    found = F.regexp_extract_all(c, F.lit(f"({ENTITY_PATTERNS[kind][0]})"), 1)
    if kind in ENTITY_MARKS:
        found = F.when(F.contains(c, F.lit(ENTITY_MARKS[kind])), found).otherwise(F.array().cast("array<string>"))
    if kind.startswith("name"):
        found = F.filter(F.slice(found, 1, 5), lambda x: F.length(x) > 5)
    return found


def entities(c: Column, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS)) -> Column:
    """array<struct<type, value, confidence>> in the order of kinds; repeats are kept."""
    def shape(kind: str):
        return lambda v: F.struct(F.lit("person_or_org" if kind.startswith("name") else kind).alias("type"), v.alias("value"), F.lit(ENTITY_PATTERNS[kind][1]).alias("confidence"))

    return F.concat(*[F.transform(entities_of(c, k), shape(k)) for k in kinds])


def complexity_mode(c: Column) -> Column:
    """simple below 200 characters; else deep if two of three signs hold: over 50 words, over 5 newlines, @ or # or http."""
    words = F.size(F.filter(F.split(c, rf"{WS}+"), lambda x: x != ""))
    signs = (words > 50).cast("int") + (F.length(c) - F.length(F.replace(c, F.lit("\n"))) > 5).cast("int") + c.rlike("@|#|http").cast("int")
    return F.when(F.length(c) < 200, "simple").when(signs >= 2, "deep").otherwise("simple")


def preview(c: Column, n: int) -> Column:
    """The first n characters, followed by '...' if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prompt_id(system: Column, template: Column) -> Column:
    """sha256: and 16 hexadecimal digits of both prompts."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("\n---\n", system, template), 256), 1, 16))


def retryable(message: Column) -> Column:
    """Whether an error may pass: by its message, true if nothing is known of it."""
    low = F.lower(message)
    return F.when(low.rlike("|".join(RETRYABLE)), True).when(low.rlike("|".join(FINAL)), False).otherwise(True)


def extract_json(c: Column) -> Column:
    """The content of the first fenced block; of an unclosed fence the lines after it; else the text, stripped."""
    text = strip(c)
    closed = r"(?s)```(?:json)?[ \t]*\n?(.*?)```"
    return F.when(text.rlike(closed), strip(F.regexp_extract(text, closed, 1))).when(text.startswith("```"), strip(F.regexp_replace(text, r"^```[^\n]*\n?", ""))).otherwise(text)


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def iso(c: Column) -> Column:
    """A naive UTC time in ISO form, without a zone."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def parse_iso(c: Column) -> Column:
    """The naive time of an ISO form, whose trailing Z is dropped."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "")).cast("timestamp_ntz")


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end."""
    return F.timestamp_diff("MILLISECOND", start, end)
