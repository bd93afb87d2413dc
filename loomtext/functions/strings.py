"""String functions as column expressions; each stays inside the JVM.

Unicode white space is ``[\\s\\p{Z}]`` in both the expressions and their SQL, so
engines whose ``\\s`` is ASCII agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WS = r"[\s\x{85}\p{Z}]"


def trim_all(c: Column) -> Column:
    """STR1: without white space and newlines at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def normalize_spaces(c: Column) -> Column:
    """STR2: words joined by single spaces."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def repeated_text_key(c: Column) -> Column:
    """STR3: normalised lower case; a text of digits alone stands for any page number."""
    key = F.lower(normalize_spaces(c))
    return F.when(key.rlike(r"^\p{Nd}+$"), "__page_number__").otherwise(key)


def is_blank(c: Column) -> Column:
    return trim_all(F.coalesce(c, F.lit(""))) == ""


def strip_consumed(incoming: Column, consumed: Column) -> Column:
    """STR9: what an incoming snapshot adds to the text already consumed."""
    used = trim_all(consumed)
    return (
        F.when(used == "", incoming)
        .when(incoming == used, "")
        .when(incoming.startswith(used), trim_all(F.substring(incoming, F.length(used) + 1, F.length(incoming))))
        .otherwise(incoming)
    )


def join_non_blank(*parts: Column) -> Column:
    """STR10: trimmed parts that are not blank, joined by a space."""
    return F.array_join(F.filter(F.array(*[trim_all(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), " ")


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(c: Column) -> Column:
    """STR11: the five predefined entities, the ampersand first."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES, c)


_INVALID_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def xml_clean(c: Column) -> Column:
    """STR12: characters that XML 1.0 forbids are dropped, the rest escaped."""
    return xml_escape(F.regexp_replace(c, _INVALID_XML, ""))


def is_xml_text(c: Column) -> Column:
    """STR13: whether XML 1.0 allows every character."""
    return ~c.rlike(_INVALID_XML)


def bounded(c: Column, limit: int = 1024) -> Column:
    """STR14: long text cut to ``limit`` characters and an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def strip_fence(c: Column) -> Column:
    """STR15: the body of a text that is one fenced block (plain or ``xml``) and nothing else."""
    t = trim_all(c)
    body = F.regexp_extract(t, r"(?s)^```(?:[xX][mM][lL])?[ \t]*\r?\n(.*)\n[ \t]*```$", 1)
    return F.when(t.rlike(r"(?s)^```(?:[xX][mM][lL])?[ \t]*\r?\n(.*\n)?[ \t]*```$"), trim_all(body)).otherwise(t)


def normalize_code(c: Column) -> Column:
    """Lower-case language tag with hyphens."""
    return F.replace(F.lower(trim_all(c)), F.lit("_"), F.lit("-"))


def display_code(c: Column, source: bool) -> Column:
    """STR16: script and region for the two Chinese variants; ``auto`` only as a source; null where the tag is not plausible."""
    code = normalize_code(c)
    return (
        F.when(code == "auto", F.lit("auto") if source else F.lit(None))
        .when(~is_language_tag(c), None)
        .when(code.isin("zh-cn", "zh-hans", "zh-hans-cn"), "zh-Hans-CN")
        .when(code.isin("zh-tw", "zh-hant", "zh-hant-tw"), "zh-Hant-TW")
        .otherwise(F.replace(trim_all(c), F.lit("_"), F.lit("-")))
    )


# Recognition hints by language.
OCR_HINTS = {
    "en": "en-US",
    "ko": "ko-KR",
    "ja": "ja-JP",
    "zh-cn": "zh-Hans",
    "zh-tw": "zh-Hant",
    "es": "es-ES",
    "fr": "fr-FR",
    "de": "de-DE",
}


def ocr_hint(c: Column) -> Column:
    """STR17: recogniser locale, null where there is no hint."""
    table = F.create_map(*[F.lit(x) for kv in OCR_HINTS.items() for x in kv])
    return F.try_element_at(table, normalize_code(c))


def prompt(text: Column, source: Column, target: Column) -> Column:
    """STR18: a deterministic instruction; an automatic source is to be detected."""
    origin = F.when(normalize_code(source) == "auto", "the detected source language").otherwise(source)
    return F.format_string("Translate the text below from %s to %s. Reply with the translation only.\n\n%s", origin, target, text)


def error_text(status: Column, message: Column) -> Column:
    """STR19: ``status: message``, unless the message begins with the status."""
    m, s = trim_all(F.coalesce(message, F.lit(""))), trim_all(F.coalesce(status, F.lit("")))
    return F.when(m == "", s).when((s == "") | F.lower(m).startswith(F.lower(s)), m).otherwise(F.concat(s, F.lit(": "), m))


def first_message(message: Column, status: Column, code: Column, default: str = "Unknown error") -> Column:
    """SRC9: first of message, status, ``code N`` that is not blank."""
    keep = lambda c: F.nullif(trim_all(c), F.lit(""))
    return F.coalesce(keep(message), keep(status), F.concat(F.lit("code "), code.cast("string")), F.lit(default))


def is_model_id(c: Column) -> Column:
    """FIL14: 1..128 characters, the first a letter or digit, the rest also ``-._``."""
    return c.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}\-._]{0,127}$") & ~c.rlike(r"[\r\n]")


def is_language_tag(c: Column) -> Column:
    """FIL15: 2..8 letters, then subtags of 1..8 letters or digits."""
    return F.replace(trim_all(c), F.lit("_"), F.lit("-")).rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")


def safe_file_name(c: Column, default: str = "live-conversation") -> Column:
    """SNK2: white space and reserved characters become ``_``; none at the ends."""
    name = F.regexp_replace(c, rf'(?:{WS}|[/\\:*?"<>|])', "_")
    name = F.regexp_replace(name, r"^[_.]+|[_.]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def engine_summary(backend: Column, provider: Column, model: Column, server_name: str = "App server", unknown: str = "unknown") -> Column:
    """PRJ1: who translated: the local server by its name, else the provider; older rows may lack both."""
    engine = F.when(backend == "appServer", server_name).otherwise(F.coalesce(provider, F.when(backend == "llmAPI", "LLM API").otherwise(unknown)))
    return F.concat(F.lit("engine: "), engine, F.lit(" · model: "), model)


def swap_languages(source: Column, target: Column) -> Column:
    """PRJ2: struct(source, target) after a swap; an automatic source becomes the old target."""
    auto = normalize_code(source) == "auto"
    other = F.when(normalize_code(target) == "ko", "en").otherwise("ko")
    return F.struct(target.alias("source"), F.when(auto, other).otherwise(source).alias("target"))


def markdown_run(text: Column, bold: Column, italic: Column, underline: Column, link: Column) -> Column:
    """SEG12: a run as Markdown: escape, link, italic, bold, underline, in that order."""
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))
    t = F.when(link.isNotNull(), F.concat(F.lit("["), t, F.lit("]("), link, F.lit(")"))).otherwise(t)
    t = F.when(italic, F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)
    t = F.when(bold, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    return F.when(underline, F.concat(F.lit("<u>"), t, F.lit("</u>"))).otherwise(t)


def underlined(c: Column) -> Column:
    """SEG13: the texts of ``<u>…</u>`` pairs, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?is)<u>(.*?)</u>"), 1)


def without_underline_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<u>(.*?)</u>", "$1")


def safe_get(array: Column, index: Column | int) -> Column:
    """ARR1: null outside the array."""
    return F.get(array, index)


def zip_adjacent(array: Column) -> Column:
    """ARR2: neighbouring pairs of an array."""
    n = F.size(array)
    return F.when(n < 2, F.array().cast("array<struct<a:string,b:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(array, i).cast("string").alias("a"), F.get(array, i + 1).cast("string").alias("b")))
    )
