"""Languages and writing systems (FIL2-FIL5, SET2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import normalize_code

# Writing systems by language.
SCRIPTS_OF = {
    "hangul": ["ko"],
    "kana": ["ja"],
    "han": ["ja", "zh"],
    "latin": [
        "en", "fr", "de", "es", "pt", "it", "nl", "ca", "eu", "gl",
        "af", "sq", "id", "ms", "fil", "sv", "no", "nb", "da", "fi",
        "is", "pl", "cs", "sk", "sl", "hr", "ro", "hu", "tr", "vi",
        "et", "lv", "lt", "sw", "sr",
    ],
    "cyrillic": ["ru", "uk", "bg", "be", "mk", "sr"],
    "arabic": ["ar", "fa", "ur", "sd"],
    "devanagari": ["hi", "mr", "ne"],
    "greek": ["el"],
    "hebrew": ["he"],
    "thai": ["th"],
}

# Code point ranges of the writing systems.
RANGES = {
    "latin": r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}",
    "han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}",
    "cyrillic": r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "devanagari": r"\x{900}-\x{97F}",
    "greek": r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}",
    "hebrew": r"\x{590}-\x{5FF}",
    "thai": r"\x{E00}-\x{E7F}",
}


def matches_language(code: Column, expected: Column) -> Column:
    """FIL3: equal tags, or one a subtag of the other; blank tags never match."""
    a, b = normalize_code(code), normalize_code(expected)
    return (a != "") & (b != "") & ((a == b) | a.startswith(F.concat(b, F.lit("-"))) | b.startswith(F.concat(a, F.lit("-"))))


def expected_scripts(language: Column) -> Column:
    """FIL5: names of the language's writing systems; empty where it is unknown."""
    base = F.split_part(normalize_code(language), F.lit("-"), F.lit(1))
    return F.filter(F.array(*[F.when(base.isin(codes), name) for name, codes in SCRIPTS_OF.items()]), lambda x: x.isNotNull())


def observed_scripts(text: Column) -> Column:
    """Names of the writing systems of a text; ``other`` for further letters."""
    every = "".join(RANGES.values())
    found = [F.when(text.rlike(f"[{r}]"), name) for name, r in RANGES.items()]
    other = F.when(F.regexp_replace(text, f"[{every}]", "").rlike(r"\p{IsAlphabetic}"), "other")
    return F.filter(F.array(*found, other), lambda x: x.isNotNull())


def script_evidence(text: Column, language: Column) -> Column:
    """FIL4: unknown languages and texts without letters pass; else a script must be shared."""
    want, have = expected_scripts(language), observed_scripts(F.coalesce(text, F.lit("")))
    return (F.size(want) == 0) | (F.size(have) == 0) | F.arrays_overlap(want, have)


def accepts(field: Column, text: Column, code: Column, source: Column, target: Column) -> Column:
    """FIL2: whether a transcript belongs on its side of the conversation."""
    expected = F.when(field == "original", source).otherwise(target)
    given = normalize_code(F.coalesce(code, F.lit(""))) != ""
    return F.when(given, matches_language(code, expected)).otherwise(script_evidence(text, expected))
