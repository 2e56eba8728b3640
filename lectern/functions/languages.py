"""Languages by code, and the way from a code or name to a service's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-1 codes of common languages with their English names.
LANGUAGES = {
    "ar": "arabic", "bg": "bulgarian", "bn": "bengali", "ca": "catalan", "cs": "czech", "da": "danish", "de": "german", "el": "greek", "en": "english",
    "es": "spanish", "et": "estonian", "fa": "persian", "fi": "finnish", "fr": "french", "he": "hebrew", "hi": "hindi", "hr": "croatian", "hu": "hungarian",
    "id": "indonesian", "it": "italian", "ja": "japanese", "ko": "korean", "lt": "lithuanian", "lv": "latvian", "nl": "dutch", "no": "norwegian", "pl": "polish",
    "pt": "portuguese", "ro": "romanian", "ru": "russian", "sk": "slovak", "sl": "slovenian", "sv": "swedish", "th": "thai", "tr": "turkish", "uk": "ukrainian",
    "ur": "urdu", "vi": "vietnamese", "zh-hans": "simplified chinese", "zh-hant": "traditional chinese", "zh-yue": "cantonese",
}


def name_of(code: Column) -> Column:
    """The English name of a code; what is no code is title-cased."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(code)), F.initcap(code))


def resolve(wanted: str, offered: dict[str, str]) -> str:
    """The service's code for a language: its exact name, a name that holds the wanted or the other way round, else the wanted title-cased."""
    w = wanted.lower()
    if w in offered:
        return offered[w]
    for name, code in offered.items():
        if w in name or name in w:
            return code
    return wanted.title()
