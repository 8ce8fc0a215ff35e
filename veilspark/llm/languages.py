"""Names of the twelve languages and what can be read off a label or a script."""

from __future__ import annotations

import re

CODES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "zh", "ja", "hi", "ar")

#: Other notations of the languages, lower case: ISO 639-2/3 codes, English and own names.
NOTATIONS = {
    "en": "eng english englisch anglais inglés",
    "de": "ger deu german deutsch",
    "fr": "fre fra french français francais",
    "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues",
    "it": "ita italian italiano",
    "nl": "dut nld dutch nederlands",
    "ru": "rus russian русский",
    "zh": "chi zho cmn chinese 中文 汉语",
    "ja": "jpn japanese 日本語 jp",
    "hi": "hin hindi हिन्दी हिंदी",
    "ar": "ara arabic العربية",
}
_BY_NOTATION = {n: c for c, names in NOTATIONS.items() for n in (c, *names.split())}


def label_language(label: str | None) -> str | None:
    """The language a label names in any notation or regional form; None if it names none of the twelve."""
    if not label:
        return None
    s = label.strip().lower()
    return _BY_NOTATION.get(s) or _BY_NOTATION.get(re.split(r"[-_ ./(;,]", s, maxsplit=1)[0])
