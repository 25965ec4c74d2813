"""Folding of look-alike characters and digit substitutions."""

from __future__ import annotations

import re
import unicodedata

# Look-alikes of a-z in other scripts, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ѵ": "v", "г": "r", "п": "n", "ц": "u",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "η": "n", "γ": "y", "σ": "o", "ω": "w", "μ": "u", "ϲ": "c", "ı": "i", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_SCRIPTS = str.maketrans(LOOKALIKES | {"­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None})
_SUBSTITUTED = re.compile(r"(?<![\w@$!|€])(?=[\w@$!|€]*[^\W\d_])(?=[\w@$!|€]*(?:[0-9]|[@$!|€][^\W_]))[\w@$!|€]+")
_LETTERS = str.maketrans(DIGITS)
_GAPS = re.compile(r"[\W_]+")
_ODD = re.compile("[" + "".join(map(chr, _SCRIPTS)) + "]")


def fold(text: str) -> str:
    """Lower-case words, single spaces between and around them; look-alikes folded everywhere, digits inside words.

    Accents are kept: in some languages they tell words apart. Numbers without letters stay numbers.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        if _ODD.search(text):
            text = text.translate(_SCRIPTS)
    if any(c in text for c in "0134579@$!|€8"):
        text = _SUBSTITUTED.sub(lambda m: m[0].rstrip("@$!|€").translate(_LETTERS), text)
    # i, l and 1 are one letter once folded, for 1 stands for either.
    return " " + _GAPS.sub(" ", text).strip().replace("l", "i") + " "
