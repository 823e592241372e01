"""Consistent spelling of text, and the words every similarity in this subpackage is measured on.

``consistent(text)`` gives the one form that visually identical texts share:

* full-width forms of ASCII become ASCII (full-width punctuation next to Han, Kana or Hangul stays),
* a letter followed by a combining accent becomes the composed letter where one exists (NFC),
* joined-letter forms (``ﬁ``, Arabic presentation forms) become their letters,
* invisible characters are dropped unless the script needs them: joiners inside emoji and joiners or
  non-joiners between letters of joining scripts (Arabic, Syriac, Indic, ...) stay,
* every space separator becomes the ordinary space,
* in a word mixing alphabets, letters that look like one of the word's own alphabet become that letter.

Line breaks, repeated spaces, curly quotes, ellipses, ordinals and entities are left alone.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash

# --- fixed values: look-alike letters, prototype = Latin letter ---------------------------------
CYRILLIC_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "ү": "y",
    "к": "k", "г": "r", "п": "n", "м": "m", "т": "t", "в": "b", "н": "h", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
GREEK_LATIN = {
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "σ": "o", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ά": "á", "έ": "é", "ή": "ń", "ί": "í", "ό": "ó", "ύ": "ú",
}
ARMENIAN_LATIN = {"օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U"}
CHEROKEE_LATIN = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮍ": "Y", "Ꮓ": "Z", "Ꭵ": "i", "Ꮒ": "h",
}
#: ASCII characters that look alike, in skeletons only: the published prototypes of the Unicode confusables for these.
ASCII_ALIKE = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "`": "'", '"': "''"}
#: Latin letters outside the ordinary alphabets that look like an ordinary one.
LATIN_LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ƅ": "b", "ɪ": "i"}
#: Greek letters that also stand for Cyrillic ones and the reverse are reached through the Latin prototype.
# -------------------------------------------------------------------------------------------------

PROTOTYPE = {**CYRILLIC_LATIN, **GREEK_LATIN, **ARMENIAN_LATIN, **CHEROKEE_LATIN, **LATIN_LATIN}
_INTO = {
    "CYRILLIC": {v: k for k, v in reversed(CYRILLIC_LATIN.items())},
    "GREEK": {v: k for k, v in reversed(GREEK_LATIN.items())},
    "ARMENIAN": {v: k for k, v in reversed(ARMENIAN_LATIN.items())},
}
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ﻿ﾠ"
_SPACE = "   -   　"
_SUSPECT = re.compile(
    "[̀-ͯ᪰-᫿᷀-᷿҃-҇"
    + _INVISIBLE
    + _SPACE
    + "！-～ﬀ-ﬆﬓ-ﬗﭐ-﷿ﹰ-ﻼǄ-ǌǱ-ǳĲĳŉ"
    + "Ͱ-ϿЀ-ԯԱ-ևἀ-῿Ꭰ-ᏽKÅ"
    + "".join(LATIN_LATIN)
    + "]"
)
_WIDE = re.compile("[！-～]+")
_WIDE_ASCII = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_SPACES = re.compile(f"[{_SPACE}]")
_JOINED = re.compile("[ﬀ-ﬆﬓ-ﬗﭐ-﷿ﹰ-ﻼǄ-ǌǱ-ǳĲĳŉKÅ]")
_HIDDEN = re.compile(f"[{_INVISIBLE}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[" + "".join(PROTOTYPE) + "]")
_JOINING = ("ARABIC", "SYRIAC", "NKO", "MANDAIC", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "TIBETAN", "MYANMAR", "THAI", "LAO")
_EAST = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "BOPOMOFO")
_SCRIPT: dict[str, str] = {}


def script(ch: str) -> str:
    """First word of the character's Unicode name (LATIN, CYRILLIC, CJK, ...), empty where it has none."""
    try:
        return _SCRIPT[ch]
    except KeyError:
        s = _SCRIPT[ch] = unicodedata.name(ch, "").split(" ")[0]
        return s


def _is_emoji(ch: str) -> bool:
    return ch in "️⃣" or unicodedata.category(ch) in ("So", "Sk") or ch in "♀♂"


def _wide(text: str) -> str:
    """Full-width ASCII becomes ASCII; punctuation stays where the nearest letter or digit is East Asian."""
    if not any(script(c) in _EAST for c in text if c >= "ᄀ" and not "！" <= c <= "～"):
        return text.translate(_WIDE_ASCII)
    out = list(text)
    for i, ch in enumerate(text):
        if not "！" <= ch <= "～":
            continue
        plain = chr(ord(ch) - 0xFEE0)
        if not plain.isalnum():
            left = next((c for c in reversed(text[:i]) if c.isalnum()), "")
            right = next((c for c in text[i + 1 :] if c.isalnum()), "")
            if (left and script(left) in _EAST) or (right and script(right) in _EAST):
                continue
        out[i] = plain
    return "".join(out)


def _visible(text: str) -> str:
    """Drops invisible characters except joiners that emoji or the script need."""
    out = []
    for i, ch in enumerate(text):
        if _HIDDEN.match(ch):
            if ch in "‌‍":
                left = text[i - 1] if i else ""
                right = text[i + 1] if i + 1 < len(text) else ""
                if left and right and ((_is_emoji(left) and _is_emoji(right)) or (script(left) in _JOINING and (script(right) in _JOINING or not right.isalnum()))):
                    out.append(ch)
            elif not (i and text[i - 1].isalpha()) and not (i + 1 < len(text) and text[i + 1].isalpha()) and ch in "‎‏":
                out.append(ch)  # direction marks away from letters
            continue
        out.append(ch)
    return "".join(out)


def _own_alphabet(match: re.Match) -> str:
    """A word mixing alphabets: every letter that looks like one of the word's own alphabet becomes that letter."""
    word = match.group()
    if not _FOREIGN.search(word):
        return word
    counts: dict[str, int] = {}
    fixed: dict[str, int] = {}
    for ch in word:
        s = script(ch)
        counts[s] = counts.get(s, 0) + 1
        if s == "LATIN":
            clear = not any(ch in table for table in _INTO.values())
        else:
            clear = ch not in PROTOTYPE
        fixed[s] = fixed.get(s, 0) + clear
    if len(counts) == 1 and "LATIN" not in counts:
        return word
    own = max(counts, key=lambda s: (fixed[s] > 0, counts[s] + fixed[s], s == "LATIN"))
    if own == "LATIN":
        if len(counts) == 1 and not any(c in LATIN_LATIN for c in word):
            return word
        return "".join(PROTOTYPE.get(c, c) if script(c) != "LATIN" or (c in LATIN_LATIN and c != "ı") else c for c in word)
    into = _INTO.get(own)
    if into is None:
        return word
    return "".join(c if script(c) == own else into.get(PROTOTYPE.get(c, c), c) for c in word)


def consistent(text: str | None) -> str | None:
    """The consistent form of ``text``; None stays None."""
    if text is None or text.isascii() or not _SUSPECT.search(text):
        return text
    if _HIDDEN.search(text):
        text = _visible(text)
    if _WIDE.search(text):
        text = _wide(text)
    if _JOINED.search(text):
        text = _JOINED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _SPACES.sub(" ", text)
    text = unicodedata.normalize("NFC", text)
    if _FOREIGN.search(text):
        text = _LETTERS.sub(_own_alphabet, text)
    return text


def _members(chars: str) -> list[str]:
    """The characters of a class written with ranges, all of the basic plane."""
    return re.findall(f"[{chars}]", "".join(map(chr, range(0x10000))))


def _prototypes() -> dict[int, str]:
    """Look-alike table: prototype of each character, in decomposed form; prototypes of prototypes are followed."""
    table = {**PROTOTYPE, **ASCII_ALIKE}
    out = {}
    for ch, to in table.items():
        out[ord(ch)] = unicodedata.normalize("NFD", "".join(ASCII_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", to)))
    out |= {ord(c): "" for c in _members(_INVISIBLE)} | {ord(c): " " for c in _members(_SPACE)}
    return out


_SKELETON = _prototypes()


def skeleton(text: str | None) -> str | None:
    """Look-alike skeleton: decompose, replace every character by its prototype, decompose again; invisible characters are nothing.

    Texts that look the same have equal skeletons, whatever their alphabets; it is a key for grouping, not a text to read."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_SKELETON)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFKD", text).translate(_SKELETON))


def has_lookalikes(text: str, bones: str) -> bool:
    """Whether the skeleton ``bones`` replaced anything but ASCII, or the text has accents of their own: only then can its form differ."""
    return not text.isascii() and (text.translate(_ASCII_ONLY) != bones or not unicodedata.is_normalized("NFC", text))


_ASCII_ONLY = {ord(c): to for c, to in ASCII_ALIKE.items()}


_LINK = re.compile(r"https?://\S+|@\w+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of the text: consistent form, lower case, links and handles removed, runs of letters and digits."""
    if not text:
        return []
    text = consistent(text).lower()
    if "@" in text or "http" in text:
        text = _LINK.sub("", text)
    return _WORD.findall(text)


_HASHES: dict[str, int] = {}


def word_hash(word: str) -> int:
    """32-bit hash of a word, the same in every process; words recur, so a bounded table remembers them."""
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
    return h
