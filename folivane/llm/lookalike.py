"""Characters that look the same: one table for all operators on text.

Canonical form of a text: no invisible characters, the ordinary blank only, narrow letters, digits and marks of the
usual width, no joined letter forms, ``-`` as the only hyphen, composed letters (NFC), and each word in one alphabet.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of another alphabet beside the Latin letter that looks the same.
CYRILLIC = "АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝӏ"
AS_LATIN_C = "ABEKMHOPCTYXIJSaeopcyxijshdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναριυκγ"
AS_LATIN_G = "ABEZHIKMNOPTYXovapiuky"
# End of the fixed values.

TO_LATIN = dict(zip(CYRILLIC + GREEK, AS_LATIN_C + AS_LATIN_G))
TO_CYRILLIC = dict(zip(AS_LATIN_C, CYRILLIC))


def _tables() -> tuple[str, dict[str, str], dict[str, str]]:
    """Invisible characters; one-to-one replacements; one-to-many replacements. By Unicode's own properties."""
    invisible, one, many = "", {}, {}
    # Planes 2 and 3 hold ideographs, 4 to 13 nothing, 15 and 16 private characters; plane 14 has tags and variation marks.
    for n in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind == "Cs":
            continue
        parts = unicodedata.decomposition(ch).split()
        if kind == "Cf" or n in (0x034F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
            invisible += ch
        elif kind == "Zs":
            one[ch] = " "
        elif ch in "‐‑":
            one[ch] = "-"
        elif parts and parts[0] in ("<wide>", "<narrow>") or parts and parts[0] == "<small>":
            one[ch] = chr(int(parts[1], 16))
        elif 0xFB00 <= n <= 0xFB4F and parts and parts[0] == "<compat>" and len(parts) > 2:
            many[ch] = "".join(chr(int(p, 16)) for p in parts[1:])
    many["ﬅ"] = "st"
    return invisible, one, many


INVISIBLE, ONE, MANY = _tables()
_TABLE = {ord(c): None for c in INVISIBLE} | {ord(k): v for k, v in (ONE | MANY).items()}
_ODD = re.compile("[" + re.escape(INVISIBLE + "".join(ONE) + "".join(MANY)) + "̀-ͯ]")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_TOKEN = re.compile(r"[^\W\d_]+")


_SURE_L = re.compile("[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in TO_CYRILLIC) + "À-ɏ]")
_SURE_C = re.compile("[" + "".join(chr(n) for n in range(0x400, 0x530) if chr(n) not in TO_LATIN) + "]")
_SURE_G = re.compile("[" + "".join(chr(n) for n in range(0x370, 0x400) if chr(n) not in TO_LATIN) + "]")


def _script(word: str) -> str:
    """The alphabet that a word's unmistakable letters belong to: L, C, G, or '' if all its letters are ambiguous."""
    return "L" if _SURE_L.search(word) else "C" if _SURE_C.search(word) else "G" if _SURE_G.search(word) else ""


def one_alphabet(line: str) -> str:
    """``line`` with each word's look-alike letters put into the word's own alphabet. A word of ambiguous letters only
    becomes Latin unless a word next to it is unmistakably of another alphabet."""
    if not _OTHER.search(line) or not _LATIN.search(line):
        return line
    told = _TOKEN.findall(line)
    at = -1

    def fix(m: re.Match) -> str:
        nonlocal at
        at += 1
        w = m.group()
        if w.isascii() or not _OTHER.search(w):
            return w
        s = _script(w)
        if s == "G":
            return w
        if s == "C":
            return "".join(TO_CYRILLIC.get(c, c) for c in w)
        if s == "L" or not {_script(x) for x in told[max(0, at - 1) : at] + told[at + 1 : at + 2]} & {"C", "G"}:
            return "".join(TO_LATIN.get(c, c) for c in w)
        return w

    return _TOKEN.sub(fix, line)


def canonical(text: str) -> str:
    """The canonical form described above, for use inside Python operators."""
    if text.isascii():
        return text
    try:
        text.encode("latin-1")
        if "\xa0" not in text and "\xad" not in text:
            return text
    except UnicodeEncodeError:
        pass
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_TABLE))
    if _OTHER.search(text):
        text = "\n".join(map(one_alphabet, text.split("\n")))
    return text


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, case aside, look-alike characters put into one form."""
    return _WORD.findall(canonical(text).lower())

