"""Plain words from dirty text: markup, layout, look-alike and invisible characters removed."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# Letters of other scripts and symbols that look like Latin letters.
LOOK_ALIKES = {
    "a": "аɑαӑӓＡａ", "b": "Ьƅʙβ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еёєҽε", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іїıɩιⅰ", "j": "јϳ", "k": "кκ", "l": "ӏⅼ", "m": "мⅿ",
    "n": "ոп", "o": "оοσօө", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "νѵⅴ", "w": "ԝωѡ", "x": "хχⅹ", "y": "уүγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
_TABLE = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others}
_TABLE |= {c: None for c in (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)}
_TABLE |= {ord(c): "'" for c in "’‘ʼ´`′＇"} | {ord(c): "-" for c in "‐‑‒−"}
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_QUOTED = re.compile(r"\n[ \t]*(?:>[ \t]*)+")
_TAG_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|section)\b[^<>]{0,300}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]{0,200}\|)?([^\[\]|]{0,300})\]\]")
_URL = re.compile(r"\[([^\[\]]{0,300})\]\([^()\s]{0,500}\)")
_NOTE = re.compile(r"\[(?:\d{1,3}|sic|note \d{1,3}|citation needed)\]")
_WORDS = re.compile(r"[^\W_]+")
_GROUPED = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")


_FOREIGN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=100_000)
def _latin_run(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", run.translate(_TABLE)).translate(_TABLE) if not unicodedata.combining(c))


def _latin(m: re.Match) -> str:
    """A run of characters beyond ASCII without accents, look-alikes and invisible ones; such runs are short and recur."""
    return _latin_run(m[0]) if len(m[0]) < 64 else _latin_run.__wrapped__(m[0])


def plain(text: str, stars: bool = False) -> str:
    """Text without markup, references, line-end hyphens, invisible characters, accents and look-alikes; the letters' case is kept.

    Asterisks are markup, unless ``stars`` says that they may stand for letters.
    """
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = text.replace("\\n", "\n").replace("\\t", " ").replace('\\"', '"')
    if "`" in text:
        text = text.replace("`", "'")
    if not text.isascii():
        text = _FOREIGN.sub(_latin, text)
    if "-" in text:
        text = _BREAK.sub("", text)
    text = _QUOTED.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("", _TAG_BLOCK.sub(" ", text))
    if "[" in text:
        text = _NOTE.sub("", _URL.sub(r"\1", _LINK.sub(r"\1", text)))
    text = text.replace("~~", "").replace("**", "") if not stars else text.replace("~~", "")
    return text if stars else text.replace("*", "")


def words(text: str | None) -> list[str]:
    """Lower-case words of letters and digits; apostrophes and thousands commas inside words are dropped."""
    if not text:
        return []
    return _WORDS.findall(_GROUPED.sub("", plain(text)).casefold().replace("'", ""))
