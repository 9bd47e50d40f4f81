"""Problem 9: garbled text from wrong character encoding.

Round-trip repair. Each candidate (wrong, intended) pair of encodings is tried on the whole line: encoded back to the bytes it
came from, decoded strictly as the intended encoding. Where no pair carries a whole line, the stretches that could have
come from a pair are found by a pattern over characters and tried alike; a pair that repaired one stretch of a line is then trusted
with stretches of less evidence. A reading is taken when a garbling cost drops enough; this is repeated for nested
layers until it drops no more. A stretch whose bytes are damaged (strict decoding fails, or the replacement character stands in
it) is reported as garbled but left as it is, and a repaired line that still holds characters out of place counts as not restored.
A character lost from a text written in a one-byte encoding leaves no trace in the bytes and cannot be told.
"""
from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings a text is wrongly read in (one byte a character, then several), and what it may have been written in.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1250", "cp437", "cp850")
TO_HAN = tuple((w, m) for w in ("cp1252", "mac_roman", "cp1251", "cp437", "cp850") for m in ("gb18030", "big5"))
TO_CYRILLIC = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"),
               ("mac_roman", "cp1251"), ("mac_roman", "koi8-r"), ("latin-1", "iso8859-5"), ("cp1252", "cp866"), ("cp850", "cp1251"), ("cp437", "cp1251"))
TO_LATIN = tuple((w, m) for w in ("cp850", "cp437", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250") for m in ("cp1252",)) + (("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437"))
WIDE = (("gb18030", "utf-8"), ("big5", "gb18030"), ("big5", "utf-8"), ("gb18030", "big5"), ("cp932", "utf-8"), ("cp932", "gb18030"), ("euc_kr", "gb18030"), ("cp949", "utf-8"))
MARGIN = 0.4
SUSPECT = r"[^\x00-\x7f]"  # this cheap test runs before Python


def _table(enc: str) -> dict[int, str]:
    """Byte to character; bytes the code page leaves open pass through as control characters, as lenient readers do."""
    return {b: bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256)}


_TABLES = {e: _table(e) for e in SINGLE + ("iso8859-5",)}
_BACK = {e: {c: b for b, c in reversed(t.items())} for e, t in _TABLES.items()}


def _cls(t: dict[int, str], lo: int, hi: int) -> str:
    return "".join(re.escape(t[b]) for b in range(lo, hi))


def _utf8_pattern(enc: str) -> re.Pattern:
    t = _TABLES[enc]
    c = f"[{_cls(t, 0x80, 0xC0)}]"
    return re.compile(f"(?:[{_cls(t, 0xC2, 0xE0)}]{c}|[{_cls(t, 0xE0, 0xF0)}]{c}{{2}}|[{_cls(t, 0xF0, 0xF5)}]{c}{{3}})+")


_UTF8 = {e: _utf8_pattern(e) for e in SINGLE}
# bytes 0x40.. are second bytes of a two-byte character; an ASCII stretch in between may be digits, blanks or plain words
_HAN_RUN = {e: re.compile(f"[{_cls(t, 0x81, 0x100)}][{_cls(t, 0x40, 0x100)}]+(?:[ -?\n]{{0,12}}[{_cls(t, 0x81, 0x100)}][{_cls(t, 0x40, 0x100)}]+)*") for e, t in _TABLES.items()}
_WORD_RUN = {e: re.compile(f"[{_cls(t, 0x80, 0x100)}A-Za-z]*[{_cls(t, 0x80, 0x100)}][{_cls(t, 0x80, 0x100)}A-Za-z]*(?:[ ,.\n-]{{1,3}}[{_cls(t, 0x80, 0x100)}]+(?![A-Za-z]))*") for e, t in _TABLES.items()}
_WIDE = re.compile(r"[^\x00-\x7f]{2,}(?:[\x00-\x7f]{0,12}[^\x00-\x7f]{2,})*")
_FINE_PUNCT = set("，。、；：？！“”‘’（）《》【】—…·「」『』«»„‚–¿¡№•‧∙⋅・\xa0\xad\u2002\u2003\u2007\u2009\u200b\u200c\u200d\u202f\u2060\ufeff\u3000")


@lru_cache(maxsize=65536)
def char_cost(c: str) -> float:
    """How unlikely a character is in sound text of the corpus languages."""
    o = ord(c)
    if o < 0x80:
        return 0.0 if o >= 32 or c in "\n\t\r" else 1.0
    if c in _FINE_PUNCT:
        return 0.05
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        try:
            row = c.encode("gb2312")[0]
        except UnicodeEncodeError:
            return 1.2
        return 0.0 if row < 0xD8 else 0.5
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        return 0.1
    if c in "àâäáçéèêëíîïñóôöùúüßœæÄÖÜÉÀÇ":
        return 0.3
    if 0xC0 <= o <= 0x17F and o not in (0xD7, 0xF7):
        return 0.6
    if 0xFF01 <= o <= 0xFF5E or 0x2E80 <= o <= 0x2FD5 or 0x3000 <= o <= 0x303F or 0xF900 <= o <= 0xFAFF or 0x300 <= o <= 0x36F:
        return 0.3
    if 0x370 <= o <= 0x3FF or 0x400 <= o <= 0x45F or 0x3040 <= o <= 0x30FF or o >= 0x1F300:
        return 0.7
    if 0xA0 <= o < 0xC0 or 0x2000 <= o <= 0x26FF or o in (0xD7, 0xF7):
        return 1.2
    return 2.5


@lru_cache(maxsize=1 << 16)
def cost(s: str) -> float:
    """Sum of character costs; letters beyond ASCII cost more beside odd neighbours, as does a capital inside a Cyrillic word."""
    total, prev, pc = 0.0, "", 0.0
    for c in s:
        k = char_cost(c)
        total += k
        if k >= 0.3 and pc >= 0.3 and k + pc >= 0.9 and not ("一" <= c <= "鿿"):
            total += 0.5
        if c >= "\x80" and c.isupper() and prev.islower():
            total += 1.0
        prev, pc = c, k
    return total


def _bytes(s: str, enc: str) -> bytes | None:
    back = _BACK[enc]
    try:
        return bytes([back[c] for c in s])
    except KeyError:
        return None


def _decoded(raw: bytes | None, meant: str) -> str | None:
    try:
        return None if raw is None else raw.decode(meant)
    except UnicodeDecodeError:
        return None


def _keep_if(test, worth=lambda old: True):
    """A replacement function that takes the decoded stretch only if the garbling cost drops by ``margin`` and ``test(old, new)`` holds; ``worth`` is asked before decoding."""
    def sub(enc: str, meant: str, margin: float = MARGIN):
        def one(m: re.Match) -> str:
            if not worth(m[0]):
                return m[0]
            new = _decoded(_bytes(m[0], enc), meant)
            return new if new is not None and new != m[0] and cost(new) < cost(m[0]) - margin and test(m[0], new) else m[0]
        return one
    return sub


def _high(s: str) -> int:
    return sum(1 for c in s if c >= "\x80")


def _cyrillic(old: str, new: str) -> bool:
    n = sum("а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ" for c in new)
    return n >= 4 and n >= 0.8 * _high(new) and cost(new) < 0.6 * cost(old) and not re.search("[A-Za-z][а-яА-Я]|[а-яА-Я][A-Za-z]", new)


_AS_UTF8 = _keep_if(lambda old, new: True)
_LONE_HAN = re.compile("[A-Za-z][\u4e00-\u9fff](?:[A-Za-z]|\\W|$)")
_AS_HAN = _keep_if(lambda old, new: cost(new) < 0.2 * len(new) and not _LONE_HAN.search(new), lambda old: len(old) >= 6 and cost(old) >= 0.4 * max(6, _high(old)))
_AS_CYRILLIC = _keep_if(_cyrillic, lambda old: len(old) >= 4 and cost(old) > 0.15 * _high(old))
_AS_LATIN = _keep_if(lambda old, new: cost(new) <= 0.5 * cost(old) and all(c < "\x80" or c in "’“”–—…«»" or c in _SOUND_ACCENTS for c in new),
                     lambda old: cost(old) >= 0.9 * _high(old) and bool(re.search("[a-z]{2}", old)) and not any(c.isspace() for c in old if c >= "\x80"))


def _wide(enc: str, meant: str, t: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        try:
            new = _decoded(s.encode(enc), meant)
        except UnicodeEncodeError:
            return s
        if 2 * sum("㐀" <= c <= "鿿" or "㄀" <= c <= "ㄯ" for c in s) < _high(s):
            return s
        return new if new is not None and len(s) > 3 and cost(new) < 0.5 * cost(s) - MARGIN else s
    return _WIDE.sub(one, t)


def _damaged(t: str) -> bool:
    """Whether some stretch reads as another encoding but for a few lost bytes."""
    for m in _WIDE.finditer(t):
        s = m[0]
        k = cost(s)
        if len(s) < 6 or k < 0.3 * len(s):
            continue
        for enc, meant in WIDE:
            rough = s.encode(enc, "replace").decode(meant, "replace")
            kept = rough.replace("\ufffd", "").replace("?", "")
            if len(kept) > 3 and len(rough) - len(kept) <= 0.4 * len(rough) and cost(kept) < 0.35 * k:
                return True
    return False


def _whole(t: str) -> str:
    """The cheapest strict reading of the whole line under one pair of encodings; UTF-8 goes first, as hardly anything else is valid UTF-8. The line itself where none is cheaper."""
    best, k = t, cost(t)
    least = k - MARGIN
    for pairs, test in ((((e, "utf-8") for e in SINGLE), lambda new: True), (TO_HAN, lambda new: cost(new) < 0.2 * len(new) and not _LONE_HAN.search(new)), (TO_CYRILLIC, lambda new: _cyrillic(t, new)),
                        (TO_LATIN, lambda new: cost(new) <= 0.5 * k and all(c < "\x80" or c in "’“”–—…«»" or c in _SOUND_ACCENTS for c in new) and not any(c.isspace() for c in t if c >= "\x80"))):
        for enc, meant in pairs:
            new = _decoded(_bytes(t, enc), meant)
            if new is not None and new != t and (c := cost(new)) < least and test(new):
                best, least = new, c
        if best != t:
            break
    return best


def _utf8_stretches(t: str, e: str) -> tuple[str, bool]:
    """(text with the UTF-8 stretches read right, whether signs of lost bytes stay): few other signs beyond ASCII in a line that is otherwise such stretches are what is left of damaged ones."""
    new = _UTF8[e].sub(_AS_UTF8(e, "utf-8"), t)
    if new == t:
        return t, False
    new = _UTF8[e].sub(_AS_UTF8(e, "utf-8", 0.0), t)
    rest = _high(_UTF8[e].sub("", t))
    return new, 0 < rest <= 0.1 * _high(t)


def _layer(t: str, only_utf8: bool) -> tuple[str, bool, bool, bool]:
    """(the cheapest text one round trip away, or ``t``; whether bytes are seen to be lost; whether single stretches were UTF-8; whether stretches were repaired)."""
    best = _whole(t)
    if best != t:
        return best, False, False, False
    least, lost, utf8 = cost(t) - MARGIN, False, False
    for e in SINGLE:
        if _UTF8[e].search(t):
            new, left = _utf8_stretches(t, e)
            if new != t and (k := cost(new)) < least:
                best, least, lost, utf8 = new, k, left, True
                if not _ODD.search(new):
                    return best, lost, True, True
    if only_utf8:
        return best, lost, utf8, True

    def stretches(pattern: dict, how, e: str, m: str) -> str:
        new = pattern[e].sub(how(e, m), t)
        return pattern[e].sub(how(e, m, 0.0), t) if new != t else t
    tries = [lambda e=e, m=m: stretches(_HAN_RUN, _AS_HAN, e, m) for e, m in TO_HAN]
    tries += [lambda e=e, m=m: stretches(_WORD_RUN, _AS_CYRILLIC, e, m) for e, m in TO_CYRILLIC]
    tries += [lambda e=e, m=m: stretches(_WORD_RUN, _AS_LATIN, e, m) for e, m in TO_LATIN]
    tries += [lambda e=e, m=m: _wide(e, m, t) for e, m in WIDE]
    for f in tries:
        new = f()
        if new != t and (k := cost(new)) < least:
            best, least, lost, utf8 = new, k, False, False
            if not (_ODD.search(new) or _LOSS.search(new)):
                break  # sound text: no other reading can be better by more than trifles
    return best, lost, utf8, True


# what a repaired line should not hold any more: rare signs, letters of another script inside a Latin word, capitals inside a Cyrillic one
_LEFT = re.compile("[A-Za-z][\u0370-\u04ff\u2500-\u25ff]|[\u0370-\u04ff\u2500-\u25ff][A-Za-z]|[\x80-\x9f]|[а-яё][А-ЯЁЀ-ЏҐ]|[\u4e00-\u9fff][\u00b8-\u00ba\u00bc-\u024f]|[\u00b8-\u00ba\u00bc-\u024f][\u4e00-\u9fff]|[а-яё]?[ѓ-џґ†‡‰‹€]|‚[À-ÿŒœ]")


def _left_over(t: str) -> bool:
    """Whether a repaired line still holds characters out of place."""
    return bool(_LEFT.search(t) or _ODD.search(t)) or any(c >= "\x80" and char_cost(c) >= 0.6 for c in t)


_LOSS = re.compile("\ufffd|锟斤|斤拷")
_SOUND_ACCENTS = "àâäáçéèêëíîïñóôöùúüßœæÄÖÜÉÀÇÁÍÓÚÑŒÈÊ"
_CAPS = "".join(c for c in _SOUND_ACCENTS if c.isupper()) + "ÆÅØÂÃÊËÎÏÔÒÙÛ"
_COMMON_HAN = "".join(c for r in range(0xB0, 0xD8) for x in range(0xA1, 0xFF) if (c := bytes([r, x]).decode("gb2312", "ignore")))
_SOUND = re.escape("".join(_FINE_PUNCT)) + _SOUND_ACCENTS + _COMMON_HAN + "\x00-\x7fЀ-ӿͰ-Ͽ！-～⼀-⿕豈-\ufaff̀-ͯ\U0001f300-\U0001faff"
# a look worth taking: a character that sound text hardly holds (rare ideographs only where three stand close), or a capital inside a Cyrillic word
_ODD = re.compile(f"[^{_SOUND}㐀-䶿一-鿿]|(?:[^{_SOUND}].?){{3}}|[а-я][А-Я]|[РСГВЄІЇ][°±ІіґµЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈ¤Ґ¦§©Є«¬®Ї¶·№є»јЅѕї]|[А-ЯЁ]{{2}}[а-яё]|‚[ÄÅÇ]|[A-Za-z][{_CAPS}][a-z]")


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """(text given back, whether it was garbled, whether all of it was restored).

    Null and empty texts are sound. Rare letters, other scripts, look-alikes and symbols that do not
    round-trip to cheaper text are sound. Nested layers are undone as long as the cost drops, so the loop ends.
    """
    if not text or text.isascii() or not (_ODD.search(text) or _LOSS.search(text)):
        return text, False, True
    lines, lost = text.split("\n"), False  # no encoding here spans a line break, so sound lines cost nothing
    for i, t in enumerate(lines):
        if t.isascii() or not (_ODD.search(t) or _LOSS.search(t)):
            continue
        utf8 = stretches = False
        while (step := _layer(t, utf8))[0] != t:
            t, lost, utf8, stretches = step[0], lost or step[1], utf8 or step[2], stretches or step[3]
            if not _ODD.search(t):
                break
        lost = lost or bool(_LOSS.search(t)) or _damaged(t) or (stretches and _left_over(t))
        lines[i] = t
    t = "\n".join(lines)
    return t, t != text or lost, not lost


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.BooleanType())])


@F.pandas_udf(RESULT)
def repair_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(x if isinstance(x, str) else None) for x in texts], columns=["text", "garbled", "restored"])


def repaired(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """(key, text, restored) of the garbled documents only; every document is looked at, whole. ASCII-only texts never leave the JVM."""
    d = docs.where(F.col(col).rlike(SUSPECT)).select(key, repair_udf(F.col(col)).alias("r"))
    return d.where("r.garbled").select(key, F.col("r.text").alias("text"), F.col("r.restored").alias("restored"))
