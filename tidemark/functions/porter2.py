"""The Porter2 (Snowball English) stemmer, from its published definition."""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V, _NV = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"^.*?{_V}{_NV}")
_SHORT = re.compile(f"(?:^{_V}{_NV}|{_NV}{_V}[^aeiouywxY])$")
_VOWEL = re.compile(_V)


def _after(word: str, start: int) -> int:
    m = _REGION.match(word[start:])
    return start + m.end() if m else len(word)


def _regions(word: str) -> tuple[int, int]:
    for prefix in ("commun", "gener", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _after(word, 0)
    return r1, _after(word, r1)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(word)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word.replace("Y", "y")
    # 1b: past and progressive forms
    for ending in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(ending):
            if ending.startswith("eed"):
                if len(word) - len(ending) >= r1:
                    word = word[: -len(ending)] + "ee"
            elif _VOWEL.search(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _SHORT.search(word):
                    word += "e"
            break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2
    for ending in sorted((*_STEP2, "ogi", "li"), key=len, reverse=True):
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                head = word[: -len(ending)]
                if ending == "ogi":
                    word = head + "og" if head.endswith("l") else word
                elif ending == "li":
                    word = head if head and head[-1] in "cdeghkmnrt" else word
                else:
                    word = head + _STEP2[ending]
            break
    # 3
    for ending in sorted((*_STEP3, "ative"), key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if ending == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + _STEP3[ending]
            break
    # 4
    for ending in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[at - 1] in "st"):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
