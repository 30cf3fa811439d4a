"""English stems (the published Porter2 algorithm) and stop words, for distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The usual English stop words of text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now"
).split()
# Words with stems of their own, and words left as they are after the first step.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# Suffixes of the second, third and fourth step.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _ending(suffixes) -> re.Pattern:
    return re.compile(f"(?:{'|'.join(suffixes)})$")  # the leftmost match is the longest suffix


_FIRST, _REGION, _SHORT, _DOUBLE = re.compile("^(?:gener|commun|arsen)"), re.compile(REGION), re.compile(SHORT), re.compile(DOUBLE)
_STEP_1B, _STEP_2, _STEP_3, _STEP_4 = _ending(["eedly", "ingly", "edly", "eed", "ing", "ed"]), _ending(STEP_2), _ending(STEP_3), _ending(STEP_4)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR or word in UNCHANGED or len(word) <= 2:
        return IRREGULAR.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    first = _FIRST.match(w) or _REGION.match(w)
    r1 = first.end() if first else len(w)
    second = _REGION.match(w[r1:])
    r2 = r1 + second.end() if second else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in KEPT:
        return w
    if m := _STEP_1B.search(w):
        front = w[: m.start()]
        if m[0].startswith("eed"):
            w = front + "ee" if len(front) >= r1 else w
        elif re.search("[aeiouy]", front):
            if front.endswith(("at", "bl", "iz")) or (not _DOUBLE.search(front) and r1 >= len(front) and _SHORT.search(front)):
                w = front + "e"
            else:
                w = front[:-1] if _DOUBLE.search(front) else front
    if re.search(".[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    if (m := _STEP_2.search(w)) and m.start() >= r1:
        front = w[: m.start()]
        allowed = front.endswith("l") if m[0] == "ogi" else front[-1:] in tuple("cdeghkmnrt") if m[0] == "li" else True
        w = front + STEP_2[m[0]] if allowed else w
    if (m := _STEP_3.search(w)) and m.start() >= (r2 if m[0] == "ative" else r1):
        w = w[: m.start()] + STEP_3[m[0]]
    if (m := _STEP_4.search(w)) and m.start() >= r2 and (m[0] != "ion" or w[: m.start()].endswith(("s", "t"))):
        w = w[: m.start()]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(w[:-1]))) or (w.endswith("ll") and at >= r2):
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems of a column of distinct words."""
    return words.map(stem)
