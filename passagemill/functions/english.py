"""English normalisation of tokens: stop words and the Porter2 stemmer, from its published description.

It runs over distinct tokens only; see operators.fulltext.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The usual English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: The stemmer's exceptions and endings.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
DOUBLES, LI_ENDINGS = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"


def _region(w: str, start: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word[1:] if word.startswith("'") else word
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # -eed, -ed, -ing and their -ly forms
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if re.search(r".[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for end in sorted(STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + STEP2[end]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI_ENDINGS:
            w = w[:-2]
    for end in sorted(STEP3, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + STEP3[end]
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(token: str) -> str | None:
    """The lexeme of a lower-case token; None for a stop word. Words and compounds of letters have a stem, other classes stand for themselves."""
    if not token.replace("-", "").isalpha():
        return token
    return None if token in STOP_WORDS else stem(token)


@lru_cache(1 << 18)
def known_lexeme(token: str) -> str | None:
    """lexeme, with the answers for many tokens kept."""
    return lexeme(token)
