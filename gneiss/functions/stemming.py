"""English lexemes: stop words, and the stemmer of Porter's second algorithm (Snowball "english").

Written from the algorithm's published description. Words of other scripts pass as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of the Snowball project's English list.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
    had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
    don should now""".split()
)
# Words with stems of their own, words that stay, and words that stay after plurals.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIXED = frozenset("sky news howe atlas cosmos bias andes".split())
FIXED_SINGULARS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes and what takes their place, where they stand in the first or second region.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

VOWEL = "[aeiouy]"
REGION = re.compile(f"^.*?{VOWEL}[^aeiouy]")
SHORT_END = re.compile(f"(?:[^aeiouy]{VOWEL}[^aeiouywxY]|^{VOWEL}[^aeiouy])$")
HEAD = re.compile("^(?:gener|commun|arsen)")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(tuple(suffixes)) else ""


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    m = HEAD.match(word) or REGION.match(word)
    first = m.end() if m else len(word)
    m = REGION.match(word[first:])
    return first, first + m.end() if m else len(word)


def _is_short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(SHORT_END.search(word))


def _past(word: str, r1: int) -> str:
    """Without the endings of past and progressive forms (step 1b)."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    if not end or not re.search(VOWEL, word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
        return word[:-1]
    return word + "e" if _is_short(word, r1) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) <= 2 or word in FIXED or not re.fullmatch("[a-z']+", word):
        return word
    word = word.removeprefix("'")
    # A y at the start, or after a vowel, is a consonant.
    word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(f"{VOWEL}.+s$", word):
        word = word[:-1]
    if word in FIXED_SINGULARS:
        return word
    word = _past(word, r1)
    if len(word) > 2 and re.search("[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word.endswith("logi")) and (end != "li" or re.search("[cdeghkmnrt]li$", word)):
        word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or re.search("[st]ion$", word)):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.lower()


def lexemes(words: list[str]) -> list[str]:
    """Stems of the words that aren't stop words."""
    return [stem(w) for w in words if w not in STOP_WORDS]


def head(lexeme: str) -> str:
    """What all words of a lexeme start with: suffix rules leave the first letters alone, and turn
    at most the last one of a short stem."""
    return lexeme[: max(1, min(3, len(lexeme) - 1))]
