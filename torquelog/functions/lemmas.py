"""Lemmas by edit rules that are learned from a table of forms and looked up by the longest suffix.

An edit cuts some letters off a form and adds others. Every suffix of a form votes for the form's
edit; a suffix keeps its rule where it differs from that of the next shorter suffix. Words of the
table thus come out as they stand there, other words by what the words like them do.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping

from torquelog.functions import lexicons

SUPPORT = 2  # votes that a suffix rule needs
LONGEST = 7  # letters of a suffix
VOWEL = "[aeiouy]"
CLASSES = str.maketrans("aeiouybcdfghjklmnpqrstvwxz", "V" * 6 + "C" * 20)
WHOLE = "^"  # stands before a word that is a rule of its own
# Words of these patterns double their last consonant before -ed and -ing, and so do a few others.
SHORT = re.compile(r"^[^aeiouy]*(?:qu)?[aeiouy][^aeiouywx]$")
DOUBLING = set(
    "unplug reset refit control cancel label travel occur refer permit transfer admit submit begin program".split()
)
FIXED_ED = set("sync arc focus".split())  # no doubling, no hardening


def _stem(base: str) -> str:
    double = base not in FIXED_ED and (base in DOUBLING or SHORT.match(base))
    return base + base[-1] if double else base


def plural(base: str) -> str:
    """The form in -s of a noun or a verb."""
    if re.search(r"[^aeiou]y$", base):
        return base[:-1] + "ies"
    if re.search(r"(is)$", base) and len(base) > 4:
        return base[:-2] + "es"
    return base + ("es" if re.search(r"(s|x|z|ch|sh|[^aeiou]o|^go)$", base) else "s")


def past(base: str) -> str:
    if base.endswith("e"):
        return base + "d"
    if re.search(r"[^aeiou]y$", base):
        return base[:-1] + "ied"
    return _stem(base) + "ed"


def gerund(base: str) -> str:
    if base.endswith("ie"):
        return base[:-2] + "ying"
    if re.search(r"[^eoy]e$", base) and len(base) > 2:
        return base[:-1] + "ing"
    return _stem(base) + "ing"


def forms(verbs: Iterable[str], nouns: Iterable[str], unchanged: Iterable[str]) -> dict[str, str]:
    """The table of forms and lemmas of some base words; what is listed goes before what is built."""
    table: dict[str, str] = {}
    for word in [*verbs, *nouns]:
        table[word] = word
    for word in verbs:
        for form in (plural(word), past(word), gerund(word)):
            table.setdefault(form, word)
    for word in nouns:
        table.setdefault(plural(word), word)
    return table | {word: word for word in unchanged}


def edit(form: str, lemma: str) -> tuple[int, str]:
    """How many letters come off the form and what is added."""
    same = 0
    while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
        same += 1
    return len(form) - same, lemma[same:]


def ending(word: str) -> str:
    return next((e for e in ("ing", "ed") if word.endswith(e)), "")


def shape(word: str) -> str | None:
    """The letter before -ed or -ing, a mark if it is doubled, and the classes of the letters before it.

    The class of a letter is vowel or consonant; ``^`` stands for the start of the word.
    """
    tail = ending(word)
    if not tail or len(word) < len(tail) + 3:
        return None
    stem = word[: len(word) - len(tail)]
    twice = "2" if stem[-1] == stem[-2] else ""
    before = (WHOLE + stem[:-1])[-3:].translate(CLASSES)
    return f"~{before}{twice}{stem[-1]}{tail}"


def keys(word: str) -> list[str]:
    """Where a word's edit is looked up, in order: long suffixes, its shape, short suffixes."""
    tail = len(ending(word))
    out = [word[len(word) - n :] for n in range(min(len(word), LONGEST), 0, -1)]
    if key := shape(word):
        out.insert(sum(len(s) >= tail + 3 for s in out), key)
    return out


def found(rules: Mapping[str, tuple[int, str]], places: list[str]) -> tuple[int, str]:
    return next((rules[k] for k in places if k in rules), (0, ""))


def learn(table: Mapping[str, str], irregular: Mapping[str, str] = {}) -> dict[str, tuple[int, str]]:
    """Rules (key -> edit) from a table of forms; most votes win, then the shorter cut.

    A key needs ``SUPPORT`` votes for its edit and stays where it says something else than the keys
    after it. Words that the rules get wrong, and all ``irregular`` ones, which do not vote, become
    rules of their own.
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    for form, word in table.items():
        for key in keys(form):
            votes[key][edit(form, word)] += 1
    best = {k: min(c, key=lambda e: (-c[e], e)) for k, c in votes.items()}
    best = {k: e for k, e in best.items() if votes[k][e] >= SUPPORT}
    rules = {k: e for k, e in best.items() if k.startswith("~")}
    for key in sorted((k for k in best if not k.startswith("~")), key=len):
        if best[key] != found(rules, keys(key)[1:]):
            rules[key] = best[key]
    whole = {**{f: w for f, w in table.items() if lemma(f, rules) != w}, **irregular}
    return rules | {WHOLE + f: edit(f, w) for f, w in whole.items()}


def lemma(word: str, rules: Mapping[str, tuple[int, str]]) -> str:
    """The lemma of one word, for tables and tests; texts are done by ``text.lemmatize``.

    Rules other than whole words are for words of four letters or more, and what -ed or -ing comes
    off must have a vowel.
    """
    if WHOLE + word in rules:
        cut, add = rules[WHOLE + word]
        return word[: len(word) - cut] + add
    if not (len(word) > 3 and word.isalpha()):
        return word
    cut, add = found(rules, keys(word))
    stem = word[: len(word) - cut]
    return stem + add if not ending(word) or re.search(VOWEL, stem) else word


def branches(rules: Mapping[str, tuple[int, str]], tail: str) -> list[tuple[str, int, tuple[int, str], list[str]]]:
    """The rules for words of an ending ("" for all others) in the order they are tried.

    Each is ("suffix" or "shape", its length, the edit, the keys that have it).
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    for key, change in rules.items():
        if key.startswith(WHOLE):
            continue
        if key.startswith("~"):
            if tail and key.endswith(tail):
                groups[len(tail) + 2.5, "shape", 0, change].append(key[1 : len(key) - len(tail)])
        elif key.endswith(tail) or (tail and tail.endswith(key)) if tail else not ending(key):
            groups[len(key), "suffix", len(key), change].append(key)
    ordered = sorted(groups.items(), key=lambda g: (-g[0][0], g[0][3]))
    return [(kind, n, change, sorted(names)) for (_, kind, n, change), names in ordered]


def default_table() -> dict[str, str]:
    """The regular forms of the built-in base words."""
    verbs = [*lexicons.VERBS, *lexicons.MORE_VERBS, *lexicons.YET_MORE_VERBS]
    nouns = [*lexicons.NOUNS, *lexicons.MORE_NOUNS]
    return forms(verbs, nouns, [*lexicons.UNCHANGED, *lexicons.OTHER_UNCHANGED])


RULES = learn(default_table(), lexicons.LEMMAS)
