"""Text cleaning as Column expressions. Everything here is row-local and runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from torquelog.functions import lemmas as lemma_rules
from torquelog.functions import lexicons

# The patterns below say what each cleaning step deletes or keeps.
# Unicode white space, spelled out because \s is ASCII-only in the regex engine.
SPACE = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"[\p{L}\p{N}_]{2,}"
PIECE = rf"[\p{{L}}\p{{N}}_]+|[{SPACE}]+|[^\p{{L}}\p{{N}}_{SPACE}]"
# What separates words in running text, in order: (pattern, replacement). Marks inside a word stay,
# as in 6/09/21, 10:30pm or follow-up; endings like 's and n't become words of their own.
WORD_BREAKS = (
    (r"\.{2,}", " "),
    (r'[;@#$%&?!*()\[\]{}<>"`«»“”‘’„]|--', " "),
    (r"[:,]+([^\d:,])", " $1"),
    (r"[:,]+$", " "),
    (rf"([^\d])\.([{SPACE}]|$)", "$1 $2"),
    (rf"(\d)\.([{SPACE}]+[^\p{{Ll}}{SPACE}]|[{SPACE}]*$)", "$1 $2"),  # "3." may be an ordinal
    (r"([Nn]'[Tt])([^\p{L}\p{N}_]|$)", " $1$2"),
    (r"('[SsMmDd]|'ll|'re|'ve)([^\p{L}\p{N}_]|$)", " $1$2"),
    (rf"'([{SPACE}]|$)", " $1"),
)
BRACKETS = r"\[[^\n]*?\]"
MENTION = rf"@[^{SPACE}]*"
TAG = rf"#[^{SPACE}]*"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
HTML = r"<[^\n]*?>"
DATES = (
    r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    r"\b\d{6,8}\b",
    r"\b\d{5}\b",
)
NUMBER_WORD = r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*"
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
PUNCTUATION = ASCII_PUNCTUATION.replace("'", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def literal(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable[str]) -> str:
    """A list of strings as the right side of ``IN``; at least one literal, so never empty."""
    return "(" + ", ".join(literal(v) for v in [*values] or [""]) + ")"


def each(function: str, tokens: Column, body: str) -> Column:
    """``filter`` or ``transform`` over an array with a SQL lambda on ``t``.

    Word lists of hundreds of entries go to the parser as one text; building them literal by literal
    costs more than the query itself on small inputs. ``IN`` of a long list is a hash lookup.
    """
    return F.call_function(function, tokens, F.expr(f"t -> {body}"))


def _delete(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def one_line(text: Column) -> Column:
    """Delete newlines and bracketed passages."""
    return _delete(F.translate(text, "\n", ""), BRACKETS)


def remove_mentions_and_tags(text: Column) -> Column:
    return _delete(_delete(text, MENTION), TAG)


def remove_urls(text: Column) -> Column:
    return _delete(text, URL)


def remove_html(text: Column) -> Column:
    return _delete(text, HTML)


def remove_dates(text: Column) -> Column:
    """Delete d/d/d dates, then runs of 6-8 digits, then runs of 5 digits."""
    for pattern in DATES:
        text = _delete(text, "(?U)" + pattern)
    return text


def remove_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation but keep apostrophes, so contractions still match."""
    return F.translate(text, PUNCTUATION, "")


def strict_lower(text: Column) -> Column:
    """Lower-case, without brackets, tags, URLs, punctuation, line breaks and words with digits."""
    text = F.regexp_replace(text, "\n", " ")
    for pattern in (BRACKETS, HTML, URL):
        text = _delete(text, pattern)
    return F.lower(_delete(F.translate(text, ASCII_PUNCTUATION, ""), NUMBER_WORD))


def split_space(text: Column, delete: str = "") -> Column:
    """Tokens between white space, without empty ones; characters in ``delete`` vanish first.

    One ``translate`` makes every white space a blank, which splits faster than a pattern does.
    """
    blanks = F.translate(text, SPACE_CHARS + delete, " " * len(SPACE_CHARS))
    return F.filter(F.split(blanks, " "), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-case word tokens of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def running_words(text: Column) -> Column:
    """Words as a sentence tokenizer leaves them, case kept, without lone punctuation."""
    for pattern, replacement in WORD_BREAKS:
        text = F.regexp_replace(text, pattern, replacement)
    return split_space(text)


def pieces(text: Column) -> Column:
    """Words, white space and single marks, in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def keep_listed(tokens: Column, listed: Iterable[str]) -> Column:
    """Tokens that are in ``listed``, in their order."""
    return each("filter", tokens, f"t IN {literals(listed)}")


def drop_words(tokens: Column, stop: Iterable[str]) -> Column:
    """Tokens whose lower-case form is not in ``stop``."""
    return each("filter", tokens, f"lower(t) NOT IN {literals(stop)}")


def _swap(table: Mapping[str, str], token: str) -> str:
    """SQL: the table's value for a token, else null. The map is read only on a hit."""
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return f"WHEN {token} IN {literals(table)} THEN element_at(map({entries}), {token})"


def replace_words(tokens: Column, table: Mapping[str, str]) -> Column:
    """Replace tokens found in a small dictionary. For a dictionary table see ``expand_words``."""
    entries = {k: v for k, v in table.items() if k}
    return each("transform", tokens, f"CASE {_swap(entries, 't')} ELSE t END") if entries else tokens


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def expand_acronyms(text: Column, table: Mapping[str, str] = lexicons.ACRONYMS) -> Column:
    return _join(replace_words(split_space(text), table))


def expand_contractions(text: Column, table: Mapping[str, str] = lexicons.CONTRACTIONS) -> Column:
    return _join(replace_words(split_space(text), table))


def remove_stopwords(text: Column, stop: Iterable[str] = lexicons.STOP_ENGLISH) -> Column:
    return _join(drop_words(split_space(text), stop))


def _edited(token: str, change: tuple[int, str]) -> str:
    cut, add = change
    stem = f"left({token}, length({token}) - {cut})" if cut else token
    return f"concat({stem}, {literal(add)})" if add else stem


def _by_rules(token: str, rules: Mapping, tail: str) -> str:
    """SQL: the first rule of ``lemmas.branches`` that fits; the token where what is left has no vowel."""
    stem = f"left({token}, length({token}) - {len(tail) + 1})"
    last = f"substring({token}, length({token}) - {len(tail)}, 1)"
    plain, classes = "aeiouybcdfghjklmnpqrstvwxz", "V" * 6 + "C" * 20
    shape = (
        f"concat(translate(right(concat('^', {stem}), 3), '{plain}', '{classes}'), "
        f"IF(right({stem}, 1) = {last}, '2', ''), {last})"
    )
    cases = []
    for kind, n, change, keys in lemma_rules.branches(rules, tail):
        if kind == "shape":
            test = f"length({token}) >= {len(tail) + 3} AND {shape} IN {literals(keys)}"
        else:
            test = f"right({token}, {n}) IN {literals(keys)}" if n else "true"
        out = _edited(token, change)
        if tail and change[0]:
            out = f"IF(left({token}, length({token}) - {change[0]}) RLIKE '{lemma_rules.VOWEL}', {out}, {token})"
        cases.append(f"WHEN {test} THEN {out}")
    return f"CASE {' '.join(cases)} ELSE {token} END" if cases else token


def _lemma(token: str, rules: Mapping[str, tuple[int, str]] = lemma_rules.RULES) -> str:
    words = {k[1:]: k[1 : len(k) - cut] + add for k, (cut, add) in rules.items() if k.startswith(lemma_rules.WHOLE)}
    others = {k[-1] for k in rules if k and not k.startswith(lemma_rules.WHOLE) and not lemma_rules.ending(k)}
    letters = f"length({token}) > 3 AND {token} RLIKE '^\\\\p{{L}}+$'"
    cases = [_swap(words, token)] if words else []
    # the cheap test of the last letter spares most tokens the rules
    cases.append(f"WHEN right({token}, 1) NOT IN {literals(sorted(others | {'g', 'd'}))} OR NOT ({letters}) THEN {token}")
    cases += [f"WHEN endswith({token}, '{tail}') THEN {_by_rules(token, rules, tail)}" for tail in ("ing", "ed")]
    return f"CASE {' '.join(cases)} ELSE {_by_rules(token, rules, '')} END"


def lemmas(tokens: Column, rules: Mapping[str, tuple[int, str]] = lemma_rules.RULES) -> Column:
    """The lemma of each lower-case token by learned rules; see ``lemmas.learn`` for rules of one's own."""
    return each("transform", tokens, _lemma("t", rules))


def lemmatize(text: Column, rules: Mapping[str, tuple[int, str]] = lemma_rules.RULES) -> Column:
    return _join(lemmas(split_space(text), rules))


def clean_asset(text: Column, lemmas: bool = True) -> Column:
    """Cleaner for asset records: work descriptions and completion notes."""
    text = remove_html(remove_urls(remove_mentions_and_tags(one_line(strip(text)))))
    tokens = split_space(text, delete=PUNCTUATION)
    return _finish(tokens, [*lexicons.STOP_ENGLISH, *lexicons.STOP_ASSET_EXTRA], lemmas)


def clean_incident(text: Column, lemmas: bool = True) -> Column:
    """Cleaner for incident summaries: dates are deleted, mentions and URLs stay."""
    tokens = split_space(remove_html(remove_dates(strip(text))), delete=PUNCTUATION)
    return _finish(tokens, lexicons.STOP_ENGLISH, lemmas)


def _one_pass(first: Mapping[str, str], second: Mapping[str, str]) -> dict[str, str]:
    """Dictionary equal to replacing by ``first``, splitting again, then replacing by ``second``."""
    chained = {
        word: " ".join(second.get(part, part) for part in full.split())
        for word, full in first.items()
    }
    return {**second, **chained}


def _finish(tokens: Column, stop: Iterable[str], lemmas: bool) -> Column:
    """Acronyms, contractions, stop words and lemmas in one walk over the tokens."""
    stop = list(stop)
    unwanted = {word.lower() for word in stop}
    table = {
        word: " ".join(part for part in full.split() if part.lower() not in unwanted)
        for word, full in _one_pass(lexicons.ACRONYMS, lexicons.CONTRACTIONS).items()
    }
    swapped = replace_words(tokens, table)
    kept = each("filter", swapped, f"t <> '' AND lower(t) NOT IN {literals(stop)}")
    if not lemmas:
        return _join(kept)
    # an expansion of several words is one element so far; its words are lemmatised one by one
    single, inner = _lemma("t"), _lemma("w")
    several = f"array_join(transform(split(t, ' '), w -> {inner}), ' ')"
    return _join(each("transform", kept, f"IF(contains(t, ' '), {several}, {single})"))


def valid_serial(value: Column) -> Column:
    """The value when it is exactly 13 digits, else null."""
    return F.when(value.rlike(r"^\d{13}\z"), value)


def long_digits(value: Column) -> Column:
    """True for 13 or more digits and nothing else."""
    return value.rlike(r"^\d{13,}\z")


def bare_code(code: Column) -> Column:
    """Error code without its leading ``e`` when the rest is alphanumeric, else null."""
    code = F.lower(code)
    return F.when(code.rlike(r"^e[\p{L}\p{N}]+\z"), F.substring(code, 2, 64))


def attach_code_prefix(tokens: Column, bare_codes: Iterable[str]) -> Column:
    """Put the ``E`` back in front of tokens that are bare error numbers."""
    return each("transform", tokens, f"IF(t IN {literals(bare_codes)}, concat('E', t), t)")


def blank(text: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return text.isNull() | (strip(text) == "")


def language(text: Column, profiles: Mapping[str, list[str]] = lexicons.LANGUAGE_PROFILES) -> Column:
    """Language whose function words cover most tokens; null when none occurs.

    Ties go to the alphabetically first language.
    """

    def score(tokens: Column, name: str) -> Column:
        hits = F.size(keep_listed(tokens, profiles[name]))
        return F.struct((-hits).alias("misses"), F.lit(name).alias("lang"))

    def best(tokens: Column) -> Column:
        return F.array_min(F.array(*[score(tokens, name) for name in sorted(profiles)]))

    winner = let(words(text), best)
    return let(winner, lambda b: F.when(b["misses"] < 0, b["lang"]))
