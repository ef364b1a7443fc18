"""SQL text for the checks: the cleaning steps as DuckDB expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from torquelog.functions import lemmas as lemma_rules
from torquelog.functions import lexicons, tagging, text


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def mapped(table: Mapping[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


SPACES = " || ".join(f"chr({ord(c)})" for c in text.SPACE_CHARS)


def delete(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, '', 'g')"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def one_line(expr: str) -> str:
    return delete(f"replace({expr}, chr(10), '')", r"\[[^\n]*?\]")


def mentions(expr: str) -> str:
    return delete(delete(expr, text.MENTION), text.TAG)


def urls(expr: str) -> str:
    return delete(expr, text.URL)


def html(expr: str) -> str:
    return delete(expr, text.HTML)


def dates(expr: str) -> str:
    for pattern in text.DATES:
        expr = delete(expr, pattern)
    return expr


def punctuation(expr: str) -> str:
    return f"translate({expr}, {quoted(text.PUNCTUATION)}, '')"


def tokens(expr: str) -> str:
    """White-space tokens."""
    blanks = " " * len(text.SPACE_CHARS)
    return (
        f"list_filter(string_split(translate({expr}, {SPACES}, '{blanks}'), ' '), "
        "lambda t: t <> '')"
    )


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {quoted(text.WORD)})"


def running_words(expr: str) -> str:
    for pattern, replacement in text.WORD_BREAKS:
        back = replacement.replace("$", "\\")
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(back)}, 'g')"
    return tokens(expr)


def drop(expr: str, stop: Iterable[str]) -> str:
    return f"list_filter({expr}, lambda t: lower(t) NOT IN {listed(stop)})"


def swap(expr: str, table: Mapping[str, str]) -> str:
    return (
        f"list_transform({expr}, lambda t: CASE WHEN t IN {listed(table)} "
        f"THEN {mapped(table)}[t] ELSE t END)"
    )


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def _rule_cases(token: str, tail: str) -> str:
    """The rules of an ending as one CASE; the classes of letters are found by patterns here."""
    before = f"right('^' || left({token}, -{len(tail) + 1}), 3)"
    classes = f"regexp_replace(regexp_replace({before}, '[aeiouy]', 'V', 'g'), '[b-df-hj-np-tv-xz]', 'C', 'g')"
    last = f"left(right({token}, {len(tail) + 1}), 1)"
    twice = f"CASE WHEN right({before}, 1) = {last} THEN '2' ELSE '' END"
    cases = []
    for kind, n, (cut, add), keys in lemma_rules.branches(lemma_rules.RULES, tail):
        if kind == "shape":
            test = f"length({token}) >= {len(tail) + 3} AND {classes} || {twice} || {last} IN {listed(keys)}"
        else:
            test = f"right({token}, {n}) IN {listed(keys)}" if n else "true"
        stem = f"left({token}, -{cut})" if cut else token
        if tail and cut:
            test_vowel = f"regexp_matches({stem}, '[aeiouy]')"
            cases.append(f"WHEN {test} AND {test_vowel} THEN {stem} || {quoted(add)} WHEN {test} THEN {token}")
        else:
            cases.append(f"WHEN {test} THEN {stem} || {quoted(add)}")
    return "CASE " + " ".join(cases) + f" ELSE {token} END" if cases else token


def lemma(token: str) -> str:
    whole = {k[1:]: k[1 : len(k) - cut] + add for k, (cut, add) in lemma_rules.RULES.items() if k[:1] == "^"}
    return (
        f"CASE WHEN {token} IN {listed(whole)} THEN {mapped(whole)}[{token}] "
        f"WHEN NOT regexp_matches({token}, '^\\p{{L}}{{4,}}$') THEN {token} "
        f"WHEN right({token}, 3) = 'ing' THEN {_rule_cases(token, 'ing')} "
        f"WHEN right({token}, 2) = 'ed' THEN {_rule_cases(token, 'ed')} ELSE {_rule_cases(token, '')} END"
    )


def lemmas(expr: str) -> str:
    return f"list_transform({expr}, lambda t: {lemma('t')})"


def _expanded(expr: str, stop: Iterable[str]) -> str:
    once = joined(swap(tokens(expr), lexicons.ACRONYMS))
    twice = joined(swap(tokens(once), lexicons.CONTRACTIONS))
    return joined(lemmas(drop(tokens(twice), stop)))


def clean_asset(expr: str) -> str:
    plain = punctuation(html(urls(mentions(one_line(strip(expr))))))
    return _expanded(plain, [*lexicons.STOP_ENGLISH, *lexicons.STOP_ASSET_EXTRA])


def clean_incident(expr: str) -> str:
    return _expanded(punctuation(html(dates(strip(expr)))), lexicons.STOP_ENGLISH)


def keyword_tokens(expr: str) -> str:
    return f"list_filter({words(expr)}, lambda t: t NOT IN {listed(lexicons.STOP_KEYWORDS)})"


def grams(column: str, n: int) -> str:
    """n-grams of a list column."""
    if n == 1:
        return column
    return (
        f"list_transform(range(1, len({column}) - {n} + 2), "
        f"lambda i: array_to_string({column}[i:i + {n - 1}], ' '))"
    )


def gram_rows(relation: str, keep: str, column: str, sizes: tuple[int, ...] = (1, 2, 3)) -> str:
    """One row (keep, n, gram) per n-gram occurrence."""
    return " UNION ALL ".join(
        f"SELECT {keep}, {n} AS n, unnest({grams(column, n)}) AS gram FROM {relation}" for n in sizes
    )


def spanning_gram_rows(relation: str, group: str, key: str, column: str) -> str:
    """One row (group, n, gram) per n-gram of the group's rows read as one text in key order."""
    return f"""
      SELECT {group}, unnest([1, 2, 3]) AS n, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3])
        AS gram
      FROM (SELECT {group}, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
            FROM (SELECT {group}, {key}, unnest({column}) AS word,
                    generate_subscripts({column}, 1) AS pos FROM {relation})
            WINDOW o AS (PARTITION BY {group} ORDER BY {key}, pos))"""


def language(expr: str) -> str:
    counts = {
        name: f"len(list_filter({words(expr)}, lambda t: t IN {listed(profile)}))"
        for name, profile in lexicons.LANGUAGE_PROFILES.items()
    }
    names = sorted(counts)
    top = "greatest(" + ", ".join(counts[n] for n in names) + ")"
    cases = " ".join(f"WHEN {counts[n]} = {top} THEN '{n}'" for n in names)
    return f"CASE WHEN {top} = 0 THEN NULL {cases} END"


def tagging_ctes(relation: str, key: str, column: str) -> str:
    """CTEs that end in ``tagged`` (key, sentence, nr, word, tag): the best path by recursion over the words.

    ``key`` may be several columns. The query has to begin WITH RECURSIVE.
    """
    kinds = " ".join(
        f"WHEN word IN {listed(words_)} THEN {quoted(kind)}" for kind, words_ in tagging.word_kinds().items()
    )
    ends = " ".join(
        f"WHEN regexp_matches(word, {quoted(pattern)}) THEN {quoted(kind)}" for kind, pattern in tagging.ENDINGS.items()
    )
    emissions = ", ".join(
        f"('{kind}', '{tag}', {tagging.score(p)})" for kind, row in tagging.KINDS.items() for tag, p in row.items()
    )
    follows = ", ".join(
        f"('{a}', '{b}', {tagging.score(p)})" for a, row in tagging.FOLLOWS.items() for b, p in row.items()
    )
    on = f"{key}, sentence, piece"
    long = tagging.LONGEST
    return f"""
      sentences AS (SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS sentence
        FROM (SELECT {key}, string_split_regex(lower({column}), {quoted(tagging.SENTENCE_END)}) AS parts FROM {relation})),
      tag_words AS (SELECT {key}, sentence, unnest(found) AS word, generate_subscripts(found, 1) AS nr
        FROM (SELECT *, regexp_extract_all(part, {quoted(tagging.WORD)}) AS found FROM sentences)),
      kinded AS (SELECT *, (nr - 1) // {long} AS piece, (nr - 1) % {long} AS step,
          CASE {kinds} {ends} ELSE 'other' END AS kind FROM tag_words),
      emissions(kind, tag, emit) AS (VALUES {emissions}),
      follows(source, target, go) AS (VALUES {follows}),
      paths AS (
        SELECT {on}, 0::BIGINT AS step, tag, tag AS path, (go + emit)::BIGINT AS score
        FROM kinded JOIN emissions USING (kind) JOIN follows ON source = '{tagging.START}' AND target = tag WHERE step = 0
        UNION ALL
        SELECT {on}, step, tag, best.path || tag, best.score + emit FROM (
          SELECT {", ".join(f"k.{c.strip()}" for c in on.split(","))}, k.step, e.tag, any_value(e.emit) AS emit,
                 max(struct_pack(score := p.score + f.go, tag := strpos('{tagging.TAGS}', p.tag), path := p.path)) AS best
          FROM paths p JOIN kinded k ON {" AND ".join(f"k.{c.strip()} = p.{c.strip()}" for c in on.split(","))} AND k.step = p.step + 1
          JOIN emissions e ON e.kind = k.kind JOIN follows f ON f.source = p.tag AND f.target = e.tag
          GROUP BY ALL)),
      ends AS (SELECT {on}, max(step) AS step FROM paths GROUP BY ALL),
      best_paths AS (SELECT {on}, max(struct_pack(score := score, tag := strpos('{tagging.TAGS}', tag), path := path)).path AS path
        FROM paths JOIN ends USING ({on}, step) GROUP BY {on}),
      tagged AS (SELECT {key}, sentence, nr, word, substr(path, step + 1, 1) AS tag
        FROM kinded JOIN best_paths USING ({on}))"""
