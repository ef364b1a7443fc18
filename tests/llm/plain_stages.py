"""Plain versions of the pipeline's stages, from those of the operators' own tests."""

from test_decontaminate import brute as search
from test_line_dedup import brute_words as lines
from test_ngram_join import brute as groups
from test_packing import expected_pieces


def winnowed(texts):
    kept = lines(list(texts.items()), 3, 50)
    return {k: kept[k, t] for k, t in texts.items()}


def first_of_groups(texts):
    return [k for k, (_, low) in groups(list(texts.items()), 5, 80).items() if k == low]


def decontaminated(texts, items):
    found = search(list(texts.items()), [(str(i), t) for i, t in enumerate(items)])
    gone = {r[0] for r in found if r[-1]}
    return {k: t for k, t in texts.items() if k not in gone}


def packed(texts):
    return sorted((k, *p) for k, t in texts.items() for p in expected_pieces(t, 2048))
