import hashlib
import itertools
import math
import random
import re
import string

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from torquelog.functions import lemmas, lexicons, ngrams, tagging, text
from torquelog.operators import vocabulary
from torquelog.plans import reports


def run(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


TRICKY = [
    "  two  words\t",
    "a b c",
    "line\none [bracket\nover] end",
    "see @joe and #tag1 at https://x.org/a?b=1 or www.y.com/z now",
    "<b>bold</b> <br\n/> 1 < 2 > 0",
    "10/10/23 10-10-2023 1.2.34 10102023 10423 1234 123456789",
    "don't stop: it's (fine)!",
    "",
]


@pytest.mark.parametrize(
    ("make", "plain"),
    [
        (text.strip, str.strip),
        (text.one_line, lambda s: re.sub(r"\[.*?\]", "", s.replace("\n", ""))),
        (text.remove_mentions_and_tags, lambda s: re.sub(r"#\S*", "", re.sub(r"@\S*", "", s))),
        (text.remove_urls, lambda s: re.sub(r"https?://\S+|www\.\S+", "", s)),
        (text.remove_html, lambda s: re.sub(r"<.*?>", "", s)),
        (
            text.remove_punctuation,
            lambda s: s.translate(str.maketrans("", "", string.punctuation.replace("'", ""))),
        ),
        (lambda c: F.array_join(text.split_space(c), " "), lambda s: " ".join(s.split())),
        (lambda c: F.array_join(text.pieces(c), ""), lambda s: s),
        (
            lambda c: F.array_join(text.words(c), " "),
            lambda s: " ".join(re.findall(r"\b\w\w+\b", s.lower())),
        ),
    ],
)
def test_scalars_match_plain_python(spark, make, plain):
    assert run(spark, make, *TRICKY) == [plain(v) for v in TRICKY]


def test_dates_go_in_order(spark):
    got = run(spark, text.remove_dates, "on 10/10/23 or 10102023, 10423; keep 1234 and 123456789", "12345é")
    assert got == ["on  or , ; keep 1234 and 123456789", "12345é"]


def test_strict_lower(spark):
    got = run(spark, text.strict_lower, "E89 on\nOven [x] <b>Http</b> www.a.b Done.")
    assert got == [" on oven  http  done"]


def test_short_forms(spark):
    assert run(spark, text.expand_acronyms, "fix asap ASAP") == ["fix as soon as possible ASAP"]
    assert run(spark, text.expand_contractions, "it won't  start") == ["it will not start"]
    assert run(spark, text.expand_contractions, "they're sure it isn't") == ["they are sure it is not"]
    own = {"y'all": "you all"}
    assert run(spark, lambda c: text.expand_contractions(c, own), "y'all can't") == ["you all can't"]
    assert len(lexicons.STOP_KEYWORDS) == 318


def test_lemmas(spark):
    got = run(spark, text.lemmatize, "was boxes parts batteries carried heating replaced glass bus")
    assert got == ["be box part battery carry heat replace glass bus"]


#: Written by hand: forms and their lemmas.
FORMS = """
replaced:replace replacing:replace closed:close closing:close running:run stopped:stop stopping:stop
changed:change wired:wire wiring:wiring evening:evening ceiling:ceiling shipped:ship tripped:trip
updated:update heated:heat heating:heat rotating:rotate calibrated:calibrate created:create
removed:remove resolved:resolve opened:open opening:opening ordered:order installed:install
pressed:press pressing:press checked:check cleaned:clean tested:test verified:verify used:use using:use
fixed:fix fixing:fix configured:configure measured:measure required:require handled:handle
enabled:enable cycled:cycle settled:settle provided:provide avoided:avoid determined:determine
drained:drain joined:join compared:compare prepared:prepare repaired:repair restored:restore
monitored:monitor ignored:ignore included:include continued:continue charged:charge hanging:hang
damaged:damage leaking:leak burned:burn baked:bake smoked:smoke fired:fire sparked:spark arcing:arc
needed:need speed:speed red:red bed:bed king:king string:string thing:thing during:during
nothing:nothing was:be were:be broken:break found:find boxes:box parts:part batteries:battery
glass:glass bus:bus switches:switch fuses:fuse carried:carry tried:try died:die series:series
added:add controlled:control reset:reset resetting:reset unplugged:unplug visited:visit edited:edit
completed:complete noticed:notice produced:produce caused:cause reversed:reverse rewired:rewire
""".split()


def test_lemmas_written_by_hand(spark):
    pairs = [f.split(":") for f in FORMS]
    got = run(spark, text.lemmatize, " ".join(form for form, _ in pairs))[0].split()
    assert dict(zip((f for f, _ in pairs), got)) == dict(pairs)


def test_cleaners(spark):
    note = "  The unit [tag] isn't heating, see www.a.com @joe; replaced cap on 10/10/23 "
    assert run(spark, text.clean_asset, note) == ["unit heat see replace capacitor 101023"]
    assert run(spark, text.clean_incident, "Unit 12345 asap <b>why</b>, isn't on 1/2/23") == [
        "Unit soon possible"
    ]
    once = run(spark, lambda c: text.clean_asset(c, lemmas=False), note)
    assert run(spark, lambda c: text.clean_asset(c, lemmas=False), *once) == once


def test_chained_dictionaries_equal_two_passes(spark):
    values = [" ".join(lexicons.ACRONYMS), " ".join(lexicons.CONTRACTIONS), "idk idc imo ngl"]
    one_pass = run(spark, lambda c: text.clean_incident(c, lemmas=False), *values)

    def plain(value):
        value = value.translate(str.maketrans("", "", text.PUNCTUATION))
        for table in (lexicons.ACRONYMS, lexicons.CONTRACTIONS):
            value = " ".join(table.get(w, w) for w in value.split())
        return " ".join(w for w in value.split() if w.lower() not in lexicons.STOP_ENGLISH)

    assert one_pass == [plain(v) for v in values]


def test_serials_and_codes(spark):
    assert run(spark, text.valid_serial, "1234567890123", "123456789012", "1234567890123\n", "nan") == [
        "1234567890123", None, None, None,
    ]
    assert run(spark, text.long_digits, "1234567890123456", "12345", "12345678901234x") == [True, False, False]
    assert run(spark, text.bare_code, "E89", "w12", "e", "E8-9") == ["89", None, None, None]


def test_language(spark):
    got = run(spark, text.language, "the door of the oven is open", "la porte du four est", "der Ofen ist", "xyz", "")
    assert got == ["en", "fr", "de", None, None]


#: Written by hand: a note, its verbs and its nouns.
TAGGED = [
    (
        "Replaced the wiring and the bearing, checked housing and the plate at low speed, hundred hours, the fuse broke",
        "replaced checked broke", "wiring bearing housing plate speed hours fuse",
    ),
    ("replace the door, resetting ventilation", "replace resetting", "door ventilation"),
    (
        "Customer called to report that the oven is not heating. Tested the heating element; it was burnt",
        "called report heating tested burnt", "customer oven heating element",
    ),
    ("Unit does not heat. Need to check the seal and order a new switch", "heat need check order", "unit seal switch"),
    ("plug the check valve and test the control board", "plug test", "check valve control board"),
    ("The damaged board was replaced.\nCleaned the filters", "replaced cleaned", "board filters"),
    ("wiring", "", "wiring"),
    ("", "", ""),
]


def test_parts_of_speech(spark):
    got = run(spark, tagging.part_of_speech, *[note for note, _, _ in TAGGED])
    for r, (_, actions, observations) in zip(got, TAGGED):
        assert r["actions"] == actions.split() and r["observations"] == observations.split()
    assert run(spark, tagging.tagged, None) == [None]


def test_long_sentences_are_tagged_in_pieces(spark):
    words = run(spark, tagging.tagged, "replaced the wiring " * 100)[0]
    assert [w["word"] for w in words] == ["replaced", "the", "wiring"] * 100
    assert [w["tag"] for w in words[:99]] == ["V", "D", "N"] * 33


def plain_tags(words):
    """The best path over all paths."""
    kinds = {w: k for k, ws in tagging.word_kinds().items() for w in ws}
    ends = [(k, re.compile(p.replace(r"\p{L}", "[^\\W\\d_]"))) for k, p in tagging.ENDINGS.items()]

    def kind(word):
        return kinds.get(word) or next((k for k, p in ends if p.search(word)), "other")

    best = -math.inf
    for path in itertools.product(tagging.TAGS, repeat=len(words)):
        total, last = 0, tagging.START
        for word, tag in zip(words, path):
            row = tagging.KINDS[kind(word)]
            total += tagging.score(tagging.FOLLOWS[last][tag]) + (tagging.score(row[tag]) if tag in row else -99999)
            last = tag
        best = max(best, total)
        if total == best:
            out = path
    return best, out


@pytest.mark.parametrize("note", ["check valve test order", "the heating switch fails", "plug loosely wired 24v cable"])
def test_tags_are_the_best_path(spark, note):
    got = "".join(w["tag"] for w in run(spark, tagging.tagged, note)[0])
    assert tuple(got) == plain_tags(note.split())[1]


def test_lemmas_equal_the_rules_word_by_word(spark):
    words = [*lemmas.default_table(), *"wasted tasted lens buses lost burnt sling x12ed flibbed grokking é Wasted".split()]
    got = run(spark, text.lemmatize, " ".join(words))[0].split()
    assert got == [lemmas.lemma(w, lemmas.RULES) for w in words]
    hand = {"wasted": "waste", "tasted": "taste", "lens": "lens", "buses": "bus", "lost": "lose", "burnt": "burn"}
    assert all(lemmas.lemma(f, lemmas.RULES) == w for f, w in hand.items())


def test_listed_forms_have_their_lemma():
    table = lemmas.default_table() | lexicons.LEMMAS
    assert all(lemmas.lemma(form, lemmas.RULES) == word for form, word in table.items())


def test_lemmas_of_words_not_learned():
    """Five-fold: the forms of a fifth of the base words by rules learned from the others."""
    table, right, total = lemmas.default_table(), 0, 0

    def fold(word):
        return int(hashlib.md5(word.encode()).hexdigest(), 16) % 5

    for part in range(5):
        rules = lemmas.learn({f: w for f, w in table.items() if fold(w) != part}, lexicons.LEMMAS)
        held = [(f, w) for f, w in table.items() if fold(w) == part and f != w and f not in lexicons.LEMMAS]
        right += sum(lemmas.lemma(f, rules) == w for f, w in held)
        total += len(held)
    assert total > 1400 and right / total > 0.88


def test_rules_of_one_s_own(spark):
    rules = lemmas.learn({"katten": "kat", "ratten": "rat", "matten": "mat"}, {"koeien": "koe"})
    assert run(spark, lambda c: text.lemmatize(c, rules), "latten koeien deur") == ["lat koe deur"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(spark, n):
    values = ["aa bb cc dd", "aa", "", "aa bb"]
    got = run(spark, lambda c: ngrams.ngrams(text.split_space(c), n), *values)
    assert got == [
        [" ".join(v.split()[i : i + n]) for i in range(len(v.split()) - n + 1)] for v in values
    ]


@pytest.mark.parametrize("scan", [0, 200])
def test_phrases_hold_stop_words(spark, scan):
    got = run(
        spark,
        lambda c: ngrams.matched_phrases(text.words(c), ["by phone", "phone", "phone call"], scan),
        "Resolved by phone.", "phones by call", "a phone call",
    )
    assert got == [["by phone", "phone"], [], ["phone", "phone call"]]


def test_parts_of_speech_of_a_batch_equal_those_of_a_text(spark, monkeypatch):
    rng = random.Random(5)
    pool = [w for words in tagging.word_kinds().values() for w in rng.sample(words, min(len(words), 8))]
    pool += "7 12 x9 xying xyed xyly quxtion xyate xyous qqs zz Éa don't re-set déjà".split()
    notes = [" ".join(rng.choice(pool) + rng.choice(["", "", "", ". ", "!", "\n"]) for _ in range(n)) for n in [*range(1, 40), 230]]
    notes += ["", None, " . ! ", None, *[note for note, _, _ in TAGGED]]
    df = spark.createDataFrame([(i % 7 if i % 5 else None, v) for i, v in enumerate(notes)], "i int, x string").repartition(2)
    got = tagging.with_parts_of_speech(df, "x").select("i", "x", "actions", "observations")
    assert got.columns[:2] == df.columns
    want = df.select("i", "x", tagging.part_of_speech(F.col("x")).alias("p")).select("i", "x", "p.*")
    want = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.collect())) == want
    monkeypatch.setattr(tagging, "AT_ONCE", 7)
    batches = df.withColumn("_pieces", tagging.pieces(F.col("x"))).toArrow().to_batches()
    parts = [*tagging._with_parts(iter(batches))]
    assert len(parts) > len(batches)
    assert sorted(repr(Row(**r)) for part in parts for r in part.to_pylist()) == want


def test_incident_report_tags_whole_batches(spark, monkeypatch):
    """No fold over the words of a sentence: all sentences of a batch go on together, some records at a time."""
    seen = []
    real = vocabulary.staged

    def staged(df, name):
        seen.append((df._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return real(df, name)

    monkeypatch.setattr(vocabulary, "staged", staged)
    df = spark.createDataFrame([(1, "Replaced the door")], "id int, summary string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = reports.incident_report(df, "id", "summary", [])._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    ((first, rows),) = seen
    assert first.count("MapInArrow") >= 2 and int(rows) == reports.FEW
    assert "shiftright" not in first + last and "MapInArrow" not in last
