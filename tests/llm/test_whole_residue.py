import pytest
from tests.llm.messages import HELD_OUT, SEEN
from tests.llm.test_texts import TALK, _cue

from feedloop.llm import residue as R

SLOTS = R.Learnt(names=frozenset(["title", "thesprecher"]), notations=frozenset(["{#:…}"]))
CAPTIONS = R.Reader(R.Learnt(captions=frozenset(["escriba aquí su subtítulo", "tekst zastępczy #", "ejemplo de texto #", "line # of the example"])))
PLAIN = R.Reader(R.Learnt())


@pytest.mark.parametrize("slot", ["{0:season}", "more captions at {1:date}", "{1:cue_text_93}", "{your name here}", "{{insert translator name here}}", "{ Text hier einfügen }", "{the sprecher}"])
def test_slots_in_braces(slot):
    assert R.Reader(SLOTS).verdict(_cue(*TALK, slot)) == "slot"


@pytest.mark.parametrize("code", ["{100}{250}Hello", "{y:i}Hello", "{Y:b}Hello", "{C:$0000ff}Hello", "{\\an8}Hello", "{an8}Hello", "{\\pos(10,20)}Hello", "{\\fad(1,2)\\i1}Hello", "{12:30} he said", "{laughs softly}"])
def test_codes_in_braces_are_no_slots(code):
    assert R.Reader(SLOTS).verdict(_cue(*TALK, code)) is None


@pytest.mark.parametrize("line", ["Escriba aqu? su subt?tulo", "Tekst zast?pczy", "Tekst zast\ufffdpczy", "E j e m p l o   d e   t e x t o", "Line of the\nexample"])
@pytest.mark.parametrize("n", [6, 7, 30])
def test_damaged_filler_of_any_length(line, n):
    assert CAPTIONS.verdict(_cue(*[line] * n)) == "filler"
    assert CAPTIONS.verdict(_cue(*[line] * n, *TALK * n)) is None


def test_messages_in_records_of_any_length():
    gone = ["The page you requested could not be found.", "502 Bad Gateway", "Please enable JavaScript to continue using this application."]
    assert PLAIN.verdict(_cue(*gone, *gone, "nginx or what else is said here")) == "page"
    assert PLAIN.verdict("\n\n".join([*TALK, gone[0]])) == "page"
    assert PLAIN.verdict(_cue(gone[0], *TALK)) is None and PLAIN.verdict("\n\n".join([gone[0], *TALK])) is None


def _corpus(spark, texts):
    return spark.createDataFrame([(k, f"t{k}", t) for k, t in enumerate(texts)], "doc_id bigint, title string, text string")


def _found(df):
    return {r["doc_id"]: r["residue"] for r in R.residue(df, "doc_id", "text", "title").collect()}


def test_slots_are_induced(spark):
    """A notation is learnt where its names stand in slots of aligned lines; sound descriptions in brackets aren't."""
    lines = [f"Nobody goes to the {x} before the storm" for x in ("mill", "pier", "station", "chapel")]
    texts = [_cue(*TALK, line, "[sighs]", "We [sighs] go now") for line in lines]
    texts += [_cue(*TALK, f"Nobody goes to the ~~{n}~~ before the storm") for n in ("title", "date", "speaker", "title")]
    texts += [_cue(*TALK, "{{title}} {{date}} {{speaker}}")] * 2 + [_cue(*TALK, "Here comes ~~title~~"), _cue(*TALK, "Nobody goes to the ~~ before the storm")]
    df = _corpus(spark, texts)
    learnt = R.learn(df, "text", "title")
    assert "~~…~~" in learnt.notations and not any("[" in n for n in learnt.notations)
    assert {"title", "date", "speaker"} <= learnt.names and learnt.slots
    got = _found(df)
    assert [got[k] for k in range(11)] == [None] * 4 + ["slot"] * 7


def test_defaults_and_blanks_in_known_slots(spark):
    filled = [f"Captions were made by {x} for all of you" for x in ("Anna", "Bo", "Cy", "Di")]
    open_ = [f"Captions were made by {{{{name}}}} for all of you" for _ in range(4)]
    texts = [_cue(*TALK, t, "bye") for t in filled + open_ + ["Captions were undefined of you", "Captions were of you", "Captions were made by null", "Captions were made by", "Captions were kind of you"]]
    texts += [_cue(*TALK, f"Captions were made by {x}", "bye") for x in ("Anna", "Bo", "Cy", "{{name}}", "{{name}}", "{{name}}")]
    got = _found(_corpus(spark, texts))
    assert [got[k] for k in range(8, 13)] == ["slot", "slot", "slot", "slot", None]


def test_dummy_captions_are_learnt(spark):
    """Captions that count themselves teach the captions that stand with them."""
    odd = ["Zorg blat {}", "Frimble here", "Vexed {} unquot", "Zorg blat {}", "Frimble here", "Zorg blat {}"]
    texts = [_cue(*(line.format(k) for k, line in enumerate(odd, 1)), TALK[j]) for j in range(4)] + [_cue("Frimble here"), _cue(*TALK, "Frimble here"), _cue(*TALK)]
    got = _found(_corpus(spark, texts))
    assert [got[k] for k in range(7)] == ["filler"] * 5 + [None, None]


def test_unseen_messages():
    """Found alone, without any learning: 30 of 40 that were tried once, after the lexicon was finished."""
    assert sum(PLAIN.verdict(m) == "page" for m in HELD_OUT) >= 30
    assert sum(PLAIN.verdict(m) == "page" for m in SEEN) >= 0.9 * len(SEEN)


def test_unseen_messages_are_learnt_where_they_repeat(spark):
    texts = [t for m in HELD_OUT for t in [m] * 4] + [_cue(*TALK, m) for m in HELD_OUT] + [_cue(*TALK)] * 9
    got = _found(_corpus(spark, texts))
    assert all(got[k] == "page" for k in range(5 * len(HELD_OUT))) and all(got[5 * len(HELD_OUT) + k] is None for k in range(9))


def test_talk_about_pages_is_none():
    said = ["Page not found! Somebody tore it out of the diary.", "Session expired? The judge went home.", "It said the page requires cookies. I brought biscuits.", "Too many requests, said the waiter."]
    for line in said:
        assert PLAIN.verdict(_cue(*TALK, line)) is None and PLAIN.verdict(_cue(line, *TALK)) is None, line


def test_too_much_learnt_raises(spark, monkeypatch):
    df = _corpus(spark, [_cue("{{sprecher}} {{datum}} {{titel}}")] * 3)
    assert R.learn(df, "text", "title").names == {"sprecher", "datum", "titel"}
    monkeypatch.setattr(R, "KEPT", 1)
    with pytest.raises(ValueError, match="slot names"):
        R.learn(df, "text", "title")
