"""What the judge of residue skips, and that skipping changes nothing."""

import random

from feedloop.llm import notices as N
from feedloop.llm import residue as R


def _every(skel):
    return [skel[k : k + N.GRAM] for k in range(len(skel) - N.GRAM + 1)]


def test_ordinary_units_are_given_up_early():
    judge = N.Judge()
    assert judge._sequences(N.skeleton("My grandmother hung laundry above wild geraniums")) == []
    whole = N.skeleton(N.MESSAGES[0])
    assert judge._sequences(whole) == _every(whole)


def test_units_that_are_given_up_are_not_covered():
    rng, judge, given_up = random.Random(3), N.Judge(captions=["this is line number # of the example"]), 0
    other = "my grandmother hung laundry above wild geraniums while juggling".split()
    for text in (*N.STATUS, *N.MESSAGES, *N.SCRIPTS, "this is line number 7 of the example"):
        for share in (0.0, 0.2, 0.3, 0.5, 0.8):
            words = [w for w in text.split() if rng.random() >= share] + [rng.choice(other) for _ in range(int(12 * share))]
            rng.shuffle(words) if share == 0.3 else None
            skel = N.skeleton(" ".join(words))
            if not judge._sequences(skel):
                given_up += 1
                own = _every(skel)
                for phrases in (judge.pages, judge.dummies):
                    assert not own or phrases.covered(own, len(skel), set(own)) < N.COVER
    assert given_up > 20


def test_notations_begin_with_their_opening():
    for opening, pattern in R.SLOTS:
        assert pattern.pattern.replace("\\", "").startswith(opening)
    assert R.slots("a$b$ $c$ x__d__ __e__ {{f}} \\{gg} {hh}") == ["f", "c", "e", "hh"]


def test_folded_letters_of_ascii():
    text = "".join(map(chr, range(128)))
    assert N.fold(text) == text.casefold().translate(N._FOLD).replace("vv", "w").replace("rn", "m").replace("cl", "d")
