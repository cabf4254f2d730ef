import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloop.llm import mix as M
from feedloop.llm import residue as R
from feedloop.llm.bpe import BYTE_BPE_50K, count, decode, encode, merger
from feedloop.llm.mix import budgets, fit, knapsack, mixture
from feedloop.llm.pretokenize import _scan, tables

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(os.path.dirname(BYTE_BPE_50K) + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def _own(texts):
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    ids, before = merger(BYTE_BPE_50K).encode("".join(texts), starts)
    return [x.tolist() for x in np.split(ids, before[1:])]


TEXTS = [
    "", " ", "a", "'s", "it's we'll they've I'd''s 's \n's", "  two  \n\n  blanks \t", "x" * 3000, " " * 500, "ab" * 2000, "Ünïcödé ЖЖЖ 日本語 ١٢٣ ½",
    "<|endoftext|>", " 　 \r\n", "👩‍🚀🇳🇴", "\U0010ffff marks", "1'2'3 !'s !'", "don'T 'S 'LL 'll", "﻿\x00\x85", "é" * 300,
]


def test_same_ids_as_the_public_library(public):
    assert _own(TEXTS) == [e.ids for e in public.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="'sStmdrelv aé1 \n\t!", max_size=20)), max_size=6))
def test_any_texts(public, texts):
    assert _own(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)] if texts else True


def test_functions_compose_in_any_grouping():
    _, then, _, _, _ = tables()
    f = np.random.default_rng(0).integers(0, len(then), 3000).astype(np.uint8)
    acc, expected = 0, []
    for x in f.tolist():
        expected.append(acc)
        acc = int(then[acc, x])
    assert _scan(f, then).tolist() == expected


def test_encode_job(spark, public):
    rows = [(k, t, 5) for k, t in enumerate(TEXTS)] + [(None, "a b", 5), (0, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    got = encode(df, "doc_id", "text", offsets=True).collect()
    assert len(got) == len(rows)
    by = sorted((r["doc_id"] or -1, list(r["ids"])) for r in got)
    assert by == sorted((d or -1, public.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows)
    for r in got:
        if r["doc_id"]:
            raw = TEXTS[r["doc_id"]].encode()
            cuts = [*r["offsets"], len(raw)]
            assert b"".join(raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) == raw and (not raw or cuts[0] == 0)
    back = {r["doc_id"]: r["text"] for r in decode(encode(df.where("doc_id > 0"), "doc_id", "text"), "doc_id").collect()}
    assert back == dict(list(enumerate(TEXTS))[1:])
    assert sum(r["n_tokens"] for r in count(df, ["doc_id"], "text").collect()) == sum(len(r["ids"]) for r in got)
    assert encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack(parts, target):
    lengths, counts = (np.array(c) for c in zip(*parts, strict=True))
    sums = {0}
    for size, n in parts:
        sums = {s + k * size for s in sums for k in range(n + 1)}
    taken = knapsack(lengths, counts, target)
    assert (taken <= counts).all() and (taken >= 0).all()
    assert int((taken * lengths).sum()) == max(s for s in sums if s <= target)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_fit_meets_the_budget(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 900, 300))
    counts = rng.integers(1, 5, len(lengths))
    total = int((lengths * counts).sum())
    budget = int(rng.integers(total // 10, total))
    taken = fit(lengths, counts, budget, 3)
    assert (taken <= counts).all() and int((taken * lengths).sum()) == budget


def test_budgets():
    row = lambda s, share, tokens, most: {"source": s, "target_share": share, "tokens": tokens, "max_repeats": most}
    free = budgets([row("a", 0.5, 1000, 1), row("b", 0.5, 1000, 1)], 1000)
    assert free == {"a": 500, "b": 500}
    capped = budgets([row("a", 0.5, 1000, 1), row("b", 0.3, 100, 2), row("c", 0.2, 0, 3)], 1000)
    assert capped == {"a": 800, "b": 200, "c": 0}


@pytest.mark.parametrize("group", [50_000, 2])
def test_mixture(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)  # small groups are ranked in bins
    rnd = random.Random(1)
    docs = [(k, rnd.choice("aaab"), "w " * rnd.choice([3, 5, 8]), 1) for k in range(400)] + [(400, None, "w", 1), (401, "x", "w", 1), (402, "a", None, 1), (403, "a", "", 1)]
    targets = [("a", 0.4, 1), ("b", 0.5, 2), ("c", 0.1, 3), ("n", None, None), (None, 0.1, 1)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix, shares = mixture(d, t)
    rows, found = mix.collect(), {r["source"]: r for r in shares.collect()}
    most = {s: m for s, _, m in targets}
    assert all(0 < r["copies"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    for s in ("a", "b"):
        size = sum(r["n_tokens"] * r["copies"] for r in rows if r["source"] == s)
        assert size == found[s]["mixed_tokens"] and 0 <= found[s]["budget"] - size <= 8
    assert found["c"]["actual_share"] == 0 and found["n"]["budget"] == 0
    assert sum(r["actual_share"] for r in found.values()) == pytest.approx(1)
    again = {(r["doc_id"], r["copies"]) for r in mixture(d.repartition(3), t)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}
    none = mixture(d.limit(0), t)
    assert none[0].count() == 0 and {r["actual_share"] for r in none[1].collect()} == {None}


def _cue(*texts):
    return "".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k + 1:02d},500\n{t}\n\n" for k, t in enumerate(texts, 1))


TALK = ["Give me the map and go.", "No, no... not the piano.", "Where's the goat?", "I left it in the attic.", "Did it rain?"]
NOT = [
    None, "", "  \n", "﻿", _cue(*TALK), _cue("{\\an8}[SIGHS]", "<i>Hello</i>", "{y:i}I __ can't __ breathe.", "You owe me $20, 100% sure."),
    _cue("Page not found! Somebody tore it out of the diary.", *TALK), _cue("Turn on JavaScript, grandpa, or it won't load.", *TALK),
    _cue("Too many requests, said the waiter.", *TALK), _cue("asdf qwer", "Sample text for line 2", *TALK), "ÃƒÂ‰coute-moi, Elke.", "<|endoftext|> [INST]",
    _cue("[Hund bellt]", "[dog barking in distance]", "<font color=\"#fff\">a</font>"), _cue("<v Maro>Hello there", "<c.yellow>b</c>"),
    _cue("And he kept mumbling lorem ipsum, lorem ipsum...", *TALK), _cue(*["la la la"] * 2, *TALK),
]
SLOT = [
    _cue(*TALK, x) for x in ("{{ title }}", "Hi {name}!", "${first_name}: Hello", "Subtitles by %TRANSLATOR%", "<%= line %>", "<?php echo $x; ?>", "@@LANG@@", "%(year)s",
    "[[date]]", "__CUE_TEXT__", "$AUTHOR$", "#{imie}", "<<SHOW>>", "{ {datum} }", "{% if a %}b{% endif %}", "[YOUR TEXT HERE]", "<Text hier einfügen>",
    "&#123;&#123;name&#125;&#125;", "I left {0} there.", "[[Ð½Ð°Ð·Ð²]]")
]
FILLER = [_cue("Sample text for line 1", "Votre sous-titre ici", "Did it rain?"), _cue("qwer asdf", "zxcv", "jkl; uiop"), _cue("Lorem ipsum dolor sit amet", "Magna aliqua velit."),
          _cue("test test test", "test, test", "test - test"), "Lorem ipsum dolor sit amet.\nNulla velit esse."]
PAGE = [
    "<html><head><title>404 Not Found</title></head>\n<body><center><h1>404 Not Found</h1></center>\n<hr>nginx</body></html>", "HTTP/1.1 502 Bad Gateway",
    "Please enable JavaScript to view the subtitles.", "P l e a s e   e n a b l e   J a v a S c r i p t   t o   v i e w   t h e   s u b t i t l e s .",
    "PIease enab1e JavaScript t0 view the subtitIes.", _cue(*TALK) + "Désolé, la page demandée est introuvable.", _cue("This file has been removed at the request of the uploader."),
    '{"status":"error","detail":"Gone","request":"1f2e3d4c"}', "Włącz obsługę JavaScript, aby zobaczyć napisy.".encode().decode("cp1252", "ignore"),
    "Страница не найдена. Ошибка 404".encode("cp1251").decode("cp1252"), _cue("<noscript>Ative o JavaScript para continuar.</noscript>"),
]


#: As a corpus teaches it, see test_slots_are_induced and test_learnt_from_the_corpus.
LEARNT = R.Learnt(
    names=frozenset(["title"]), notations=frozenset(["@@…@@", "<<…>>", "{ {…} }", "{#:…}"]),
    pages=frozenset(["désolé, la page demandée est introuvable.", "włącz obsługę javascript, aby zobaczyć napisy.", "страница не найдена. ошибка #.",
                     "this file has been removed at the request of the uploader.", "ative o javascript para continuar.", "please enable javascript to view the subtitles."]),
    captions=frozenset(["votre sous-titre ici", "sample text for line #"]),
)


def test_verdicts():
    reader = R.Reader(LEARNT)
    for texts, kind in ((NOT, None), (SLOT, "slot"), (FILLER, "filler"), (PAGE, "page")):
        for t in texts:
            assert reader.verdict(t) == kind, t


def test_learnt_from_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE_GROUPS", 3)
    odd = "zorgblat frimble unquot 77 vexed"
    docs = [(k, f"t{k}", odd.replace("77", str(k))) for k in range(5)] + [(9, "t9", _cue(*TALK) + odd)]
    docs += [(20, "t1", _cue(*TALK, "{{sprecher}}")), (21, "t2", _cue(*TALK, "{{sprecher}}")), (22, "t3", _cue(*TALK, "[sprecher]")), (23, "t4", _cue(*TALK, "[seufzt]"))]
    docs += [(30, None, None), (None, "t1", _cue(*TALK)), (31, "t5", "x" * 200_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, title string, text string, residue int")
    got = {r["doc_id"]: r["residue"] for r in R.residue(df, "doc_id", "text", "title").collect()}
    expected = {k: "page" for k in (0, 1, 2, 3, 4, 9)} | {20: "slot", 21: "slot", 22: "slot", 23: None, 30: None, None: None, 31: None}
    assert got == expected
    assert R.without_residue(df, "text", "title").count() == 4
    assert R.residue(df.limit(0), "doc_id", "text", "title").count() == 0


def test_a_few_filler_cues_are_no_case():
    few = R.Reader(R.Learnt())
    assert few.verdict(_cue("asdf", "qwer", *TALK)) is None and few.verdict(_cue("asdf", TALK[0])) is None


@pytest.mark.parametrize("piece", [" ", "\n", "\t \n", "x", "1", "a1", ".", "{", "{{", "<", "[a", "%a", "$a", "__", "@@", "Ã©", "00:00:01,000 --> ", "qwer ", "404 ", "<b>", "&#123;", "\u0600"])
def test_very_long_texts(piece):
    began = time.perf_counter()
    R.Reader(LEARNT).verdict(piece * (300_000 // len(piece)))
    R._Counts().add(piece * (300_000 // len(piece)), "t")
    assert time.perf_counter() - began < 10
