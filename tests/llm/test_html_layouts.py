"""Main text of hand-written pages that are in no training layout, and pages whose cost would show if it weren't linear."""

import random
import time

import pytest

from vesper.llm import html

P = ["The council met on Tuesday to discuss the new bridge, which has been planned for years. Several members spoke against it.", "Work is to begin in spring, the mayor said, if the money can be found. The last bridge on this site fell in 1921.", "Residents who live near the river have asked for a wall against the floods. No answer has been given so far."]
PAGES = {
    "head left out": (f"<title>News</title><body><ul class=menu><li><a href=/>Home</a><li><a href=/n>News</a></ul><article><h1>A new bridge</h1><p>{P[0]}<p>{P[1]}</article>", ["A new bridge", P[0], P[1]]),
    "head never closed": (f"<html><head><meta charset=utf-8><title>News</title><link rel=x href=y><body><main><p>{P[0]}</p><p>{P[1]}</p></main></body></html>", P[:2]),
    "button never closed": (f"<body><header><button>Menu</header><button class=x>Search<main><p>{P[0]}</p><p>{P[2]}</p></main></body>", [P[0], P[2]]),
    "select never closed": (f"<body><form class=search><select><option>All<option>News</form><div id=content><p>{P[0]}</p><p>{P[1]}</p></div>", P[:2]),
    "table as layout": (f"<body><table width=100%><tr><td class=nav><a href=/a>Start</a><br><a href=/b>Sport</a></td><td class=main><p>{P[0]}</p><p>{P[1]}</p></td></tr><tr><td colspan=2 class=footer>&copy; 2020 The Paper. All rights reserved.</td></tr></table>", P[:2]),
    "cookie dialog": (f"<body><div role=dialog class='cookie consent-dialog'><p>We use cookies to improve your visit. By going on you agree to it.</p><button>Accept</button><button>Refuse</button></div><article><p>{P[0]}</p><p>{P[2]}</p></article>", [P[0], P[2]]),
    "nested comments": (f"<body><article><p>{P[0]}</p><p>{P[1]}</p></article><section class=comments><div class=comment><p>I do not like it at all, and I never did.</p><div class='comment reply'><p>You are wrong about this, my friend.</p></div></div></section>", P[:2]),
    "definition list": (f"<body><nav><a href=/>Home</a></nav><article><p>{P[0]}</p><dl><dt>Bridge</dt><dd>{P[1]}</dd><dt>River</dt><dd>{P[2]}</dd></dl></article>", [P[0], "Bridge", P[1], "River", P[2]]),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_layouts_outside_the_training_family(name):
    page, expected = PAGES[name]
    assert html.main_text(page, html.default_model()) == "\n".join(expected)


def test_emissions_equal_the_sum_of_features():
    model = html.default_model()
    for page, _ in PAGES.values():
        found = html.blocks(page)
        by_features = [model.emit[f].sum(axis=0) for f in html.features(found)]
        assert abs(html.emissions(found, model) - by_features).max() < 1e-9
        assert model.decode(html.features(found)) == model.viterbi(html.emissions(found, model))


def test_unclosed_tags_end_at_the_next_block():
    texts = lambda page: [b.text() for b in html.blocks(page)]
    assert texts("<button>a<div>b</div><button>c</button><p>d") == ["b", "d"]
    assert texts("<div><svg><title>t</title><path/></svg>a</div>") == ["a"]
    assert texts("<div><object><object>a</object>b</object>c</div>") == ["c"]
    assert texts("<video src=x>a<div>b</div>") == ["b"]
    assert texts("<select><optgroup><option>a<option>b</select>c") == ["c"]


def test_deep_nesting_takes_linear_time():
    rng = random.Random(1)
    model = html.default_model()
    classes = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30_000)]
    pages = ["<div>x" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "".join(f"<div class={c}>x" for c in classes), "<b>x" * 100_000, "<button>x" * 100_000, "<ul><li>" * 50_000 + "x"]
    began = time.monotonic()
    for page in pages:
        html.main_text(page, model)
    assert time.monotonic() - began < 90  # a square would take an hour
