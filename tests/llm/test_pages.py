"""Pages of many layouts whose article must come out whole."""

import itertools

import pytest

from factweave.llm import html_text

A = "The first paragraph of the story, with commas, has enough words to count as text. It goes on for a while."
B = "The second one, too, is long enough, and it says something more about the matter at hand than the first."
C = "A third one follows, shorter, but it is text."
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/b>About the site</a></ul></nav>"
FOOT = "<footer><p>All rights reserved, by us, for all time, and in all countries.</p></footer>"
LINKS = "<ul><li><a href=1>A source of the story</a></li><li><a href=2>Another source of it</a></li></ul>"

PAGES = {
    "in one form": (f"<body><form id=aspnetForm><div><h1>Head</h1><p>{A}</p><p>{B}</p></div></form></body>", ["Head", A, B]),
    "form with furniture": (f"<form><div id=header><a href=/>Site</a></div>{NAV}<div><h1>Head</h1><p>{A}</p><p>{B}</p><input><button>Go</button></div>{FOOT}</form>", ["Head", A, B]),
    "form in an article": (f"<article><p>{A}</p><form><p>Leave us your mail, we write to you often, and gladly.</p></form><p>{B}</p></article>", [A, B]),
    "sections": (f"<div><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section><section><h2>Three</h2><p>{C}</p></section></div>", ["One", A, "Two", B, "Three", C]),
    "nested sections": (f"{NAV}<div><h1>Head</h1><div><section><div><p>{A}</p></div></section><section><div><p>{B}</p></div></section></div></div>{FOOT}", ["Head", A, B]),
    "rows of a table": (f"<table><tr><td><a href=/>Home</a></td></tr><tr><td><p>{A}</p></td></tr><tr><td><p>{B}</p></td></tr><tr><td><a href=/x>Imprint</a></td></tr></table>", [A, B]),
    "classes of paragraphs": (f"<article><p class=alert>{A}</p><p id=social>{B}</p><h2 id=notices>Notices</h2><p>{C}</p></article>", [A, B, "Notices", C]),
    "anchors of a manual": (f"<main><section id=menu><h2 id=menu-1>The menu</h2><p>{A}</p></section><div class=section id=alerts><h2>Alerts</h2><p>{B}</p></div></main>", ["The menu", A, "Alerts", B]),
    "references": (f"<article><h1>Head</h1><p>{A}</p><p>{B}</p><h2>References</h2>{LINKS}</article>", ["Head", A, B, "References", "A source of the story", "Another source of it"]),
    "links in the middle": (f"<div><p>{A}</p>{LINKS}<p>{B}</p></div>", [A, "A source of the story", "Another source of it", B]),
    "links at the end": (f"<div><p>{A}</p><p>{B}</p>{LINKS}</div>", [A, B]),
    "formula": (f"<article><p>{A}</p><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>x=1</annotation></semantics></math> hold.</p></article>", [A, "Let x=1 hold."]),
    "advert paragraph": (f"<article><p>{A}</p><p class='ad'>Buy, buy, buy, today and tomorrow, and the day after that.</p><p>{B}</p></article>", [A, B]),
    "named list items": (f"<article><p>{A}</p><ol class=commentlist><li class=comment>I, for one, think that this is wrong.</li></ol></article>", [A]),
    "menu of classes": (f"<ul><li class=menu>Home, sweet home, and other places</li></ul><div><p>{A}</p><p>{B}</p></div>", [A, B]),
    "forum": (f"{NAV}<div class=thread><div class=post><p>{A}</p></div><div class=post><p>{B}</p></div></div>", [A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == "\n\n".join(want)


WRAPPERS = ["<div>{}</div>", "<form action=/x>{}</form>", "<main>{}</main>", "<section>{}</section>", "<center>{}</center>", "<div id=content class='has-menu'>{}</div>", "<table><tr><td>{}</table>", "<article>{}</article>", "<fieldset>{}</fieldset>"]


@pytest.mark.parametrize("outer, inner", list(itertools.product(WRAPPERS, WRAPPERS)))
def test_paragraphs_survive_any_wrapper(outer, inner):
    own = f"<h2>Head</h2><p>{A}</p><p>{B}</p><blockquote>{C}</blockquote>"
    page = f"<html><body>{NAV}{outer.format(inner.format(own))}{FOOT}</body></html>"
    assert html_text.main_text(page) == "\n\n".join(["Head", A, B, C])
