"""Hand-written pages in five languages, shapes that names alone would drop, and hostile pages."""

import time

import pytest

from tessitura.llm.blocks import main_text

LONG = {
    "en": "The house on the hill was built by the people of the town, and it is one of the oldest that they have in the county, as all of them will tell you when you ask about it. It was there before the road and the river wall.",
    "de": "Das Haus auf dem Hügel ist von den Menschen der Stadt gebaut worden, und es ist eines der ältesten, die sie in dem Land haben, wie sie alle sagen werden, wenn man sie nach dem Haus und der Straße fragt, die es nicht mehr gibt.",
    "fr": "La maison sur la colline est une des plus anciennes que les gens de la ville ont dans le pays, et ils vous le diront tous si vous les interrogez au sujet de la route et du mur de la rivière qui ne sont plus là comme avant, dans la vallée.",
    "ru": "Дом на холме построили жители города, и это один из самых старых домов, которые есть у них в округе, как скажет вам каждый, если вы спросите о дороге и о стене у реки, которых больше нет на прежнем месте, потому что их давно убрали отсюда.",
    "zh": "这座房子是镇上的人们建造的，它是他们在县里拥有的最古老的房子之一，大家都会这样告诉你，如果你问起那条路和河边的墙。",
}
SHORT = "The house on the hill was built by the people of the town, and it is one of the oldest that they have in the county, as all will tell."
LINKS = "<div><a href='#'>Read more about the people of the town and all of the houses on the hill</a></div>"
P = f"<p>{LONG['en']}</p>"
PAGES = [
    *((f"<nav><a href='/'>Home</a></nav><div>{t}</div><footer>© 2020 x</footer>", [t]) for t in LONG.values()),
    *((f"<article><p>{t}</p></article><aside>{t}</aside>", [t]) for t in LONG.values()),
    (f"<div class='no-sidebar'><div>{P}{P}</div></div>", [LONG["en"]] * 2),
    (f"<form id='aspnetForm'><div>{P}{P}</div></form>", [LONG["en"]] * 2),
    (f"<p>{LONG['en']}</p><div class='no-sidebar'><article>{P * 3}</article></div>", [LONG["en"]] * 4),
    (f"<article>{P}</article><div class='layout-sidebar'><article>{P * 4}</article></div>", [LONG["en"]] * 5),
    (f"<h1>The House</h1><p>{SHORT}</p>{LINKS}<p>{SHORT}</p><p>{SHORT}</p>", [SHORT] * 3),
    (f"<article>{P * 3}</article><div class='related'><article><p>{SHORT}</p></article></div><form>{SHORT}</form><div class='comments'>{P * 9}</div>", [LONG["en"]] * 3),
    (f"<article>{P}</article><div id='cookie-notice'><p>{SHORT}</p></div>", [LONG["en"]]),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_page(k):
    page, want = PAGES[k]
    assert [x for x in main_text(page).split("\n") if x != "The House"] == want


HOSTILE = {
    "long attribute": "<div " + "a" * 100_000 + ">",
    "open titles": "<title>" * 40_000,
    "open inline elements": "<b>" * 40_000 + "<li>x</li>" * 200,
    "list items over open elements": "<li>" + "<b>" * 40_000 + "<li>x" * 2000,
    "equal signs": "<a " + "= " * 100_000,
    "open quotes": '<a ="' * 50_000,
    "angle brackets": "<" * 200_000,
    "comments": "<!--" * 50_000,
    "references": "&" * 100_000,
    "open lists": ("<ul><li>" + "<b>" * 20) * 3000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_page(name):
    began = time.process_time()
    main_text(HOSTILE[name] + P)
    assert time.process_time() - began < 1
