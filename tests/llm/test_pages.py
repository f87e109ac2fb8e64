from __future__ import annotations

import json

from harrow.llm import boilerplate, residue
from harrow.llm.boilerplate import MODEL_FILE, ChainField, judged, main_lines
from harrow.llm.pages import blocks_of
from harrow.llm.residue import _NUMBER, _SENTENCE, _WORDS, found_residue, host_of, sentences_of, slots_of, template_of, unfilled_error, words_of
from harrow.llm.train_boilerplate import examples, label, train

PAGE = """<!doctype html>
<html lang="en"><head><title>Acme Pumps | About</title>
<style>.a{margin:0}</style>
<script>var cfg = {"tpl": "{{ item.name }}"};</script>
</head><body>
<nav>
<li><a href="/a">Home</a></li>
<li><a href="/b">Contact</a></li>
</nav>
<main>
<h1>About Acme Pumps</h1>
<p>We keep spare stock for marinas so that patrol rosters can restart the same afternoon.</p>
<p>Half of our staff once worked for marinas
and know their rush weeks.</p>
<li>Patrol rosters for marinas</li>
</main>
<footer>
<p>© 2021 Acme Pumps. All rights reserved.</p>
<span>Back to top ↑</span>
</footer>
</body></html>"""


def field():
    return ChainField.load()


def test_main_lines():
    assert main_lines(PAGE, field()) == [11, 12, 13, 14, 15]
    assert main_lines(None, field()) == [] == main_lines("", field()) == main_lines(" \n ", field())
    excerpt = "We use cookies to keep this site working. Accept all | Reject\nCustomers in Rapholm usually ask about payroll runs first."
    assert main_lines(excerpt, field(), excerpt=True) == [2]


def test_notices_have_no_main_lines():
    for body in ("<html><body><h1>Page not found</h1>\n<p>It may have moved or been renamed.</p></body></html>", "Service temporarily unavailable", '<html><body><noscript>This app needs JS.</noscript>\n<div id="root"></div></body></html>', "<h1>Welcome</h1>\n<p>Lorem ipsum dolor sit amet consectetur.</p>"):
        blocks = blocks_of(body)
        kind, _ = judged(blocks, field().decode(blocks))
        assert kind in ("notice", "filler") and main_lines(body, field()) == []


def test_content_that_speaks_of_notices_stays():
    body = "<h1>Alarm maintenance for data halls</h1>\n<p>We keep spare stock for marinas so that alarm maintenance can restart the same afternoon.</p>"
    assert main_lines(body, field()) == [1, 2]


def test_long_and_broken_pages():
    assert len(main_lines(PAGE.replace("</main>", "<p>Our planners sit next to the people who carry out gate readers.</p>\n" * 20_000 + "</main>"), field())) >= 20_000
    for broken in ("<div", "<p>a < b</p>", "</div></div><p>x", "<script>never closed", "<!-- x"):
        main_lines(broken, field())


def test_field_learns_labelled_pages(data):
    pages = examples(data, 60)
    model = train(pages[:80], epochs=4)
    held = pages[80:]
    right = sum(g == bool(w) for bs, ys in held for g, w in zip(model.decode(bs), ys, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.9
    stored = json.loads(MODEL_FILE.read_text())
    assert len(stored["weights"]) < 50_000 and label(blocks_of("<p>Subscribe</p>")[0], "") == 0


def test_slots():
    assert slots_of(["TODO: write intro"])[0] and slots_of(["{phone}"])[0] and slots_of(["INSERT TAGLINE HERE"])[0]
    assert slots_of(["Nothing special here, really."]) == (False, [])
    assert slots_of(["Call [[city]] for a first talk."]) == (False, [("", "for a", "[[city]]")])
    assert [unfilled_error(e) for e in ("HTTP {status_code}", "%(detail)s", "<error text>", "timed out", "", None)] == [True, True, True, False, False, False]


def test_residue(spark):
    spoken = "<p>Our label tool swaps {{name}} for the buyer's name before the press starts. We quote key safes by the day, never by the hour.</p>"
    rows = [
        (1, "https://a.example", spoken, None), (2, "https://b.example", spoken, ""), (3, "https://c.example", "<h1>About Acme</h1>\n<p>Welcome to {{city}}, your partner for everyday work.</p>", ""),
        (4, "https://d.example", "<h1>About Acme</h1>\n<p>Welcome to [phone], your partner for everyday work.</p>", ""), (5, "https://e.example", "<h1>404</h1>\n<p>Page not found</p>", ""),
        (6, "https://f.example", "", "timed out"), (7, "https://g.example", None, "${reason}"), (8, "not a url [", "<p>We provide key safes to marinas.</p>\n<script>var t = '{{ x }}'</script>", "HTTP 500"),
        (9, None, " ", None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "fetch_id long, url string, body string, error string, template string")
    assert sorted(r.fetch_id for r in found_residue(df).collect()) == [3, 4, 5, 7]


def test_leftovers_that_recur(spark):
    said = "<p>Our label tool swaps {{name}} for the buyer's name before the press starts.</p>"
    left = "<h1>About us</h1>\n<p>Welcome to {{city}}, your partner for everyday work.</p>"
    blank = "<h1>About us</h1>\n<p>We serve customers in , and we answer the same day.</p>"
    pages = [(1, "a", said), (2, "b", said), (3, "c", left), (4, "d", left), (5, "e", left.replace("{{city}}", "Rapholm Bay")), (6, "f", blank), (7, "g", blank), (8, "h", blank.replace(" ,", " Kidford,"))]
    df = spark.createDataFrame([(i, f"https://{h}.example", body, "") for i, h, body in pages], "fetch_id long, url string, body string, error string")
    assert sorted(r.fetch_id for r in found_residue(df).collect()) == [3, 4, 6, 7]


def test_markup_is_looked_for_in_whole_texts():
    body = "<script>\n" + "var a = 1;\n" * 1000 + "</script>\n<p>Our planners sit next to the people who carry out gate readers.</p>"
    assert [b.text for b in blocks_of(body)] == ["Our planners sit next to the people who carry out gate readers."]


def test_long_templates_in_any_language(spark):
    four = "<h1>{h}</h1>\n<p>Wir bauen gerade um und sind bald wieder da, versprochen ist versprochen.</p>\n<p>Die {h} Seite zieht heute um.</p>\n<p>" + "Bis dahin liegt alles im Lager bereit. " * 6 + "</p>"
    alone = "<h1>{h}</h1>\n<p>Twelve crates of oak stand behind the mill, next to the old weir.</p>"
    hosts = ["acmewood", "bellstone", "cordfield", "dalebrook", "elmhurst", "foxgrove", "gatemoor", "hillcrest", "ivyhouse", "junipers"]
    rows = [(i, f"https://{h}.example", four.replace("{h}", h.title()), "") for i, h in enumerate(hosts[:3])] + [(10 + i, f"https://{h}.example", alone.replace("{h}", h.title()), "") for i, h in enumerate(hosts)]
    rows += [(30 + i, f"https://{h}.example", alone.replace("{h}", h.title()).replace("oak", "ash"), "") for i, h in enumerate(hosts[:9])]
    df = spark.createDataFrame(rows, "fetch_id long, url string, body string, error string")
    assert sorted(r.fetch_id for r in found_residue(df).collect()) == [0, 1, 2, *range(10, 20)]


def test_read_once(monkeypatch):
    known: dict[str, list[str]] = {}
    texts = ["Call 12 of ACME now. ΑΣ. It's 3-fold!", "Call 12 of ACME now."]
    wanted = ["call", "0", "of", "*", "now", "ας", "it's", "0-fold", "call", "0", "of", "*", "now"]
    assert template_of(texts, "acme.example", known) == wanted == template_of(texts, "acme.example", known) == template_of(texts, "acme.example")
    assert len(known) == 3
    read = []
    monkeypatch.setattr(boilerplate, "is_filler", lambda t: bool(read.append(t)))
    blocks = boilerplate.plain_blocks("We restore harbour cranes " * 40 + "\nCranes for Bremen")
    assert boilerplate.judged(blocks, [True, True])[0] == "content"
    assert read == ["Cranes for Bremen"]  # long texts are not read where a short one decides


def test_plain_tokens_are_the_same():
    for t in ("It's 12% off_a - co-op, A1b2 x--y 'q' #z_9", "naïve l’été 5€", "_", ""):
        assert boilerplate.tokens_of(t) == boilerplate._TOKEN.findall(boilerplate._DIGITS.sub("0", t.lower()))


def test_ordinary_texts_need_no_pattern(monkeypatch):
    monkeypatch.setattr(boilerplate, "_PLAIN_TOKEN", None)
    monkeypatch.setattr(boilerplate, "_DIGITS", None)
    wanted = ["outside", "it", ",", "we", "bring", "heat-pump", "surveys", "to", "0", "farms", ".", "it's", "0", "!"]
    assert boilerplate.tokens_of("Outside it, we bring heat-pump surveys to 15 farms. It's 5!") == wanted


def test_numbered_classes_are_weighed_once(monkeypatch):
    model, weighed, real = field(), [], boilerplate.place_features
    monkeypatch.setattr(boilerplate, "place_features", lambda *a: weighed.append(a[0].classes) or real(*a))
    pages = [blocks_of(f'<div class="c{n} box-{n}">\n<p>Cranes for Bremen</p>\n</div>') for n in (7, 12, 984)]
    assert [b.classes for p in pages for b in p] == ["c7 box-7", "c12 box-12", "c984 box-984"]
    assert len({tuple(model.scores(p)) for p in pages}) == 1 and weighed == ["c7 box-7"]


def test_words_and_sentences_are_the_same():
    texts = ["It's 12% off_a - co-op, A1b2 x--y 'q' #z_9", "12-15 -a- b'' 1,000.50", "naïve l’été 5€ ٣", "_", "", "ΑΣ. ΑΣ", "a\tb\x1cc\x00d", "x'-y -", "-", "'"]
    for t in texts:
        assert words_of(t) == _WORDS.findall(_NUMBER.sub("0", t.lower()))
        assert boilerplate.tokens_of(t) == boilerplate._TOKEN.findall(boilerplate._DIGITS.sub("0", t.lower()))
    for t in ("One. Two! Three? Four", "a. . b", "Dr.No .x", "?! ok", ".", "End."):
        assert sentences_of(t) == _SENTENCE.split(t)
    assert [host_of(u) for u in ("https://www.a-b.example/x[", "http://A.example", "https://u@b.example:80", "https://c.example?q", "x", "https://[", None)] == ["a-b.example", "a.example", "b.example", "c.example", "", "", ""]


def test_lines_with_one_tag():
    body = '<div class=" a1 ">\n<div>\n<p>x</p>\n</div> \n</section>\n<p>y</p>\n</div>\n<td>z</td>\n<nav class="q" id="n">\nw'
    assert [(b.text, b.container, b.classes, b.depth, b.fresh) for b in blocks_of(body)] == [("x", "div", "", 2, True), ("y", "div", "a1", 1, True), ("z", "", "", 0, True), ("w", "nav", "q", 1, True)]
    assert [b.text for b in blocks_of("<p> a  b&nbsp;c\x1cd </p>\n<p>e&amp;f</p>")] == ["a b c d", "e&f"]


def test_lines_are_passed_over_before_they_are_taken_apart(spark, monkeypatch):
    lines = spark.createDataFrame([("Welcome to Rapholm, your partner.",), ("WELCOME to  {} , your partner",), ("Unwelcome to X your Partnership",), ("A is b.",), ("We go",), (None,)], "line string")
    fields = spark.createDataFrame([("welcome to", "your partner"), ("^ a", "b $"), ("unseen words", "")], "pre string, post string")
    wanted = [("^ a", "b $"), ("welcome to", "your partner")]
    found = residue.filled(lines, fields)
    assert sorted(map(tuple, found.collect())) == wanted
    without = fields.where("pre <> '^ a'")
    assert [tuple(r) for r in residue.filled(lines, without).collect()] == wanted[1:]
    assert "contains(line" in residue.filled(lines, without)._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(residue, "SOME_WORDS", 0)
    assert [tuple(r) for r in residue.filled(lines, without).collect()] == wanted[1:]
