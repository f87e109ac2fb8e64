from __future__ import annotations

import pytest

from harrow.llm.pii import NameLexicon, all_names, find, found_items, lexicon_of, masked, normal_form, with_masked

LEXICON = NameLexicon(frozenset(("ana", "søren", "małgorzata", "hana", "luca")), frozenset(("nibheim", "kekström", "kammoor", "fodez", "movquist")))

CASES = [
    ("Send it to ana_n+x@mail.example.org.", [("email", "ana_n+x@mail.example.org")]),
    ("mail zo97 [at] inbox [dot] example [dot] org now", [("email", "zo97 [at] inbox [dot] example [dot] org")]),
    ("mail zo.k(at)post.test, please", [("email", "zo.k(at)post.test")]),
    ("use selma AT mail DOT example instead", [("email", "selma AT mail DOT example")]),
    ("call ana07 @ inbox.example", [("email", "ana07 @ inbox.example")]),
    ("cu​t ana@x.ex​ample", [("email", "ana@x.ex​ample")]),
    ("Mail the sample at 14 @ 1,838 units each.", []),
    ("try (020) 7946-0134 or +44 (0)20 7946 0952, 555-0141 ext. 880", [("phone", "(020) 7946-0134"), ("phone", "+44 (0)20 7946 0952"), ("phone", "555-0141 ext. 880")]),
    ("ring zero two zero seven nine four six zero one three four today", [("phone", "zero two zero seven nine four six zero one three four")]),
    ("fax ＋44 20 7946 0952", [("phone", "＋44 20 7946 0952")]),
    ("Model 925-19-994 replaces drawing 7946-0514, invoice 2004/30662, IP 10.10.0.0/16, build 10.4.46.4, USD 253812", []),
    ("passport X6265882TT, SSN 960-53-2929, QQ 20 01 99 C, 00 853 046 305, ZZ553080<9", [("id", "X6265882TT"), ("id", "960-53-2929"), ("id", "QQ 20 01 99 C"), ("id", "00 853 046 305"), ("id", "ZZ553080<9")]),
    ("lives at Flat 28, 103 Tevwood Lane, Port Medholm and", [("address", "Flat 28, 103 Tevwood Lane, Port Medholm")]),
    ("to P.O. Box 58, Kekwold. Or 21 Nolbrook Street, Fugwold QX1 4ZZ!", [("address", "P.O. Box 58, Kekwold"), ("address", "21 Nolbrook Street, Fugwold QX1 4ZZ")]),
    ("Nephurststraße 35, 00643 Stavhaven Wir", [("address", "Nephurststraße 35, 00643 Stavhaven")]),
    ("Enviar a Calle Naxley 117, 6º B. El", [("address", "Calle Naxley 117, 6º B")]),
    ("Livraison au 145 bis rue des Tuthursts, 00419 Fugwold.", [("address", "145 bis rue des Tuthursts, 00419 Fugwold")]),
    ("The Danmouth Road depot closes early.", []),
    ("Spoke to S. Kammoor's deputy; Dr. Kekström, Hana and Søren di Fodez", [("name", "S. Kammoor"), ("name", "Kekström, Hana"), ("name", "Søren di Fodez")]),
    ("Dear Mr Movquist,\nMałgorzata K. Nibheim and LUCA cover ana nibheim", [("name", "Movquist"), ("name", "Małgorzata K. Nibheim"), ("name", "LUCA"), ("name", "ana nibheim")]),
    ("Herr Unbekannter ruft an", [("name", "Unbekannter")]),
    ("", []), (None, []), ("  \n ", []),
]


@pytest.mark.parametrize(("text", "items"), CASES)
def test_items(text, items):
    assert [(k, text[a:b]) for a, b, k in find(text, LEXICON)] == items


def test_masked():
    assert masked("Dear Ana Nibheim, ring 020 7946 0812.", LEXICON) == "Dear [NAME], ring [PHONE]."
    assert masked(None, LEXICON) is None and masked("", LEXICON) == ""


def test_offsets_survive_every_disguise():
    text = "a​b x [at] y [dot] z ＠ end"
    form = normal_form(text)
    for i in range(len(form.text)):
        a, b = form.source(i, i + 1)
        assert 0 <= a <= b <= len(text)
    at = form.text.index("end")
    assert text[slice(*form.source(at, at + 3))] == "end"


def test_long_text():
    text = ("Every job begins with a walk round the site. " * 40_000) + "Write to ana@x.example."
    assert [text[a:b] for a, b, _ in find(text, LEXICON)] == ["ana@x.example"]
    find("1" * 100_000, LEXICON), find("(" * 20_000, LEXICON), find("A. " * 20_000, LEXICON), find("a@" * 20_000, LEXICON)


def test_frame(spark):
    people = spark.createDataFrame([("Ana", "Nibheim")] * 2 + [(None, " "), ("X1", "?"), ("Once", "Only")], "first_name string, last_name string")
    lexicon = lexicon_of(all_names(people))
    assert (lexicon.given, lexicon.surnames) == (frozenset({"ana", "once"}), frozenset({"nibheim", "only"}))
    assert lexicon_of(all_names(people), bound=3) is None
    docs = spark.createDataFrame([(1, "Ana and Ana Nibheim, Ana"), (2, None), (None, "Ana")], "doc_id long, text string")
    found = {(r.doc_id, r.kind, r.pii_text) for r in found_items(docs, people).collect()}
    assert found == {(1, "name", "Ana"), (1, "name", "Ana Nibheim"), (None, "name", "Ana")}


@pytest.mark.parametrize("phone", ["020 7946 0123, extension 4567", "020 7946 0123, extension 456789", "030/1234567, Durchwahl 123456", "020 7946 0123, ext. 456"])
def test_long_extensions(phone):
    text = f"Call {phone} now."
    assert [(k, text[a:b]) for a, b, k in find(text, LEXICON)] == [("phone", phone)]
    assert find(f"Call {phone}", LEXICON)[0][:2] == (5, 5 + len(phone))


@pytest.mark.parametrize(
    ("kind", "item"),
    [
        *(("email", e) for e in ("zo@firm[dot]example", "zo@firm (punkt) example", "zo [ at ] firm.example", "zo<at>firm.example", "zo{@}firm.example", "zo(At)firm.example", "zo (chez) firm.example", "zo[arroba]firm[.]example")),
        *(("phone", p) for p in ("two one two five five five three one four five", "SEVEN ONE TWO FIVE FIVE FIVE THREE ONE FOUR FIVE", "Oh two oh five five five three one four five", "nought two one five five five three one four five", "Fünf eins zwei drei vier eins zwei drei vier fünf")),
        *(("address", a) for a in ("12 Tevwood Crescent", "12 Tevwood Square", "12 Tevwood Mews", "12 Tevwood Walk", "Nephurstring 35", "Nephurstdamm 35", "Nephurstufer 35", "An der Nephurst 35", "Im Nephurst 3", "Zum Nephurst 3", "Unter den Linden 5", "B.P. 12", "BP 12", "Avda. Nephurst, 3", "Camino Nephurst 3", "Ronda Nephurst 3")),
        *(("address", a) for a in ("3 place Nephurst", "3, allée des Nephurst", "3 cours Nephurst", "3 square Nephurst")),
    ],
)
def test_no_form_needs_another_hint(kind, item):
    text = f"It goes to {item}."
    assert [(k, text[a:b]) for a, b, k in find(text, LEXICON)] == [(kind, item)]


def test_titles_need_no_hint():
    assert masked("Mlle Unbekannt and Mx Unseen ring", LEXICON) == "Mlle [NAME] and Mx [NAME] ring"
    find("fİve ſix ſeven one two three four five six", LEXICON)


@pytest.mark.parametrize("bound", [100, 0])
def test_every_name_counts(spark, bound):
    people = spark.createDataFrame([("Ana", "Nibheim")] * 3 + [("Once", "Only"), ("Jo-Ann", "Kek"), (None, "")], "first_name string, last_name string")
    docs = spark.createDataFrame([(1, "Once Only met Ana Nibheim's heir, once."), (1, "Ann-Jo Kek; Ana-Ann, Only, Ana"), (2, None), (None, "Once Only met Ana Nibheim's heir, once."), (3, "")], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.kind, r.pii_text) for r in found_items(docs, people, bound=bound).collect())
    assert found == sorted([*((d, "name", n) for d in (0, 1) for n in ("Once Only", "Ana Nibheim")), (1, "name", "Ann-Jo Kek"), (1, "name", "Ana-Ann"), (1, "name", "Only, Ana")])
    hidden = sorted((r.doc_id or 0, r.masked or "") for r in with_masked(docs, people, bound=bound).collect())
    assert hidden == sorted([(0, "[NAME] met [NAME]'s heir, once."), (1, "[NAME]; [NAME], [NAME]"), (1, "[NAME] met [NAME]'s heir, once."), (2, ""), (3, "")])
