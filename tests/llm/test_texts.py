"""Text forms, personal data, broken pairs: golden cases."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import p5_pairs as P5
from tideline.llm.pii_detect import entity, find
from tideline.llm.textforms import consistent, has_lookalikes, skeleton, words

NAMES = frozenset({"alina", "olga", "mark", "grace", "hope"})


def test_cases_become_consistent():
    for dirty, clean in {
        "Ｆａｃｔ： ５０％": "Fact: 50%", "café": "café", "Daﬁna": "Dafina", "re​port": "report", "re­port": "report", "a b": "a b", "a　b": "a b",
        "wоrd": "word", "rаtiοn": "ration", "fօr": "for", "Trɑin": "Train", "стaнции": "станции", "cоp": "cop", "﻿Start": "Start",
    }.items():
        assert consistent(dirty) == clean, dirty
        assert skeleton(dirty) == skeleton(clean)


def test_what_is_no_case_stays():
    for t in ["Внимание: Фонд", "Καλημέρα", "👩‍⚕️ ok", "می‌کند", "据东砚消息，26,896张！", "line\nbreak  two", "“curly” … 2º &amp; é", "plain", ""]:
        assert consistent(t) == t
    assert consistent(None) is None and skeleton(None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_consistent_is_stable(t):
    once = consistent(t)
    assert consistent(once) == once
    assert unicodedata.normalize("NFC", once) == once or "יִ" <= max(once, default="a")


def test_words():
    assert words("See HTTPS://x.y/z @User_1, it's 5.5% ﬁne") == ["see", "it", "s", "5", "5", "fine"]
    assert words(None) == [] and words("") == []


def kinds(text):
    return [(k, text[s:e]) for k, s, e in find(text, NAMES)]


def test_personal_data_is_found():
    for text, expected in {
        "Write to a.b+c@mail.x.example now": ("email", "a.b+c@mail.x.example"), "use tom [at] x [dot] co [dot] example;": ("email", "tom [at] x [dot] co [dot] example"), "use tom at x dot test for this": ("email", "tom at x dot test"),
        "Call (415) 555-0119 tonight": ("phone", "(415) 555-0119"), "rang from 2025550180 again": ("phone", "2025550180"), "tel +44 7700 900734;": ("phone", "+44 7700 900734"), "tel 01 99 00 21 60;": ("phone", "01 99 00 21 60"),
        "text six four six, five five five, oh one eight four now": ("phone", "six four six, five five five, oh one eight four"), "text 030/23125-515 if": ("phone", "030/23125-515"), "al 0033199 0012 39 ya": ("phone", "0033199 0012 39"),
        "SSN 666-48-2238.": ("id_number", "666-48-2238"), "ssn:666182474;": ("id_number", "666182474"), "NI number QQ 96 58 34 C;": ("id_number", "QQ 96 58 34 C"), "DNI 00099281-A": ("id_number", "00099281-A"), "passport no. XZ7666252;": ("id_number", "XZ7666252"), "driver licence D000-1974-3052;": ("id_number", "D000-1974-3052"),
        "lives at 295 Priath Street.": ("address", "295 Priath Street"), "at 331 skortlow blvd after dark": ("address", "331 skortlow blvd"), "at Grildstraße 51 by mistake": ("address", "Grildstraße 51"), "en Calle Lask 136, 2º B;": ("address", "Calle Lask 136, 2º B"), "at 82 bis rue de Vathbrook, Nona.": ("address", "82 bis rue de Vathbrook, Nona"),
        "A nurse named ALINA FASKSAK told us": ("name", "ALINA FASKSAK"), "signed by Zuri Tamby;": ("name", "Zuri Tamby"), "Ask Kilworth, Olga about it": ("name", "Kilworth, Olga"), "neighbour Wren Tam-Sold counted them": ("name", "Wren Tam-Sold"), "I saw Olga K. Tamby there": ("name", "Olga K. Tamby"),
    }.items():
        assert expected in kinds(text), (text, kinds(text))


def test_what_is_no_personal_data():
    for text in ["Check form 1040-7.", "Check ticket #90771233.", "Check lot 77-0900-12.", "bill HR 2055-0143", "Highway 41", "version 3.12.4", "batch 4410-55-01437.", "docket 20-4417-CV", "count of 5,550,143", "202:55 ratio", "RT @olga_k: hi", "Senator Goumworth of Mark Landing", "Ask Judge Stock why.", "went to Grace Harbor", "owns 27 companies that sell street cameras"]:
        assert kinds(text) == [], text
    assert find(None) == [] and find("") == []


def test_coreference():
    assert entity("name", "YARA MIAV") == entity("name", "Miav, Yara") == "yara miav"
    assert entity("email", "a [at] b [dot] c") == entity("email", "A@b.c")
    assert entity("phone", "two oh two, five five five") == "202555"


def test_defects():
    given = "Crime near banks dropped 5% once Xora hired 12 dockers. Even voters know it."
    assert P5.is_copy("The claim is: " + given, given) and P5.is_copy(given.lower()[:-1], given)
    assert not P5.is_copy(given[:40], given) and not P5.is_copy("The sentence “" + given + "” is quite specific.", given) and not P5.is_copy("x", None)
    assert P5.is_refusal("I'm sorry, but I can't help with that.") and P5.is_refusal("Sorry, this content goes against my guidelines.")
    assert not P5.is_refusal("I cannot confirm the number myself, but X publishes the survey every year.") and not P5.is_refusal("Officials refused to comment, yet the memo is on file.")
    assert P5.answers_in_other_language("Les élèves de X ont reçu 6 repas de moins que ceux de Y", given)
    assert not P5.answers_in_other_language("The statement names X and gives a figure of 5.", given)
    assert P5.reasoning_of('{"reasoning": "cut her') == ("cut her", True) and P5.reasoning_of('{"reasoning": "a"}') == ("a", False) and P5.reasoning_of(None) == (None, False)
    assert P5.open_delimiters("a (b “c” d") == 1


def test_suffix_automaton_coverage():
    a = P5.SuffixAutomaton("a b c d e".split())
    assert a.copied("x b c y d e".split()) == 4 and a.copied("q w".split()) == 0 and a.copied([]) == 0


def test_skeletons_of_originals():
    for a, b in (("paypal", "paypa1"), ("PayPaI", "PayPal"), ("corn", "com"), ("O", "0"), ("ｆｕｌｌ", "full"), ("pаypаl", "paypal"), ("cafe\u0301", "café"), ("ﬁne", "fine"), ("ᎪB", "AB"), ("a\u200bb", "ab"), ("a\u00a0b", "a b")):
        assert skeleton(a) == skeleton(b), (a, b)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("north") != skeleton("south")


@given(st.text(st.sampled_from("aаοο0OlI1m рс\u0301é\u200dñｗ ﬁ中Ꭺбж\u00a0"), max_size=30))
def test_a_form_has_its_texts_skeleton_and_no_difference_escapes_it(t):
    form, bones = consistent(t), skeleton(t)
    assert skeleton(form) == bones
    assert form == t or has_lookalikes(t, bones)
