import hashlib
import random
import re

import pytest

from rankloom.llm import pii

from .conftest import made

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_plain_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "00012.0.0.1", " ", ".", "-", "é", "12", "\n", "a@b.c@d.e", "4111111111111111", "+33 1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("mail john.doe at example dot com", "email", "john.doe at example dot com"),
        ("to jane(at)mail(dot)example(dot)org!", "email", "jane(at)mail(dot)example(dot)org"),
        ("аnna@exаmple.com", "email", "аnna@exаmple.com"),
        ("x bob@ex​ample.com y", "email", "bob@ex​ample.com"),
        ("user&#64;host&#46;com", "email", "user&#64;host&#46;com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("at 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
        ("１９２.１６８.1.1", "ip", "１９２.１６８.1.1"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card 4111 1111 1111 11l1.", "card", "4111 1111 1111 11l1"),
        ("at 192 dot 168 dot 1 dot 1 here", "ip", "192 dot 168 dot 1 dot 1"),
        ("at 192.168.one.one here", "ip", "192.168.one.one"),
        ("mail john@example dot com now", "email", "john@example dot com"),
        ("四 four " + "one " * 15 + "end", "card", "four " + "one " * 14 + "one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    plain, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in plain] == [(kind, found)]
    assert pii.masked(text) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["look at polka dot dresses", "contact us at example.com today", "one two three", "un deux trois quatre", "they met at noon, the dot on the map", "Élan vital – the “one”", "2 + 2 = 4", "look-at-me.com", "a|b|c 1|2", ""])
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == ([], [])


def test_plain_texts_gain_nothing():
    text = "Write to thin.27@mail6.example.com or +1 (017) 555-7713; 97.51.17.173, 7536784127813050."
    plain, spans = pii.all_spans(text)
    assert plain == spans and len(plain) >= 3


def test_report(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.base_sha256, r.spans) for r in pii.report(odd).collect())
    want = sorted((str(i), hashlib.sha256(pii.joined(brute(t)).encode()).hexdigest(), pii.joined(pii.all_spans(t)[1])) for i, t in rows)
    assert got == want
    assert pii.report(none).count() == 0


def test_redacted_keeps_columns(spark, odd, none):
    docs = odd.limit(1).unionByName(made(spark, [(1, "to a@b.cd and c [at] d [dot] com", "s")]))
    rows = {r.text: r for r in pii.redacted(docs).collect()}
    assert "to <EMAIL> and <EMAIL>" in rows and rows["to <EMAIL> and <EMAIL>"].n_chars == 22
    assert pii.redacted(docs).columns == odd.columns and pii.redacted(none).count() == 0


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1((" * 60_000, "a@" * 100_000, "one two " * 40_000, "x at " * 50_000 + "dot", "[at" * 60_000, "1." * 100_000):
        pii.all_spans(text)


def test_partly_spelled_numbers_and_more_endings():
    for text, kind in [("card 4111 1111 1111 11 one one now", "card"), ("card 4111 1111 1111 111 one now", "card"), ("call +49 30 1234 five six now", "phone"), ("write jan at host dot xyz now", "email"), ("write jan at host dot gr now", "email")]:
        span = max(pii.all_spans(text)[1], key=lambda s: s[2] - s[1])  # "+49 30 1234" is a phone number by itself
        assert span[0] == kind and text[span[1] : span[2]] == text.split(" ", 1)[1][: -len(" now")], (text, span)
    for text in ["one of 12 two or 3 things", "look at the dot matrix", "we came at this point to rest", "in 2019 one 4 two"]:
        assert not pii.all_spans(text)[1], text
