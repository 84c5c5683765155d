import random
import re

from tallyloom.llm import pii_transducer as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], P.KINDS.index(x[0])))


def test_plain_rules_equal_brute_force():
    r = random.Random(3)
    for alphabet in ("ab@.-_ +1", "0123456789. -+()", "a@b.c_ 1", "+12 (3)-4.é@x"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert P.plain_spans(t) == brute(t), t
    t = "4111 1111 1111 1111 and 4111111111111111, +1 (555) 010-2345; 1.2.3.4.5.6.7.8 300.1.1.1 a.b@c.d@e.f"
    assert P.plain_spans(t) == brute(t) and len(P.plain_spans(t)) >= 5


def hidden(t):
    return [(k, t[s:e]) for k, s, e in P.hidden_spans(t, P.plain_spans(t))]


def test_disguises_map_back_to_source_characters():
    assert hidden("write to jane [at] mail (dot) example dot org please") == [("hidden_email", "jane [at] mail (dot) example dot org")]
    assert hidden("mail me: jane.doe at mail dot example dot com today") == [("hidden_email", "jane.doe at mail dot example dot com")]
    assert hidden("сard jоhn@ехample.com") == [("hidden_email", "jоhn@ехample.com")]
    assert hidden("call + one five five five, zero one zero, two three four five") == []
    assert hidden("card four one one one one one one one one one one one one one one one ok") == [("hidden_card", "four one one one one one one one one one one one one one one one")]
    assert hidden("１９２.168.0.１ is here") == [("hidden_ip", "１９２.168.0.１")]


def test_plain_text_and_edge_cases(spark):
    assert hidden("we met at the station at noon. one two three go") == []
    rows = [(1, None), (2, ""), (3, "a@b.co " * 2000), (4, "a@b.co"), (4, "a@b.co")]
    out = P.personal_spans(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as n_email")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 5 and got[1].spans == "" and got[1].base_sha256 == got[2].base_sha256
    assert got[3].n_email == 2000 and got[4].spans == "email:0:6"
    assert P.personal_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rewriting_round_trip():
    t = "x [at] y"
    w = P.Rewritten(t, [(1, 7, "@")])
    assert w.text == "x@y" and w.source(0, 3) == (0, 8) and w.source(1, 2) == (1, 7) and w.source(2, 3) == (7, 8)
    assert P.masked("a bb c", [("k", 2, 4)]) == "a <k> c"


def test_dots_plus_signs_and_bare_at_words():
    for t in ("192[.]168[.]1[.]1", "192 dot 168 dot 0 dot 1", "one nine two dot one six eight dot zero dot one", "192.168 (dot) one punkt 7"):
        assert hidden(f"host {t} is up") == [("hidden_ip", t)], t
    assert hidden("one nine nine nine dot one six eight dot zero dot one") == [] and hidden("900 dot 1 dot 1 dot 1") == []
    for t in ("plus four nine three zero one two three four five six seven", "plus 49 30 1234567", "plus four nine 30 1234567"):
        assert hidden(f"call {t} now") == [("hidden_phone", t)], t
    assert hidden("two plus three is five") == []
    for t in ("john dot smith at example.com", "x at mail.example dot com", "jane.doe at example.com", f"jane [at] {'a' * 200} dot com"):
        assert hidden(f"mail {t} today") == [("hidden_email", t)], t
    assert hidden("look at example.com") == []
