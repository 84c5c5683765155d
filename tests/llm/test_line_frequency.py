import random
import re

from tallyloom.llm import line_frequency as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_figures_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(0, None, None), (1, "a", ""), (2, "a", " \n\t"), (3, None, "x " * 40), (3, None, "x " * 40), (4, "a", "é# b c\n" * 30)]
    for i in range(5, 200):
        rows.append((i, r.choice("ab"), "".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "\x1c", "日"]) for _ in range(r.randint(0, 300)))))
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n_words", "'z' as lines")
    got = sorted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in L.line_verdicts(frame).collect())
    assert got == sorted((i, *brute(t)) for i, _, t in rows)


def test_common_lines_are_counted_by_distinct_text_and_removed(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = prose(30)
    rows = [(i, "a", f"{prose(25)}\n{shared}") for i in range(60)] + [(100 + i, "b", f"{prose(25)}\n{shared}") for i in range(5)]
    rows += [(200, "a", shared + "\n" + prose(3))] + [(300 + i, "a", "only copies of this text, " * 3 + prose(0) + " one two three four five six seven eight nine ten") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in L.line_verdicts(frame, limit=50, share=0.02).collect()}
    assert got[0].kept and got[0].n_common_lines == 1 and got[0].n_left_words == 25
    assert got[100].n_common_lines == 0 and got[100].kept
    assert not got[200].kept and not got[200].base_failed
    assert got[300].n_common_lines == 0
    texts = {x.doc_id: x.text for x in L.without_common_lines(frame, limit=50, share=0.02).collect()}
    assert shared not in texts[0] and shared in texts[100] and len(texts) == len(rows)
    assert L.line_verdicts(frame.limit(0)).count() == 0


def test_a_line_does_not_get_rarer_as_its_host_grows(spark):
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, small = prose(30), prose(30)
    rows = [(i, "big", f"{prose(25)}\n{shared}" if i < 60 else prose(25)) for i in range(4000)] + [(9000 + i, "tiny", f"{prose(25)}\n{small}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in L.line_verdicts(frame).collect()}
    assert all(got[i].n_common_lines == (i < 60) for i in range(4000)) and all(got[9000 + i].n_common_lines == 1 for i in range(12))


def test_copies_count_by_id_and_repeated_rows_do_not(spark):
    copy, again, bare = ("one line that " + w + " two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen" for w in ("copies", "rows", "nulls"))
    rows = [(i, "a", copy) for i in range(60)] + [(100, "a", again)] * 60 + [(None, "a", bare)] * 60 + [(1000 + i, "a", f"own{i}") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in L.line_verdicts(frame, by_id=True).collect()}
    assert got[0].n_common_lines == 1 and not got[0].kept
    assert got[100].n_common_lines == 0 and got[100].kept and got[None].n_common_lines == 0
