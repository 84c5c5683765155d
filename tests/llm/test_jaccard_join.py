import random
import re

from tallyloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    low = {}
    for x in range(len(sets)):
        low[find(x)] = min(low.get(find(x), sets[x][0]), sets[x][0])
    return sorted((sets[x][0], len(sets[x][1]), low[find(x)]) for x in range(len(sets)))


def rows_of(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Solo"), (4, "solo"), (5, "two words"), (6, "TWO\twords"), (7, "a a a a a a"), (8, "a a a a")]
    boiler = [r.choice(vocab) for _ in range(25)]
    for _ in range(30):
        base = [r.choice(vocab) for _ in range(r.choice([8, 10, 12, 14, 20, 25, 40, 80, 200]))]
        if r.random() < 0.4:
            base += boiler
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randint(0, len(own) - 1)
                own[k : k + r.randint(0, 1)] = [r.choice(vocab)]
            rows.append((len(rows), " ".join(own)))
    chain = [r.choice(vocab) + str(k) for k in range(120)]
    for k in range(0, 40, 2):
        rows.append((len(rows), " ".join(chain[k : k + 80])))
    rows.append(rows[20])
    r.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE_PART", 2)
    for seed, width, num, den in ((1, 3, 90, 100), (2, 5, 8, 10)):
        rows = rows_of(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as node").repartition(5)
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in J.joined(frame, width, num, den).collect())
        assert got == brute(rows, width, num, den)
        if seed == 2:
            kept = sorted(x.doc_id for x in J.one_of_each(frame).collect())
            assert kept == sorted({i for i, _, c in brute(rows, width, num, den) if i == c})
    assert J.joined(frame.limit(0)).count() == 0


def test_large_group_of_near_copies_and_a_boundary_of_sizes(spark):
    r = random.Random(5)
    base = ["v%d" % r.randint(0, 10**6) for _ in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[50:])) for i in range(150)]
    rows += [(1000 + i, " ".join("u%d" % r.randint(0, 40) for _ in range(12))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in J.joined(frame).collect()) == brute(rows, 3, 90, 100)


def test_thresholds_and_subsets_find_every_link_of_small_sets():
    t = J.Threshold(90, 100)
    for n in range(1, 41):
        for m in range(n, 45):
            ok = [o for o in range(n + 1) if 100 * o >= 90 * (n + m - o)]
            assert (min(ok) if ok else None) == (t.overlap(n, m) if t.overlap(n, m) <= n else None)
            if ok and m <= 40 and n < m:
                assert set(t.subset_sizes(n, 40)) & set(t.subset_sizes(m, 40)) & set(range(1, min(ok) + 1))
