import hashlib
import random

from tallyloom.llm import exact_substrings as E


def brute(rows):
    n = E.LENGTH
    seen = {}
    bodies = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(bodies):
        for s in range(len(b) - n + 1):
            seen.setdefault(b[s : s + n], []).append((i, s))
    cover = [bytearray(len(b)) for b in bodies]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                cover[i][s : s + n] = b"\x01" * n
    out = []
    for (d, _), b, c in zip(rows, bodies, cover, strict=True):
        spans = sum(c[k] and (k == 0 or not c[k - 1]) for k in range(len(c)))
        out.append((d, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(b, c, strict=True) if not y)).hexdigest()))
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [prose(k) for k in (380, 399, 405, 430, 700, 1500)]
    rows = [(0, None), (1, ""), (2, "short")]
    for _ in range(50):
        parts = [prose(r.randint(0, 500))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 40)
            parts += [p[a : len(p) - r.randint(0, 40)], prose(r.randint(0, 300))]
        rows.append((len(rows), "".join(parts)))
    rows += [(len(rows), "xy" * 400), (len(rows) + 1, "z" * 450), (len(rows) + 2, rows[10][1]), rows[12], (13, "another text of id 13 " + prose(600))]
    rows += [(len(rows) + k, passages[4][:500] + prose(200)) for k in range(30)]
    return rows


def test_removal_equals_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 512), (2, 3)):
        monkeypatch.setattr(E, "HOT", hot)
        monkeypatch.setattr(E, "BLOCK", 16)
        rows = rows_of(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as th", "3 as n_bytes").repartition(4)
        assert sorted(tuple(x) for x in E.removed(frame).collect()) == brute(rows)
    assert E.removed(frame.limit(0)).count() == 0
