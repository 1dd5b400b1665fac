import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvidex.operators import jobs, sequence as S


@pytest.fixture(scope="module")
def query():
    return S.made_up(1, 120)


@pytest.fixture(scope="module")
def targets(spark, query):
    """Fifty proteins; five are the query with 0 to 20 % of its residues changed, one has a run of Q."""
    rng = random.Random(5)
    rows = []
    for k in range(50):
        if k < 5:
            s = list(query)
            for i in rng.sample(range(len(s)), int(len(s) * (0, 0.02, 0.05, 0.1, 0.2)[k])):
                s[i] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
            s = "".join(s)
        elif k == 5:
            s = S.made_up(99, 40) + "Q" * 30 + S.made_up(98, 40)
        else:
            s = S.made_up(k + 1000, 60 + 3 * k)
        rows.append((k, s))
    return spark.createDataFrame(rows + [(50, None), (51, ""), (52, "MK")], "doc_nr long, seq string")


def test_search(targets, query):
    got = S.blast(targets, query, S.Parameters(mask=False)).collect()
    first = got[0]
    assert first["doc_nr"] == 0 and first["identity"] == len(query) == first["q_to"] - first["q_from"] and first["gaps"] == 0
    assert [r["doc_nr"] for r in got[:5]] == sorted(range(5), key=lambda d: -next(r["score"] for r in got if r["doc_nr"] == d))
    assert {0, 1, 2, 3, 4} <= {r["doc_nr"] for r in got}
    for r in got:
        assert r["expect"] <= 10 and len(r["q_line"]) == len(r["midline"]) == len(r["s_line"])
        assert sum(a == b for a, b in zip(r["q_line"], r["s_line"])) == r["identity"] <= r["positive"]
        score = sum(-12 if (a == "-" or b == "-") and (i == 0 or "-" not in (r["q_line"][i - 1], r["s_line"][i - 1])) else -1 if "-" in (a, b) else int(S.blosum62()[ord(a), ord(b)]) for i, (a, b) in enumerate(zip(r["q_line"], r["s_line"])))
        assert score == r["score"]
    assert S.report_xml(targets.sparkSession.createDataFrame(got)).first()["value"].startswith("<Hit><Hit_id>0</Hit_id><Hsp><Hsp_score>")


def test_a_gap_is_found(spark, query):
    gapped = query[:60] + query[64:]
    r = S.blast(spark.createDataFrame([(1, gapped)], "doc_nr long, seq string"), query, S.Parameters(mask=False)).first()
    assert r["gaps"] == 4 and r["identity"] == len(gapped) and r["score"] == sum(int(S.blosum62()[ord(c), ord(c)]) for c in gapped) - 15


def test_options(targets, query):
    only = targets.where("doc_nr in (2, 3)").select("doc_nr")
    assert {r["doc_nr"] for r in S.blast(targets, query, S.Parameters(), only).collect()} == {2, 3}
    assert S.blast(targets, query, S.Parameters(limit=2)).count() == 2
    assert all(r["gaps"] == 0 for r in S.blast(targets, query, S.Parameters(gapped=False)).collect())
    for bad in ({"word": 5}, {"matrix": "NOSUCH"}, {"gap_open": 3}, {"program": "blastn"}):
        with pytest.raises(ValueError):
            S.Parameters(**bad)
    assert S.blast(targets.limit(0), query, S.Parameters()).count() == 0


def test_statistics_of_a_matrix():
    lam, k, h = S.karlin(S.blosum62())
    assert (round(lam, 4), round(k, 3), round(h, 4)) == (0.3176, 0.134, 0.4012)
    letters = "ARNDCQEGHILKMFPSTWYV"
    text = "   " + " ".join(letters) + "\n" + "\n".join(a + " " + " ".join(str(5 if a == b else -4) for b in letters) for a in letters)
    S.register_matrix("IDENTITY", text, {(11, 1): (0.3, 0.1, 1.0, 0.3, -3.0)})
    assert S.Parameters(matrix="identity").scores[ord("A"), ord("A")] == 5
    with pytest.raises(ValueError):
        S.Parameters(matrix="identity", gap_open=10)


def test_an_own_matrix_reaches_the_workers(spark, query):
    r = S.blast(spark.createDataFrame([(1, query)], "doc_nr long, seq string"), query, S.Parameters(matrix="IDENTITY", mask=False)).first()
    assert r["score"] == 5 * len(query)


def test_neighbours(query):
    p, m = S.Parameters(), S.blosum62()
    words = S.neighbours(query[:20], p)
    for w, places in words.items():
        for i in places:
            assert sum(int(m[ord(a), ord(b)]) for a, b in zip(w, query[i : i + 3])) >= 11
    assert sum(map(len, words.values())) == sum(sum(int(m[ord(a), ord(b)]) for a, b in zip(x + y + z, query[i : i + 3])) >= 11 for i in range(18) for x in S._ORDER for y in S._ORDER for z in S._ORDER)


def test_masks(spark):
    low = "MKVLAEDRTW" + "Q" * 30 + "MSTNPKHQWKTCRNDAEFYPQIVS"
    got = S.seg_text(low)
    assert len(got) == len(low) and "X" * 28 in got and got.startswith("MKVL") and got.endswith("YPQIVS")
    assert all(a in (b, "X") for a, b in zip(got, low))
    assert S.seg_text("ACDEFGHIKL") == "ACDEFGHIKL" and S.seg_text(None) is None and S.seg_text("") == ""
    dna = "ACGTTGCATGCCTAGA" * 3 + "A" * 50
    assert S.dust_text(dna).endswith("X" * 30)
    row = spark.createDataFrame([(low, dna), (None, None)], "p string, n string").select(S.seg(F.col("p")).alias("p"), S.dust(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in row] == [(got, S.dust_text(dna)), (None, None)]
    assert S.entropy("AABB") == 1.0


def test_queue(targets, query):
    q = jobs.Queue(lambda db: targets if db == "t" else 1 / 0, lambda db, f: targets.where(f).select("doc_nr"))
    a, b = q.submit("t", query), q.submit("t", query.lower())
    assert a == b and q.status(99) == jobs.UNKNOWN
    assert q.result(a, 120)[0]["doc_nr"] == 0 and q.status(a) == jobs.FINISHED
    c = q.submit("t", query, filter="doc_nr = 3")
    assert {r["doc_nr"] for r in q.result(c, 120)} == {3}
    bad = q.submit("nosuch", query)
    with pytest.raises(RuntimeError):
        q.result(bad, 120)
    assert q.status(bad) == jobs.ERROR and q.submit("nosuch", query) != bad


def test_published_scores_of_ambiguous_residues():
    m = S.blosum62()
    at = lambda a, b: int(m[ord(a), ord(b)])
    assert (m == m.T).all()
    assert [at("X", c) for c in "ASTCPWRX*"] == [0, 0, 0, -2, -2, -2, -1, -1, -4]
    assert [at("B", c) for c in "NDBZX"] == [3, 4, 4, 1, -1] and [at("Z", c) for c in "QEZBX"] == [3, 4, 4, 1, -1]
    assert at("*", "*") == 1 and at("*", "A") == -4 and at("U", "C") == 9


def test_public_matrices_from_files(spark, tmp_path):
    letters = "ARNDCQEGHILKMFPSTWYVBZX*"
    text = "# made up\n   " + "  ".join(letters) + "\n" + "\n".join(a + " " + " ".join(str(7 if a == b else -3) for b in letters) for a in letters)
    (tmp_path / "PAM30").write_text(text)
    S.load_matrix(spark, str(tmp_path / "PAM30"), "PAM30")
    p = S.Parameters(matrix="pam30", gap_open=9)
    assert p.scores[ord("W"), ord("W")] == 7 and p.statistics[p.costs][:3] == (0.294, 0.11, 0.61) and p.statistics[0, 0][0] == 0.34
    with pytest.raises(ValueError):
        S.Parameters(matrix="PAM30")


def test_extensions_against_loops(query):
    """Ungapped extension residue by residue, and gapped extension by the whole table, as no drop cuts it off."""
    import numpy as np

    m, rng = S.blosum62(), random.Random(3)
    code = lambda x: np.frombuffer(x.encode(), np.uint8)
    p = S.Parameters()
    for _ in range(150):
        a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(8, 60)))
        b = "".join(x if rng.random() < 0.7 else rng.choice("ACDEFGHIKLMNPQRSTVWY") for x in a)[rng.randint(0, 5) :] + "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 9)))
        i = rng.randint(0, len(a) - 4)
        d = rng.randint(-3, 3)
        if i + d < 0 or i + d + 4 > len(b):
            continue
        score, start, end = sum(int(m[ord(a[x]), ord(b[x + d])]) for x in range(i, i + 4)), i, i + 4
        run = score
        for x in range(i + 4, min(len(a), len(b) - d)):
            run += int(m[ord(a[x]), ord(b[x + d])])
            if run > score:
                score, end = run, x + 1
            if score - run > 16:
                break
        run = score
        for x in range(i - 1, max(0, -d) - 1, -1):
            run += int(m[ord(a[x]), ord(b[x + d])])
            if run > score:
                score, start = run, x
            if score - run > 16:
                break
        assert S._ungapped(m, code(a), code(b), i, i + 4, d, 16) == (score, start, end)

        low = -(10**9)
        h = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
        e, f = [r[:] for r in h], [r[:] for r in h]
        best = 0
        for x in range(len(a) + 1):
            for y in range(len(b) + 1):
                e[x][y] = max(h[x][y - 1] - 12, e[x][y - 1] - 1) if y else low
                f[x][y] = max(h[x - 1][y] - 12, f[x - 1][y] - 1) if x else low
                h[x][y] = 0 if x == y == 0 else max(e[x][y], f[x][y], h[x - 1][y - 1] + int(m[ord(a[x - 1]), ord(b[y - 1])]) if x and y else low)
                best = max(best, h[x][y])
        got = S._gapped(m, code(a), code(b), p, 10**6)
        assert got[0] == best and (sum(u for u, _ in got[3]), sum(v for _, v in got[3])) == got[1:3]
        assert S._gapped(m, code(a), code(b), p, 64)[0] <= best


def test_word_hits_against_lookups(query):
    p = S.Parameters()
    words = S.neighbours(query, p)
    target = query[:50] + "*x" + S.made_up(8, 200)
    want = {}
    for j in range(len(target) - 2):
        for i in words.get(target[j : j + 3], ()):
            want.setdefault(j - i, []).append(i)
    import numpy as np

    got = {int(r[0]): r[1:].tolist() for r in S._word_hits(np.frombuffer(target.encode(), np.uint8), p, S.word_table(words, 3))}
    assert got == {d: sorted(i) for d, i in want.items() if max(i) - min(i) >= 3} and len(got) > 3


def test_the_limit_counts_hits(spark, query):
    """A hit with two HSPs is one; both are returned."""
    twice = query[:50] + S.made_up(77, 60) + query[70:]
    rows = spark.createDataFrame([(1, query), (2, twice), (3, S.made_up(5, 90))], "doc_nr long, seq string")
    one, two = (S.blast(rows, query, S.Parameters(mask=False, gapped=False, limit=n)).collect() for n in (1, 2))
    assert {r["doc_nr"] for r in one} == {1} and [r["doc_nr"] for r in two if r["doc_nr"] == 2] == [2, 2]
    assert [r["doc_nr"] for r in two] == sorted(r["doc_nr"] for r in two)


def test_dust_is_spread_and_works_out_a_sequence_once(spark):
    """One file of short rows was one task, and each row was masked by itself."""
    import __spark_entry__ as entry

    assert entry.queries()["dust_mask"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
    asked = []
    got = S._each(pd.Series(["b", None, "a", "b", ""], [4, 7, 1, 0, 2]), lambda x: asked.append(x) or x + "!")
    assert got.to_dict() == {4: "b!", 7: None, 1: "a!", 0: "b!", 2: "!"} and sorted(asked) == ["", "a", "b"]


def test_proteins_are_spread(spark):
    import __spark_entry__ as entry

    assert entry.queries()["seg_mask"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_long_segments_are_trimmed_whole():
    got = S.seg_text(S.made_up(3, 40) + "Q" * 120_000 + S.made_up(4, 40))
    assert "X" * 119_990 in got
