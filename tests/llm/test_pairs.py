"""Near-duplicate operators against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import components, embeddings, line_dedup, minhash


def closed(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(30)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed({i for x in links for i in x}, links)
    assert got == {i: c for i, c in want.items() if any(i in x and x[0] != x[1] for x in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = [" ".join(base)] * 3 + [" ".join(base).upper()]
    for n in (1, 2, 3, 4, 5, 6, 8, 12) * 4:
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    passage = " ".join(word() for _ in range(30))
    out += [f"{' '.join(word() for _ in range(60))} {passage}" for _ in range(20)]
    return out + ["a b", "A  b", "a\tb", "a b c", "", None, "  \n", "x", "é é é é é", "e e e e e e"]


def test_minhash(spark):
    rows = list(enumerate(texts(random.Random(2))))
    rows.append(rows[4])
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b c d", "y")], "doc_id long, text string, sketch string")
    for k in (4, 5):
        def shingles(t):
            w = (t or "").encode().lower().split()
            return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

        sets = {i: shingles(t) for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = closed(sets, links)
        got = minhash.near_duplicates(docs, k=k).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r["doc_id"] is None:
                assert r["kept"] and r["component_id"] is None
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = list(rng.standard_normal((150, 16)))
    for i in range(60):
        x.append(x[i % 5] + rng.standard_normal(16) * 0.08)
    x += [x[0], x[0] * 2, x[1] * 1e200, x[2] * 1e-300]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    u = np.stack([v / np.abs(v).max() for v in x])
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = [(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.95)) if a != b] + [(1006, 1007), (1007, 1006)]
    want = closed(got, links)
    for i, r in got.items():
        assert r["n_links"] == sum(a == i for a, _ in links) and r["component_id"] == want[i] and r["kept"] == (want[i] == i), i
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + rng.standard_normal((60, 8)) * 0.1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == dict(enumerate((u @ u.T >= 0.95).sum(axis=1) - 1))


def test_code_estimates_are_unbiased_and_bounded():
    c = embeddings.Codes(64, 1000, 0.95)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = rng.integers(0, 400, 20_000), rng.integers(0, 400, 20_000)

    def stored(x):
        packed, f, rounded, scale = c.code(x, np.arange(len(x)))
        assert packed.dtype == np.uint8 and packed.shape[1] == 8 and rounded.dtype == np.int8
        return np.unpackbits(packed, axis=1, count=64).astype(np.float32) * 2 - 1, f, rounded.astype(np.float32), scale

    signs, f, rounded, scale = stored(x)
    estimate = np.einsum("ij,ij->i", signs[i], rounded[j]) * scale[j] / (8 * f[i])
    assert abs(np.mean(estimate - np.einsum("ij,ij->i", x[i], x[j]))) < 0.01
    near = x + rng.standard_normal(x.shape) * 0.035
    near /= np.linalg.norm(near, axis=1)[:, None]
    both = np.concatenate([x, near])
    linked = np.einsum("ij,ij->i", x, near) >= 0.95
    assert embeddings.may_link(*stored(both), np.arange(400)[linked], np.arange(400, 800)[linked], 0.95).all()
    far = embeddings.may_link(signs, f, rounded, scale, i[i != j], j[i != j], 0.95)
    assert far.mean() < 0.2  # most pairs need no vectors


def test_longest_chain():
    rng = random.Random(6)
    for _ in range(50):
        p = rng.sample(range(30), 9)
        chain = line_dedup.longest_chain(p)
        best = max(bin(m).count("1") for m in range(512) if (q := [p[i] for i in range(9) if m >> i & 1]) == sorted(q))
        assert len(chain) == best and [p[i] for i in chain] == sorted(p[i] for i in chain)


def test_line_dedup(spark):
    line = lambda s, n=20: " ".join(f"{s}{i}" for i in range(n))
    a, b, c, short = line("a"), line("b"), line("c"), line("s", 4)
    rows = [
        (1, "\n".join([line("x"), a, b, c, short]), "k"),
        (2, "\n".join([line("y"), a, "", b, line("z"), short]), "k"),
        (3, "\n".join([a, line("w")]), "k"),  # a block of 20 words is too short
        (4, "\n".join([c, short, line("v"), f"  {a}\t", b]), "k"),  # moved blocks
        (5, "\n".join([line("x"), a, b, c, short]), "k"),
        (6, None, "k"), (7, "", "k"), (None, "\n".join([a, b]), "k"), (8, "\n".join([a, a, a, b]), "k"), (5, "\n".join([line("x"), a, b, c, short]), "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = line_dedup.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "gone", "n_lines_gone", "n_words_gone", "aligned_with"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["text"] == rows[0][1] and got[3][0]["text"] == rows[2][1] and got[6][0]["text"] is None and got[7][0]["text"] == "" and got[None][0]["n_lines_gone"] == 0
    assert got[2][0]["text"] == "\n".join([line("y"), "", line("z"), short]) and got[2][0]["aligned_with"] == [1]
    assert got[4][0]["text"] == "\n".join([c, short, line("v")]) and got[4][0]["n_words_gone"] == 40  # c and short have 24 words
    assert [r["text"] for r in got[5]] == ["", ""]
    assert got[8][0]["text"] == "\n".join([a, a])  # its last a and b follow each other as in document 1
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    assert docs.select(F.max("doc_id")).first()[0] == 8


def test_line_dedup_against_brute_force(spark):
    """Every line of a run of 25 words that a smaller doc_id has as well goes, and no other."""
    rng = random.Random(12)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.choice([3, 8, 14, 26]))) for i in range(40)]
    texts = {}
    for d in range(60):
        lines = []
        while len(lines) < rng.randrange(1, 30):
            at = rng.randrange(40)
            lines += pool[at : at + rng.randrange(1, 6)] if rng.random() < 0.5 else [rng.choice(["", " ", f"own {d} {len(lines)}", pool[at]])]
        texts[d] = "\n".join(lines)
    full = {d: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in texts.items()}

    def stretches(lines):
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b][1].split())
                if n >= 25:
                    yield a, b, tuple(x for _, x in lines[a : b + 1])
                    break

    seen, want = set(), {}
    for d in sorted(texts):
        lines = full[d]
        own = [*stretches(lines), *((len(lines) - 1 - b, len(lines) - 1 - a, x[::-1]) for a, b, x in stretches(lines[::-1]))]
        gone = {lines[k][0] for a, b, x in own if x in seen for k in range(a, b + 1)}
        seen |= {x for _, _, x in own} | {tuple(x for _, x in lines[a : b + 1]) for a in range(len(lines)) for b in range(a, len(lines))}
        want[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert {d: r["text"] for d, r in got.items()} == want and any(r["n_lines_gone"] for r in got.values())
    again = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs.unionByName(docs)).collect()}
    assert again == want  # repeated rows lose nothing to each other


def test_line_dedup_has_no_cap_on_frequent_short_lines(spark):
    line = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    passage = [line("p", 7), line("q", 10), line("r", 10)]
    rows = [(i, "\n".join([line(f"own{i}", 12), *passage])) for i in range(80)] + [(100 + i, "\n".join(passage)) for i in range(80)]
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_lines_gone"] == 0
    assert all(got[i]["text"] == line(f"own{i}", 12) and got[i]["aligned_with"] == [0] for i in range(1, 80))
    assert all(got[100 + i]["text"] == "" for i in range(80))


def test_line_dedup_finds_a_run_whose_lines_are_scattered_before(spark):
    line = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    a, b, tail, own = line("a", 15), line("b", 15), line("t", 4), [line(f"own{i}", 12) for i in range(6)]
    rows = [
        (1, f"{a}\n{own[1]}"), (2, f"{own[2]}\n{b}"), (3, f"{b}\n{own[3]}\n{a}"),  # both lines, never as a run
        (4, f"{own[4]}\n{a}\n{b}"), (5, f"{a}\n{b}\n{tail}\n{own[5]}"), (6, f"{own[0]}\n{a}\n{b}\n{tail}"),
    ]
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_lines_gone"] == 0 for i in (1, 2, 3, 4))
    assert got[5]["text"] == f"{tail}\n{own[5]}" and got[5]["aligned_with"] == [4]
    assert got[6]["text"] == own[0] and got[6]["aligned_with"] == [4, 5]  # the last line is in a block only with document 5


def test_tables_miss_no_more_than_they_should():
    rng = np.random.default_rng(7)
    for n in (10**4, 10**6, 10**7):
        c, missed = embeddings.Codes(64, n, 0.95), 0
        assert len(np.unique(c.chosen)) == c.chosen.size
        for _ in range(12):
            x, y = rng.standard_normal((2, 5_000, 64))
            x /= np.linalg.norm(x, axis=1)[:, None]
            y -= np.einsum("ij,ij->i", x, y)[:, None] * x
            y *= np.sqrt(1 - 0.95**2) / np.linalg.norm(y, axis=1)[:, None]
            missed += (c.buckets(x) != c.buckets(0.95 * x + y)).all(axis=1).sum()
        assert missed <= 60_000 * embeddings.MISS + 17, n  # three deviations above what is allowed


def test_tiles_count_as_sets_do():
    rng = np.random.default_rng(11)
    for first, second in ((0, 0), (0, 1)):
        sets = [np.unique(np.concatenate([rng.permutation(50)[:40], 1000 + rng.choice(9000, rng.integers(0, 4))])) for _ in range(40)]
        tile = {"value": [5] * 40, "first": [first] * 40, "second": [second] * 40, "block": [i % 2 * second for i in range(40)], "id": list(range(100, 140)), "component": [i // 3 for i in range(40)]}
        tile |= {"n": [len(s) for s in sets], "largest": [10**6] * 40, "values": [np.array(sorted({5, int(rng.integers(0, 12))})) for _ in range(40)], "set": sets}
        want = {i: i for i in range(40)}
        for i in range(40):
            for j in range(i):
                shared = set(tile["values"][i].tolist()) & set(tile["values"][j].tolist())
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if i // 3 != j // 3 and min(shared) == 5 and (first == second or i % 2 != j % 2) and 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((want[i], want[j]))
                    want = {k: a if v == b else v for k, v in want.items()}
        links = minhash.tile_links(tile, 70)
        got = {i: i for i in range(40)}
        for a, b in links:
            a, b = sorted((got[a - 100], got[b - 100]))
            got = {k: a if v == b else v for k, v in got.items()}
        assert got == want and len(links) == 40 - len(set(want.values())) and links
