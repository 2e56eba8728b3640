"""Tokenising, statistics, rules, classifier, personal data, mixing and pages against plain Python and libraries."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, classifier, html_main, mixing, pii, queries, rules, stats, token_files

ODD = [
    "", None, "  ", "a\n\n b", "x   y  ", "it's   we'll 12345 日本語 ß  z \x1c\x1d a\x85b", "=" * 3000, "ab" * 600 + " c", "\U0001f600 \U0001f468‍\U0001f469 é", "<|endoftext|> hi",
    "　 x\t\t y\r\n\r\n z", "Ａ１² ½ ௧ Ⅷ", "İ ſ 'S 'll'LL ΑΣ", "é é", "The cat sat.\nThe cat sat.\n", "w " * 400, "\x01\x02 4111111111111111 \x03",
]


def table(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], "doc_id long, text string, k0 string, word string").repartition(3)


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = bpe.encode(table(spark), path, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "k0", "word", "ids"]
    got = {r["doc_id"]: r for r in out.withColumn("bytes", bpe.decode(F.col("ids"), path)).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["ids"] == plain.encode_ordinary(t or ""), t
        assert bytes(got[i]["bytes"]) == (t or "").encode()
    assert bpe.encode(table(spark).limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_plans_do_not_spell_out_the_vocabulary(spark):
    """The driver keeps the text of each plan that has run."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    docs = table(spark).withColumn("pieces", F.lit(1))
    out = bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), path, ["doc_id", "pieces"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000 and " AS rank_" not in plan and " AS _pieces" not in plan  # no row holds a constant
    got = {r["doc_id"]: (r["pieces"], r["n_tokens"], r["decoded_sha256"]) for r in out.collect()}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    assert got == {i: (1, len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(ODD)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    texts = [found.apply(k).physicalPlanDescription() for k in range(before, found.size())]
    assert texts and max(map(len, texts)) < 50_000


def test_blocks_start_afresh(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 2)
    monkeypatch.setattr(bpe, "HAND_OVER", 1)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    test_byte_bpe(spark)


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(7 * i % 101, t) for i, t in enumerate(ODD)] + [(7, "again"), (None, "null")], "doc_id long, text string").repartition(4)
    manifest = token_files.write(docs, path, 2)
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    want = collections.Counter()
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert token_files.read(token_files.write(docs.limit(0), path, 2)).count() == 0


def plain_stats(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_statistics(spark):
    texts = [*ODD, "a b c d e f g h a b c d e f g h i", "a b c d e f g h a", " ".join("abcdefghijab" * 5), "#|\n#|\n \n#|", "a b c d e f g h x a b c d e f g h y b c d e f g h y b"]
    got = {r["doc_id"]: r for r in stats.base(table(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in stats.BASE) == plain_stats(t), t


def quality(spark):
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(list("aeilnorst"), rng.integers(2, 9))) for _ in range(60)]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + ("###" if bad else "") for w in words) + ".", "s"))
        labels += [(i, 0 if bad else 1)] if i % 3 else []
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels + [(None, 1), (5, None), (10**6, 1)], "doc_id long, quality int")


def test_rules(spark):
    docs, labels = quality(spark)
    rows = stats.shape(docs.unionByName(spark.createDataFrame([(900, None, "s"), (901, "", "s")], docs.schema)), ["doc_id"])
    learned = rules.learn(rows, labels)
    assert 1 <= len(learned.rules) <= 3 and str(learned).startswith("bad if ")
    got = {r["doc_id"]: r for r in rules.judged(rows, learned).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) and not got[i]["base_failed"] for i in range(400))
    assert got[900]["base_failed"] and not got[901]["kept"]
    none = rules.learn(rows, labels.limit(0))
    assert none.rules == [] and rules.judged(rows, none).filter("kept").count() == 400


def test_classifier(spark):
    docs, labels = quality(spark)
    rows = stats.shape(docs, ["doc_id"])
    model = classifier.fit(rows, labels)
    got = {r["doc_id"]: r for r in classifier.scored(rows, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([got[i]["predicted"] == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    x = np.array([list(r) for r in rows.orderBy("doc_id").select(*classifier.features()).collect()])
    t = model.offset + model.slope * model.densities(x)
    assert np.allclose([got[i]["score"] for i in range(400)], 1 / (1 + np.exp(-np.clip(t, -500, 500))))
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.fit(rows, changed)
    assert np.allclose(model.means, again.means)  # held-out labels are not looked at
    assert classifier.scored(rows, classifier.fit(rows, labels.limit(0))).filter("score != 0.5").count() == 0


def plain_base(t):
    luhn = lambda d: sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    found += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)


def test_personal_data(spark):
    texts = [
        *ODD, "a@b.c_d@e.f x@y..z q@r.s.", "1.2.3.4.5 256.1.1.1 001.2.3.4 é 10.0.0.1", "4111 1111 1111 1111 41111111111111112 4111-1111-1111-1111 1 2 3", "+1 (988) 555-2485 +12 +1234567890123456 ++49 30 1234567.",
        "a.b@c-d.e.f.g-h+@x.y", "\U0001f600 a@b.co 1.1.1.1", "1" * 3000, "1 " * 900, "a@b" + ".c" * 800, "x" * 5000 + "@",
    ]
    mail = [f"please write to user{i}@mail.example now" for i in range(12)] + [f"please write to XK-{i}93-ZZ81{i} now" for i in range(3)] + [f"version number {i}.0.77777{i}-b only here" for i in range(5)]
    got = {r["doc_id"]: r for r in pii.personal_data(table(spark, texts + mail)).collect()}
    for i, t in enumerate(texts + mail):
        want = plain_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, got[i]["spans"])
        assert got[i]["spans"].startswith(want) and [got[i][f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]
    found = [i for i in range(len(texts), len(texts + mail)) if pii.FOUND in got[i]["spans"]]
    assert found == list(range(len(texts) + 12, len(texts) + 15))  # what stands where addresses stand
    assert pii.personal_data(table(spark).limit(0)).count() == 0


def test_mixing(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("w" * int(rng.integers(1, 60))), ["a", "b", None, "c"][min(3, int(rng.integers(0, 9)) // 2)], "x", 0) for i in range(300)]
    rows += [(300, None, "b", "x", 0), (301, "", "b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, base string, size int")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(got) == 302 and got[300]["taken"] == 0 and got[5]["base"] == "x"
    path = str(tmp_path / "d.parquet")
    docs.select("doc_id", "text", "source").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    for r in con.sql(queries.ORACLE_SQL["op10_source_mixing"]).df().itertuples():
        g = got[r.doc_id]
        assert (g["size"], g["source_size"], g["taken"]) == (r.size, r.source_size, r.taken) and abs(g["target"] - r.target) < 1e-6
    by = collections.defaultdict(int)
    for g in got.values():
        by[g["source"], g["target"]] += g["taken"]
    assert all(abs(n - t) <= 60 for (_, t), n in by.items())
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(g["copies"] for g in got.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>\n three&nbsp;four<p>Five<script>x()</script><div class='share'>Share</div><aside>Ad</aside></article><section id='comments'><article><p>First!</p></article></section><form>Sign up</form><footer>&copy; x</footer>"
    rows = [(0, "http://a.b/x", page), (1, None, None), (2, "http://a.b/y", ""), (3, "u", "plain <p>text")]
    rows += [(10 + i, f"https://h.example/n/{i:02d}?q={i}", f"<body><div>Home page</div><p>Prose number {i} of the page.</p><p>{'More ' * i}text {i * 7}.</p><div>All of it ours</div>") for i in range(25)]
    rows += [(100, "https://h.example/n/03", rows[7][2])]
    got = {r["page_id"]: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got[0]["text"] == "Title & more\nOne two three four\nFive" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "" and got[2]["text"] == "" and got[3]["text"] == "plain\ntext"
    for i in range(25):
        assert got[10 + i]["text"] == f"Prose number {i} of the page.\n" + " ".join(f"{'More ' * i}text {i * 7}.".split())
    assert got[100]["text"] == got[13]["text"]


def test_longest_common():
    rng = np.random.default_rng(9)
    for _ in range(30):
        a, b = (rng.integers(0, 5, rng.integers(0, 9)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(html_main.longest_common(a, b)) == best[-1][-1]


def test_articles_are_differenced_too(spark):
    sign = "Read on with our daily letter."
    rows = [(i, f"http://h.example/a/{i:02d}", f"<body><div>Our site</div><article><p>Own prose {i} {'word ' * 9 * i}end.</p><p>{sign}</p>{'<p>A saying in two articles.</p>' if i in (3, 4) else ''}</article><p>Outside {i} is text.</p></body>") for i in range(12)]
    rows += [(100 + i, f"http://few.example/{i}", f"<article><p>Other prose {i * 7} {'some ' * (9 + i)}</p><p>{sign}</p></article>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(12):
        assert got[i].split("\n") == [" ".join(f"Own prose {i} {'word ' * 9 * i}end.".split()), *["A saying in two articles."] * (i in (3, 4)), f"Outside {i} is text."]
    assert all(got[100 + i].endswith(sign) for i in range(2))  # two pages don't make a template


def test_pages_amid_copies_lose_their_template(spark):
    menu, foot = "Home News Shop About us and more", "All of it ours, all rights kept"

    def page(own):
        return f"<body><div>{menu}</div><p>{own}</p><div>{foot}</div></body>"

    story = "A long story that many pages of this host print with hardly a word changed, " + "again and again " * 8
    rows = [(i, f"http://c.example/a/{i:03d}", page(f"{story}") if i % 2 else page(story) + f"<p>Seen {i} times</p>") for i in range(30)]  # near and exact copies
    rows += [(100 + i, f"http://c.example/b/{i:03d}", page(f"Short {i}")) for i in range(12)]  # mostly template
    rows += [(150 + i, f"http://c.example/c/{i:03d}", page(f"Page {i} has prose of its own, {'and more of it ' * (3 + i)}to its end.")) for i in range(8)]
    rows += [(200, "http://c.example/a/015x", page("One page of its own amid the copies, and with more text than its template has in all."))]
    rows += [(300, "http://alone.example/", page("Only page")), (301, None, "<p>x</p>"), (301, None, "<p>x</p>")]
    got = {}
    for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[i] == [story.strip() + ("" if i % 2 else f"\nSeen {i} times")] for i in range(30))
    assert all(got[100 + i] == [f"Short {i}"] for i in range(12))
    assert all(menu not in got[150 + i][0] and foot not in got[150 + i][0] and "prose" in got[150 + i][0] for i in range(8))
    assert got[200] == [rows[50][2].split("<p>")[1].split("</p>")[0]] and menu in got[300][0] and got[301] == ["x", "x"]
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
