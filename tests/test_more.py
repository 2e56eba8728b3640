"""Insertion, archives, resuming, lists and questions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import __main__ as command
from lectern import options
from lectern.operators import enrich, html, insert, lists, questions, requests, resume, tags
from lectern.plans import prepare
from lectern.sources import archive, books


def test_insertion():
    page = '<html><body><nav><ol><li id="n"><a href="x">One</a></li></ol></nav><figure><figcaption>Cap</figcaption></figure><p id="a" class="c">Text <b id="b">bold</b><br>more</p><p>Same</p></body></html>'
    units = {u[4]: u[2] for u in html.units_of(html.parts_of(page, frozenset(), {}))}
    assert sorted(units.values()) == ["Cap", "One", "Same", "Text bold more"]
    done = insert.inserted(page, {k: v if v == "Same" else f"<{v}>" for k, v in units.items()}, style="color:red")
    assert '<a href="x">One<br/><span style="color:red">&lt;One&gt;</span></a>' in done and '<figcaption>Cap<br/><span style="color:red">&lt;Cap&gt;</span></figcaption>' in done
    assert '</p><p class="c" style="color:red">&lt;Text bold more&gt;</p><p>Same</p></body>' in done and done.count('id="a"') == 1
    single = insert.inserted(page, dict.fromkeys(units, "T"), single=True)
    assert single == '<html><body><nav><ol><li id="n"><a href="x">T</a></li></ol></nav><figure><figcaption>T</figcaption></figure><p id="a" class="c">T<b id="b"></b><br></p><p>T</p></body></html>'.replace("<br></p>", "</p>")
    assert insert.inserted("<body><p>a<ruby>b<rt>c</rt></ruby> d</p></body>", {2: "T"}, single=True) .count("<rt>") in (0, 1)
    assert insert.inserted(None, {1: "x"}) is None and insert.inserted("<p>a", {}) == "<p>a"


def test_insertion_of_tables(spark):
    pages = spark.createDataFrame([(1, "<body><p>a</p></body>"), (2, None), (3, "<body><p>b</p></body>")], "page_id long, html string")
    said = spark.createDataFrame([(1, 2, "A"), (1, 2, "A"), (3, 2, None)], "page_id long, owner int, translation string")
    got = {r["page_id"]: r["html"] for r in insert.insert_translations(pages, said).collect()}
    assert got == {1: "<body><p>a</p><p>A</p></body>", 2: None, 3: "<body><p>b</p></body>"}


def book(nav="", meta=""):
    content = books.epub_bytes("A title", [("a.xhtml", "<p>One</p>"), ("b.xhtml", "<p>Two</p>")], "de", "urn:1")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            data = old.read(n).decode()
            if n.endswith("nav.xhtml") and nav:
                data = nav
            if n.endswith(".opf"):
                data = data.replace("</metadata>", meta + "</metadata>")
            new.writestr(n, data)
    return out.getvalue()


def test_archive_is_rebuilt():
    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><span>Group</span><ol><li><a href="b.xhtml#x">Deep</a></li></ol></li></ol></nav></body></html>'
    source = book(nav, '<meta property="rendition:layout">pre-paginated</meta><link rel="record" href="r.xml"/><dc:creator id="c">Me &amp; you</dc:creator>')
    p = archive.package(source)
    assert archive.is_fixed_layout(p.metadata) and p.first("creator") == "Me & you" and len(p.spine) == 2
    assert list(archive.flat(archive.with_hrefs(p.contents))) == [(0, "Group", "OEBPS/b.xhtml#x"), (1, "Deep", "OEBPS/b.xhtml#x")]
    done = archive.rebuilt(source, {"OEBPS/a.xhtml": b"<html><body><p>Eins</p></body></html>", "unknown": b""}, "de")
    q = archive.package(done)
    assert b"Eins" in q.parts["OEBPS/a.xhtml"] and q.parts["OEBPS/b.xhtml"] == p.parts["OEBPS/b.xhtml"] and "unknown" not in q.parts
    assert q.parts["OEBPS/nav.xhtml"].decode() == nav  # contents that exist stay
    ids = [v for n, v, _ in q.metadata if n == "identifier"]
    assert ids[1] == "urn:1" and ids[0] == archive.derived_identifier("urn:1", "de", "bilingual") and not [n for n, _, _ in q.metadata if n == "link"]
    assert b'src="b.xhtml#x"' in q.parts["OEBPS/toc.ncx"] and archive.rebuilt(done, {}, "de")
    empty = archive.package(archive.rebuilt(book(nav.replace("<ol>", "<div>").replace("</ol>", "</div>")), {}))
    assert [e[1] for e in archive.flat(empty.contents)] == ["a.xhtml", "b.xhtml"]
    with zipfile.ZipFile(io.BytesIO(done)) as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None


def test_archives_as_tables(spark):
    rows = spark.createDataFrame([("x", bytearray(book())), ("y", bytearray(book()))], "book string, content binary")
    parts = spark.createDataFrame([("x", "OEBPS/b.xhtml", bytearray(b"<p>Zwei</p>"))], "book string, name string, content binary")
    got = {r["book"]: archive.package(bytes(r["content"])) for r in archive.rebuild_books(rows, parts).collect()}
    assert got["x"].parts["OEBPS/b.xhtml"] == b"<p>Zwei</p>" and b"Two" in got["y"].parts["OEBPS/b.xhtml"]
    assert [(r["nth"], r["title"], r["href"]) for r in archive.contents_table(rows.filter("book = 'x'")).orderBy("nth").collect()] == [(0, "a.xhtml", "OEBPS/a.xhtml"), (1, "b.xhtml", "OEBPS/b.xhtml")]
    assert "index_split_001.xhtml" in str(list(archive.package(archive.pairs_book("t", [("a", "b"), ("c", "<d>")])).parts))


def test_stylesheets_of_documents(spark):
    docs = spark.createDataFrame([("k", "t/a.xhtml", '<head><link rel="stylesheet" href="../s/one.css#x"><style>p{display:none}</style></head><body><p>a</p><div>b</div></body>'), ("k", "t/b.xhtml", "<body><p>c</p></body>")], "book string, name string, html string")
    sheets = spark.createDataFrame([("k", "s/one.css", 0, "div{display:inline}"), ("k", "s/two.css", 1, "p{display:inline}")], "book string, path string, at int, css string")
    got = archive.sheets_of(docs, sheets)
    assert {r["name"]: r["sheets"] for r in got.collect()} == {"t/a.xhtml": ["div{display:inline}", "p{display:none}"], "t/b.xhtml": ["div{display:inline}", "p{display:inline}"]}
    pages = got.withColumn("page_id", F.when(F.col("name") == "t/a.xhtml", 1).otherwise(2))
    parts = {(r["page_id"], r["text"]): (r["reason"], r["signature"]) for r in html.partition(pages, sheets="sheets").collect()}
    assert parts == {(1, "a"): ("hidden", "body"), (1, "b"): (None, "body"), (2, "c"): (None, "body")}


def test_pdf_lines(spark):
    pages = spark.createDataFrame([("b", 1, "three\n"), ("b", 0, "one\ntwo\n"), ("c", 0, None)], "book string, page_no int, text string")
    assert [(r["book"], r["line_no"], r["line"]) for r in archive.pdf_lines(pages).orderBy("book", "line_no").collect()] == [("b", 0, "one"), ("b", 1, "two"), ("b", 2, "three"), ("c", 0, "")]


def test_states(spark):
    rows = spark.createDataFrame([(1, '["a", "b"]'), (2, "a\r\nb\n")], "id int, s string")
    assert [r["x"] for r in rows.select(resume.load_state(F.col("s")).alias("x"), "id").orderBy("id").collect()] == [["a", "b"], ["a", "b"]]
    with pytest.raises(Exception, match="no list"):
        spark.createDataFrame([('{"a": 1}',)], "s string").select(resume.load_state(F.col("s"))).collect()
    jobs = spark.createDataFrame([(0, "x"), (1, "y")], "nth int, job string")
    resume.require_prefix(jobs.limit(0), jobs, "nth", "job")
    with pytest.raises(ValueError, match="1 of 1"):
        resume.require_prefix(spark.createDataFrame([(1, "x")], "nth int, job string"), jobs, "nth", "job")
    resume.require_same_plan(None, "a")
    with pytest.raises(ValueError):
        resume.require_same_plan("b", "a")


def test_lists(spark):
    rows = spark.createDataFrame([("a b\tcdef", "漢字漢字 x")], "a string, b string").select(lists.wrap(F.col("a"), 5).alias("a"), lists.wrap(F.col("b"), 4).alias("b"), lists.wrap(F.lit(""), 3).alias("c"), lists.api_root(F.lit("http://x/v1/")).alias("d"))
    r = rows.first()
    assert r["a"] == ["a b", "cdef"] or r["a"] == ["a b", " cde", "f"] or "".join(r["a"]).replace(" ", "") == "abcdef"
    assert r["b"] == ["漢字", "漢字", "x"] and r["c"] == [""] and r["d"] == "http://x"
    of = spark.createDataFrame([(i, i // 3) for i in range(9)], "i int, batch int")
    assert lists.first_batches(of, "i", "batch", 3).count() == 6 and lists.first_units(of, "i", 4).count() == 4
    assert lists.choose_files(of.withColumn("f", F.lit("a")), "f", only=["b"]).count() == 0
    lists.require_no_failures(of.withColumn("e", F.lit(None).cast("string")), "i", "e")
    with pytest.raises(RuntimeError, match="2 failed: 0, 1"):
        lists.require_no_failures(of.withColumn("e", F.when(F.col("i") < 2, "x")), "i", "e")


def test_ladder_and_schema():
    refused = []

    def no():
        raise questions.Refused("400")

    assert questions.ladder([("strict", no), ("json", lambda: {"b": 1}), ("text", lambda: {"a": 1})], lambda o: "a" in o, refused.append) == {"a": 1} and refused == ["strict"]
    assert questions.ladder([("json", lambda: {"b": 1}), ("text", lambda: None)], lambda o: "a" in o) == {"b": 1}
    with pytest.raises(questions.Unanswered):
        questions.ladder([("strict", no)])
    known = questions.Capabilities()
    known.refused("m", "strict"), known.refused("m", "strict"), known.refused("m", "text"), known.refused("m", "text")
    assert known.rungs("m", ["strict", "json", "text"]) == ["json", "text"]
    known.answered("m", "strict")
    assert known.rungs("m", ["strict", "text"]) == ["strict", "text"]
    schema = questions.verdict_schema(["p", "div.x"])
    said = questions.describe(schema)
    assert '"verdict" is one of "translate", "skip", "unsure"' in said and "additionalProperties" not in said and "<one of: translate, skip, unsure>" in said
    assert questions.upper_typed(schema)["properties"]["p"]["properties"]["verdict"]["type"] == "STRING"
    assert '1. "p", 3 times:\n   - s' in questions.verdict_prompt([{"signature": "p", "units": 3, "samples": ["s"]}])


def test_pace_poll_and_modes():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = questions.Pace(2.0, lambda: now[0], sleep)
    pace(), pace()
    assert slept == [2.0]
    states = iter(["queued", "completed"])
    assert questions.poll(lambda: next(states), clock=lambda: now[0], sleep=sleep) == "completed"
    with pytest.raises(TimeoutError):
        questions.poll(lambda: "queued", at_most=5, clock=lambda: now[0], sleep=sleep)
    with pytest.raises(RuntimeError):
        questions.poll(lambda: "failed")
    questions.check_modes({"plan"})
    with pytest.raises(ValueError):
        questions.check_modes({"plan", "batch"})


def test_delimited_translator(spark):
    good = enrich.Delimited(lambda t: t.upper())
    assert good.translate_list(["a", "b"]) == ["A", "B"] and good.translate_list(["a"]) == ["A"]
    merged = enrich.Delimited(lambda t: "one" if "@@" in t else t.upper())
    assert merged.translate_list(["a", "b"]) == ["A", "B"]
    with pytest.raises(ValueError):
        enrich.Delimited(lambda t: " ").translate("a")
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, text string")
    assert [r["tokens"] for r in enrich.token_counts(rows, "text", lambda: lambda t: len(t.split())).orderBy("id").collect()] == [10, 7]


def test_batch_results_of_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"custom_id": "a", "response": {"body": {"choices": [{"finish_reason": "stop", "message": {"content": "hi"}}]}}}\n{"custom_id": "b", "response": {"body": {"choices": [{"finish_reason": "length", "message": {"content": "h"}}]}}}\n')
    got = {r["custom_id"]: (r["text"], r["error"]) for r in questions.read_batch_results(spark, str(tmp_path), "german").collect()}
    assert got == {"a": ("hi", None), "b": (None, "cut off")}


def test_parts_of_a_reply_keep_their_digits(spark, tmp_path):
    import duckdb

    from lectern import queries_more

    many = [f"{i}a{i}" for i in range(12)] + ["\u00a0x\u3000", " y\t", "2 \r", "\u2003"]
    texts = ["\n".join(many), "0\n1 b 1\n2", " \u00a00 ", "a\n\n \n1", "", " ", None, "x@@y\n1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = docs.filter("doc_id = 0").select(questions.split_reply(questions.batch_prompt(F.split("text", "\n")), F.lit(len(many)))).first()[0]
    assert back == [*many[:12], "x", "y\t", "2 \r", ""]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = sorted(db.execute(queries_more.ORACLE_SQL["delimiter_batches"]).fetchall())
    assert sorted(map(tuple, queries_more.delimiter_batches(spark, str(tmp_path)).collect())) == wanted and len(wanted) == 4


def test_saved_parts(spark):
    r = spark.range(1).select(questions.saved_parts(F.lit("a\n\nb"), F.lit(2)).alias("two"), questions.saved_parts(F.lit("a\n\nb"), F.lit(1)).alias("one"), questions.saved_parts(F.lit("a"), F.lit(2)).alias("merged"), questions.tagged_text(F.lit("x <s>a\nb</s>"), "s").alias("t")).first()
    assert (r["two"], r["one"], r["merged"], r["t"]) == (["a", "b"], ["a\n\nb"], ["a"], "a\nb")


def test_tag_mode(spark):
    pages = spark.createDataFrame([(1, "<body><p>One <sup>1</sup></p><li>a<p>b</p></li><p><code>x</code></p><p>12</p></body>"), (2, None)], "page_id long, html string")
    units = tags.tag_units(pages, ("p", "li"), ("sup", "code"))
    got = [(r["tag"], r["leaf"], r["text"], r["kept"]) for r in units.orderBy("ord").collect()]
    assert got == [("p", True, "One 1", "One "), ("li", False, "ab", "ab"), ("p", True, "b", "b"), ("p", True, "x", ""), ("p", True, "12", "12")]
    assert [r["kept"] for r in tags.translatable(units).orderBy("ord").collect()] == ["One ", "b"]
    both = lists.all_passes(units, tags.strings(html.tokens(pages)))
    assert both.count() == 5 + 6


def test_a_plan_is_carried_out(spark):
    pages = spark.createDataFrame([(1, "<body><h1>Head</h1><p>One long paragraph of text.</p><p>Two</p><div>3 / 4</div></body>")], "page_id long, html string")
    plan = prepare.prepare(pages, spark.createDataFrame([("div", "skip")], "signature string, action string"))
    done = spark.createDataFrame([(1, 3, "KEPT")], "page_id long, owner int, translation string")
    assert {r["signature"] for r in plan.rows.collect()} == {"h1", "p"} and {r["reason"]: r["chars"] for r in plan.skipped.collect()} == {"user-excluded": 5}
    owners = {r["text"]: r["owner"] for r in plan.units.collect()}
    done = spark.createDataFrame([(1, owners["Two"], "KEPT")], "page_id long, owner int, translation string")
    new = prepare.bilingual(pages, plan, done=done).first()["html"]
    assert new == "<body><h1>Head</h1><h1>[offline]Head</h1><p>One long paragraph of text.</p><p>[offline]One long paragraph of text.</p><p>Two</p><p>KEPT</p><div>3 / 4</div></body>"
    assert prepare.prepare(pages, saved=prepare.prepare(pages).fingerprint)
    with pytest.raises(ValueError, match="another plan"):
        prepare.prepare(pages, saved=plan.fingerprint)
    with pytest.raises(ValueError, match="empty"):
        prepare.prepare(pages.limit(0))


def test_requests_and_replies():
    prompt = {"user": "To {language}:{crlf}{text}", "system": "You know {language}."}
    chat = requests.body("chat", "m", "hi {x}", "german", prompt, [("a", "b")], 0.5, {"name": "s"}, extra={"seed": 1})
    assert [m["role"] for m in chat["messages"]] == ["system", "user", "assistant", "user"] and chat["messages"][-1]["content"] == "To german:\nhi {x}" and chat["seed"] == 1 and chat["response_format"]["json_schema"] == {"name": "s"}
    assert requests.body("messages", "m", "hi", "german", prompt)["system"] == "You know german."
    assert requests.body("contents", "m", "hi", "german", prompt, [("a", "b")])["contents"][1]["role"] == "model"
    assert requests.body("options", "m", "hi", "German", terms={"a": "b"})["translation_options"]["terms"] == [{"source": "a", "target": "b"}]
    assert requests.body("form", "", "hi", "de") == {"text": ["hi"], "target_lang": "DE"} and requests.body("list", "", "a\nb", "zh")["source"] == ["a", "b"]
    assert requests.reply_text("chat", {"choices": [{"message": {"content": "x"}}]}) == "x" and requests.reply_text("messages", {"content": [{"type": "text", "text": "y"}]}) == "y"
    assert requests.reply_text("contents", {"candidates": [{"content": {"parts": [{"text": "z"}]}}]}) == "z" and requests.reply_text("list", {"target": ["a", "b"]}) == "a\nb"
    for wrong in ({}, {"choices": [{"finish_reason": "length", "message": {"content": "x"}}]}, {"choices": [{"message": {"refusal": "no"}}]}):
        with pytest.raises(ValueError):
            requests.reply_text("chat", wrong)


def test_prompts():
    text = "# P\n\n## Developer Message\n\nBe exact.\n\n## Conversation\n\n| Role | Content |\n|---|---|\n| User | Into {language}:\\n{text} |\n"
    assert books.parse_prompt(text, "p.prompt.md") == {"user": "Into {language}:\n{text}", "system": "Be exact."}
    with pytest.raises(ValueError):
        books.parse_prompt("## Conversation\n", "p.md")
    assert books.parse_prompt('{"user": "{text}"}', "p.txt") == {"user": '{"user": "{text}"}'}


def test_options():
    o = options.from_args(["--book", "a.epub", "--exclude-tags", "sup, code", "--single", "--color", "red", "--style", "margin:0;"])
    assert o.exclude_tags == ["sup", "code"] and o.single and o.css() == "margin:0; color: red" and o.limit() is None
    for wrong in (["--language", "klingon"], ["--start", "a"], ["--translator", "none"], ["--batch", "x"], ["--min-coverage", "2"]):
        with pytest.raises(ValueError):
            options.from_args(wrong)


def test_books_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.txt").write_text("One\n\nTwo")
    (tmp_path / "c.srt").write_text("1\nt\nOne\n\n2\nt\nTwo")
    (tmp_path / "d.md").write_text("# One\n\nTwo\n\n```\nx\n```\n")
    for name in ("a.epub", "b.txt", "c.srt", "d.md"):
        command.main(["--book", str(tmp_path / name), "--out", str(tmp_path / "out"), "--min-coverage", "0.1"])
    assert capsys.readouterr().out.count("_bilingual.") == 4
    done = archive.package((tmp_path / "out" / "a_bilingual.epub").read_bytes())
    assert b"<p>One</p><p>[offline]One</p>" in done.parts["OEBPS/a.xhtml"]
    assert (tmp_path / "out" / "b_bilingual.txt").read_text() == "One\n[offline]One\n\nTwo\n[offline]Two"
    assert (tmp_path / "out" / "c_bilingual.srt").read_text() == "1\nt\nOne\n[offline]One\n\n2\nt\nTwo\n[offline]Two"
    assert "# One\n\n[offline]# One\n\nTwo\n\n[offline]Two\n\n```\nx\n```" in (tmp_path / "out" / "d_bilingual.md").read_text()
    command.main(["--book", str(tmp_path / "a.epub"), "--dry-run", "--min-coverage", "0.1"])
    assert "p: 2 units, 6 characters" in capsys.readouterr().out
