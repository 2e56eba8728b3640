import pytest

from lectern.operators import css, enrich, markdown, subtitles
from lectern.sources import books


def test_markdown_batches():
    def calls(text, n, chars):
        return [list(b.texts) for b in markdown.batches(list(markdown.blocks(text)), n, chars) if isinstance(b, markdown.Batch)]

    text = "# First\n\nBody one.\n\nBody two is longer.\n\n# Second\n\nBody three."
    assert calls(text, 1, 25) == [["# First", "Body one."], ["Body two is longer."], ["# Second", "Body three."]]
    assert calls("# Heading\n\nFirst paragraph.\n\nSecond paragraph.", 10, 2000) == [["# Heading", "First paragraph.", "Second paragraph."]]
    kinds = [(b.text, b.translatable) for b in markdown.blocks("---\na: 1\n---\n~~~~\nx\n~~~\n~~~~\n|a|b|\n|--|---|\n|1|2|\nend\n{4}----\n![i](x)")]
    assert [k for _, k in kinds] == [False, False, True, False, False]


def test_markdown_inline_round_trip():
    text = "See [a](http://x) and `code` <https://y> ![i](z)\n# H {#id}"
    safe, kept = markdown.protect(text)
    assert "http" not in safe and "`" not in safe and len(kept) == 5
    assert markdown.restore(safe, kept) == text


def test_sections_are_contiguous():
    of = [markdown.Batch(("x" * n,), c) for n, c in ((5, "A"), (5, "A"), (9, ""), (9, ""), (3, "B"))]
    found = markdown.sections(of, 2)
    assert [i for s in found for i in s] == list(range(5)) and len(found) >= 2


def test_subtitles(spark):
    cues = subtitles.cues(spark.createDataFrame([(1, "1\nt1\nOne\n\n \n2\nt2\nTwo\nlines")], "doc_id long, text string"))
    assert [(r["number"], r["time"], r["text"]) for r in cues.orderBy("cue").collect()] == [("1", "t1", "One"), ("2", "t2", "Two\nlines")]
    assert [(r["first"], r["last"]) for r in subtitles.packs(cues, 10).orderBy("pack").collect()] == [(0, 1), (1, 2)]
    assert [(r["first"], r["last"]) for r in subtitles.packs(cues, 500).collect()] == [(0, 2)]


def test_css():
    assert list(css.rules("a{display:block}@media print{a{display:none}}@supports(x){.b{display:flex}}@import 'q';p.c,d e{display:inline}")) == [("a", None, "block"), (None, "b", "flex"), ("p", "c", "inline")]
    assert css.displays(["a{display:block} b{display:none}", "a{display:inline}"]) == {"b": "none", "a": "inline"}


def test_alignment():
    class Short(enrich.Translator):
        def translate(self, text):
            return text.upper()

        def translate_list(self, texts):
            return [t.upper() for t in texts[: 2 if len(texts) > 2 else None]]

    assert enrich.Aligned(Short())(["a", "b", "c", "d", "e"]) == list("ABCDE")
    assert enrich.with_empties(enrich.Aligned(Short()), ["a", " ", "b"]) == ["A", " ", "B"]

    class Broken(enrich.Translator):
        def translate(self, text):
            raise PermissionError

    stopped = enrich.Aligned(Broken(), fatal=(PermissionError,))
    assert stopped(["a"]) == [stopped.failed] and stopped.stopped


def test_retry():
    waits, left = [], [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "ok"

    assert enrich.Retry(times=3, sleep=waits.append)(call) == "ok" and waits == [2.0, 4.0]


def test_replies():
    assert enrich.extract_paragraphs("(2) two\n(1) one", 2) == ["one", "two"]
    assert enrich.extract_paragraphs("a\n@@\nb", 2) == ["a", "b"]
    assert enrich.extract_json('so {bad {"a": "}"} x') == {"a": "}"}
    assert enrich.extract_json("none") is None
    assert enrich.unwrap_echo({"type": "object", "properties": {"p": {"verdict": "skip"}}}) == {"p": {"verdict": "skip"}}


def test_epub_round_trip(spark, tmp_path):
    path = tmp_path / "a.epub"
    path.write_bytes(books.epub_bytes("T & U", [("one.xhtml", "<p>one</p>"), ("two.xhtml", "<p>two</p>")]))
    rows = books.read_epub(spark, str(path)).filter(f"media_type = '{books.DOCUMENT}'").orderBy("item").collect()
    assert [r["name"] for r in rows] == ["OEBPS/one.xhtml", "OEBPS/two.xhtml", "OEBPS/nav.xhtml"]
    spark.dataSource.register(books.Epub)
    assert spark.read.format("lectern_epub").option("paths", str(path)).load().count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("lectern_epub").option("paths", str(path)).option("pushdown", "true").load()
    assert pushed.filter("media_type = 'text/css'").count() == 0 and pushed.filter(f"media_type = '{books.DOCUMENT}'").count() == 3


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour\n")
    assert [r["line"] for r in books.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == ["one", "two", "", "four"]


def test_settings():
    assert books.format_of("a.b.EPUB") == "epub"
    with pytest.raises(ValueError):
        books.format_of("a.doc")
    assert books.parse_prompt("say {text}") == {"user": "say {text}"}
    with pytest.raises(ValueError):
        books.parse_prompt('{"user": "no"}')
    assert books.merge_providers({"a": {"api_style": "x"}}, {"a": {"api_style": "y"}})["a"]["api_style"] == "y"
    with pytest.raises(ValueError):
        books.merge_providers({}, {"a": {"style": "y"}})
