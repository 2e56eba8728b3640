import pytest

from lectern.operators import css, html, sequence
from lectern.plans import translation


def parts(spark, *pages, **how):
    return html.partition(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), **how).cache()


def units(spark, page, **how):
    p = parts(spark, f"<html><body>{page}</body></html>", **how)
    rows = [(r["signature"], r["text"]) for r in html.units(p).orderBy("unit_ord").collect()]
    skipped = {r["reason"]: r["chars"] for r in html.skips(p).collect()}
    total = p.agg({"chars": "sum"}).first()[0] or 0
    kept = html.units(p).agg({"chars": "sum"}).first()[0] or 0
    assert total == kept + sum(skipped.values())
    return rows, skipped


@pytest.mark.parametrize(
    "page, expected, reasons",
    [
        ("<p>Some text before, <a>some link</a>: some text after</p>", [("p", "Some text before, some link: some text after")], set()),
        ("<ul><li>one</li><li class='li'>two</li></ul>", [("li", "one"), ("li.li", "two")], set()),
        ("<div>intro <p>inner</p></div>", [("div", "intro"), ("p", "inner")], set()),
        ("<p><span>C</span><span>HAPTER </span><span>II</span></p>", [("p", "CHAPTER II")], set()),
        ("<p>real prose <b style='display:none'>x1</b>here</p><p>* * *</p><p>https://a.b/c</p><svg>t</svg>", [("p", "real prose here")], {"hidden", "symbol", "link", "non-content"}),
        ("<p><ruby>漢<rt>かん</rt></ruby></p>", [("p", "漢")], {"ruby"}),
        ("<p>one<br>two<sup>1</sup></p>", [("p", "one two")], {"excluded-tag"}),
        ("<nav epub:type='page-list'><a>12</a></nav><p>x</p>", [("p", "x")], {"pagebreak"}),
        ("<aside epub:type='footnote' hidden><p>note</p></aside>", [("p", "note")], set()),
        ("<p>he <em>walks</em> [<em>back</em>,]</p>", [("p", "he walks back")], {"symbol"}),
        ("", [], set()),
    ],
)
def test_partition(spark, page, expected, reasons):
    rows, skipped = units(spark, page)
    assert rows == expected and set(skipped) == reasons


def test_displays_make_blocks(spark):
    shown = css.displays(["span.verse{display:block} div.note{display:inline}"])
    rows, _ = units(spark, "<p>a <span class='verse'>b</span></p><section>c <div class='note'>d</div></section>", displays=shown)
    assert rows == [("p", "a"), ("span.verse", "b"), ("section", "c d")]


def test_plan(spark):
    p = parts(spark, "<html><body><h1>T</h1><p>one</p><p>one</p><p>two</p></body></html>")
    rows = {r["signature"]: r for r in translation.signature_rows(html.units(p)).collect()}
    assert rows["p"]["units"] == 3 and rows["p"]["samples"] == ["one", "two"]
    assert translation.coverage(p).first()["coverage"] == 1.0
    text = translation.plan_json(translation.signature_rows(html.units(p)), p, html.skips(p), b"book")
    assert translation.load_overrides(text, b"book") == {}
    with pytest.raises(ValueError):
        translation.load_overrides(text, b"other")
    with pytest.raises(ValueError):
        translation.load_overrides(text.replace('"translate"', '"skpi"'), b"book")
    empty = parts(spark, "<html><body></body></html>")
    assert translation.coverage(empty).first()["coverage"] == 1.0
    with pytest.raises(ValueError):
        translation.check_coverage(empty)


def test_stanzas(spark):
    verse = "".join("<div>" + "".join(f"<p>line {i} {j}</p>" for j in range(5)) + "</div>" for i in range(2))
    u = html.units(parts(spark, f"<html><body><section>{verse}</section><h2>Head</h2></body></html>"))
    rows = sequence.batch_index(sequence.stanzas(u, 4)).orderBy("unit_ord").collect()
    assert [r["stanza"] for r in rows] == [0] * 4 + [1] + [2] * 4 + [3] + [None]
    assert [r["batch"] for r in rows] == [0] * 4 + [1] + [2] * 4 + [3] + [4]
