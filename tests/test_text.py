import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import corpus, latex, markdown, metrics, text


def run(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


# Inputs and the results that the repair chain must give.
REPAIRS = {
    "t0": "to", "209.00O": "209,000", "7.352": "7,352", "10-3": "$10^{-3}$", "1.5x10-3": r"$1.5\times10^{-3}$", "1991": "[99]", "101": "[0]", "115]": "[15]",
    "pa- rameters": "parameters", "[12]": "[[2]", "1121": "[[2]", "l13l": "[[3]", "[171": "[[7]", "[IO]": "[[0]", r"samples\_": r"samples\.", "é- tude": "étude", "A.OVERALL": "A. OVERALL", "3I4": "314", " x ": "x",
}


def test_repairs(spark):
    assert dict(zip(REPAIRS, run(spark, text.clean_ocr, *REPAIRS), strict=True)) == REPAIRS


def test_headers_bullets_and_escapes(spark):
    assert run(spark, text.section_headers, "IV. RESULTS A. OVERALL COMPARISON", "DRETRIEVAL") == [["IV. RESULTS", "A. OVERALL COMPARISON"], ["D. RETRIEVAL"]]
    assert run(spark, text.bullet_items, "• one\nmore\n• two", "plain", "Model A: x Model B: y") == [["• one more", "• two"], ["plain"], ["Model A: x", "Model B: y"]]
    assert run(spark, text.escape_latex, "a_b{~^") == [r"a\_b\{\textasciitilde{}\textasciicircum{}"]
    assert run(spark, text.strip_nonascii, "a\nb", "é a\n b") == ["a\nb", "a b"]
    assert run(spark, text.plain_text, "<td>a</td><td>b</td></tr># x\n\n\n# **y**") == ["a b \nx\ny"]


def test_sanitize_and_gate(spark):
    assert run(spark, latex.sanitize, "{a", "a}}b}", r"\left( x", "{ok}") == ["{a}", "ab", r"\left( x\right.", "{ok}"]
    gate = lambda c: latex.passes_gate(c, F.lit(10.0), F.lit(10.0))
    assert run(spark, gate, "x", "", "~" * 10, r"\hline " * 5, "y" * 801, "y" * 800) == [True, False, False, False, False, True]


def test_distances(spark):
    df = spark.createDataFrame([("hello world", "hello world"), ("[ C ] h t g k b S b", "[ C ] h t a b S b"), ("", ""), ("x", "")], "p string, g string")
    rows = df.select(metrics.token_distance(F.col("p"), F.col("g")), metrics.ned(F.col("p"), F.col("g")), metrics.edr(F.col("p"), F.col("g")), metrics.folded_ned(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in rows] == [0.0, pytest.approx(0.2), 0.0, 1.0]
    assert [r[1] for r in rows][2:] == [0.0, 1.0] and [r[2] for r in rows][2:] == [0.0, 0.0] and [r[3] for r in rows][2:] == [0.0, 1.0]


def test_distance_equals_the_plain_one(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abé😀") for _ in range(n)) for n in (0, 1, 2, 3, 9, 40) for _ in range(4)]
    pairs = [(a, b) for a in texts for b in texts] + [(a + m + b, a + b) for a, b in zip(texts, reversed(texts), strict=True) for m in ("", "é", "a😀")] + [(None, "a"), ("a", None), ("aaa", "aa"), ("abab", "ab")]
    df = spark.createDataFrame(pairs, "p string, g string")
    assert df.filter(~metrics.distance(F.col("p"), F.col("g")).eqNullSafe(F.levenshtein("p", "g"))).count() == 0


def test_long_texts_with_equal_ends_take_little_time(spark):
    unit = "".join(random.Random(2).choice("abcdé ") for _ in range(80_000))
    pairs = spark.createDataFrame([(unit + "xx", unit), (unit[:40_000] + "ÄÖ" + unit[40_001:], unit), (unit, unit)], "p string, g string").coalesce(1)
    began = time.time()
    got = [r[0] for r in pairs.select(metrics.ned(F.col("p"), F.col("g"))).collect()]
    assert got == [2 / 80_002, 2 / 80_001, 0.0] and time.time() - began < 20


@pytest.mark.parametrize("pred,gold,want", [("hello world", "hello world", 0.0), ("[ C ] h t g k b S b", "[ C ] h t a b S b", 0.5253819788848316)])
def test_bleu(spark, pred, gold, want):
    assert metrics.corpus_bleu(spark.createDataFrame([(pred, gold)], "pred string, gold string")).first()["bleu"] == pytest.approx(want)


def test_markdown():
    tex = r"\begin{document}\subsection*{A} x \textbf{b \textit{c}} 5\% \footnote{gone}\begin{itemize}\item p \item q\end{itemize}\begin{equation}e\end{equation}% note" + "\n" + r"\begin{tabular}{ll}a & b \\ \hline & \\ c & \textbf{d}\end{tabular}\end{document}"
    out = markdown.to_markdown(tex)
    assert "## A" in out and "**b *c***" in out and "5%" in out and "gone" not in out and "note" not in out
    assert "- p\n- q" in out and "\\[\ne\n\\]" in out and '<table border="1"><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>' in out
    assert markdown.unwrap(r"\textbf{open", r"\textbf", lambda s: s) == "open" and markdown.to_markdown("") == ""
    assert markdown.unwrap(r"\x{a\x{b}} \xy{c}", r"\x", lambda s: f"<{s}>") == r"<a<b>> \xy{c}"


def test_markdown_commands():
    show = markdown.to_markdown
    page = "\\noindent\\hfill\\includegraphics[height=1.8em]{x}\\par\\noindent\\hrule\\vspace{4pt}\n\\begin{paracol}{2}\n\\RaggedRight\nA\n\\switchcolumn\n\\RaggedRight\nB\n\\end{paracol}"
    assert show(page.replace("\\\\", "\\")) == "A\n\nB"
    assert show("\\begin{center}\n\\textbf{\\large A {b} title}\n\\end{center}") == "# A {b} title"
    assert show("\\begin{center}\\resizebox{\\columnwidth}{!}{a & b \\\\ c & d}\\end{center}") == '<table border="1"><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>'
    assert show("\\textcolor{red}{z} \\frac{a}{b} \\textasciitilde{} \\[x\\] a\\\\b") == "red{z} \\frac{a}{b} ~ \\[x\\] a\nb"
    assert show("\\begin{itemize}\\item a\\begin{itemize}\\item b\\end{itemize}\\item c\\end{itemize}") == "- a\n- b\n- c"
    assert show("\\begin{tabular}{l}a \\& b & \\multicolumn{2}{c}{X} \\\\ $y_1$ & 5\\%\\end{tabular}") == '<table border="1"><tr><td>a \\</td><td>b</td><td>2cX</td></tr><tr><td>y_1</td><td>5%</td></tr></table>'
    assert show("\\section*{One} x\\par y \\includegraphics[w]{f} \\label{l} \\unknown{k}") == "# One\n x\n\n y   \\unknown{k}"


def test_document(spark):
    rows = [(1, "full", 1, "Title", "T"), (1, "left", 2, "List-item", "• a"), (1, "left", 3, "List-item", "• b"), (1, "right", 4, "Picture", ""), (1, "right", 5, "Table", ""), (2, "full", 1, "Text", "x")]
    regions = spark.createDataFrame(rows, "page_id long, zone string, reading long, class_name string, content string")
    got = {r["page_id"]: r["tex"] for r in latex.documents(latex.fragments(regions)).collect()}
    assert got[1].count("\\begin{itemize}") == 1 and "figures/figure_001.png" in got[1] and "paracol" in got[1] and "resizebox" not in got[1]
    assert got[2].startswith("\\documentclass") and got[2].endswith("\\end{document}\n") and "paracol" not in got[2]


def test_corpus(spark):
    assert run(spark, corpus.split_commands, r"a \frac\alpha x\\y") == [["a", r"\frac", r"\alpha", r"\\"]]
    df = spark.createDataFrame([([r"\left(", "x", r"\right.", r"\phantom", "{", "{", "a", "}", "b", "}", "c"],)], "t array<string>")
    out = df.select(corpus.drop_scopes((r"\phantom",))(corpus.split_left_right(F.col("t")))).first()[0]
    assert out == [r"\left", "(", "x", r"\right", ".", "c"]
    assert run(spark, corpus.without_nested_braces, "{{a}} {b} { {c} }") == ["{a} {b}  {c} "]
    merges = spark.createDataFrame([("a", "b", "ab"), ("ab", "c", "abc"), ("x", "y", "xy")], "left string, right string, merged string")
    assert {r["merged"] for r in corpus.kept_merges(merges, spark.createDataFrame([("abc",)], "token string")).collect()} == {"ab", "abc"}
    ids = spark.range(1).select(corpus.labels(corpus.fit_length(corpus.encode(F.array(F.lit("a"), F.lit("zz")), F.create_map(F.lit("a"), F.lit(7))), 6))).first()[0]
    assert ids == [7, 3, 2, -100, -100, -100]


def test_rows_with_unknown_tokens(spark):
    lists = [None, [], [""], ["a"], ["a", "b", "a"], ["a,b"], ["a", "x"], ["x"], ["x"], [None], ["-"], ["b", "a"]]
    rows = spark.createDataFrame([(i, "long text" * 50, t) for i, t in enumerate(lists)], "id long, text string, t array<string>")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("b",)], "token string")
    kept = corpus.without_unknown(rows, "t", vocabulary)
    assert kept.columns == rows.columns
    assert sorted(r["id"] for r in kept.collect()) == [i for i, t in enumerate(lists) if not t or set(t) <= {"a", "b"}]
    # what is moved for each token holds neither the text nor the row's other tokens
    narrow = kept.select("id")
    plan = spark._jvm.PythonSQLUtils.explainString(narrow._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) >= 3 and not any(re.search(r"\b(text|t|_row)#", m) for m in moved)
