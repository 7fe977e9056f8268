"""Splitting, terms, sentences, markup, scans, mixing, languages: by hand, by brute force, by properties."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import distinctive as D
from foliospark.llm import language as L
from foliospark.llm import markup as M
from foliospark.llm import scans as S
from foliospark.llm.mixing import Mixture
from foliospark.llm.sentences import sentences, split_sentences
from foliospark.llm.split import pieces, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é漢", max_size=1500))
def test_pieces_cover_within_size(text):
    text = text.strip()
    cut = pieces(text, 200, 20, 80)
    assert all(0 < b - a <= 200 for a, b in cut) and (not text) == (not cut)
    assert all(n[0] == p[1] - 20 for p, n in zip(cut, cut[1:]))
    if cut:
        assert cut[0][0] == 0 and cut[-1][1] == len(text)


def test_edits_change_only_their_neighbours():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(2500))
    edited = text[:3000] + "edit " + text[3000:]
    own = {text[a:b] for a, b in pieces(text, 900, 75, 300)}
    kept = [edited[a:b] in own for a, b in pieces(edited, 900, 75, 300)]
    assert kept[0] and sum(not k for k in kept) <= 6 and all(kept[-5:])


def test_split_rows(spark):
    rows = [("a", " " + "word " * 300, "S", 1), ("a", " " + "word " * 300, "S", 1), ("b", "short", None, 2), ("c", None, "S", 3), ("d", " \n", "S", 4), ("e", "x" * 2000, "S", 5)]
    df = spark.createDataFrame(rows, "id string, t string, section string, piece_no int")
    got = split_oversized(df, "id", "t", {"section": F.col("section")}).orderBy("id", "piece_no").collect()
    assert {r.id: sum(x.id == r.id for x in got) for r in got} .keys() == {"a", "b", "e"} and sum(r.id == "b" for r in got) == 1 and all(len(r.piece_text) <= 900 for r in got) and {r.section for r in got if r.id == "a"} == {"S"}
    assert split_oversized(df.where("false"), "id", "t").count() == 0


def test_tail_probability_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        N = rng.randint(5, 300)
        K, n = rng.randint(1, N), rng.randint(1, N)
        k = rng.randint(1, min(n, K))
        exact = sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, min(n, K) + 1)) / math.comb(N, n)
        got = float(D.upper_tail([k], [n], [K], [N])[0])
        assert math.isclose(math.exp(got), exact, rel_tol=1e-8, abs_tol=1e-300)
    assert np.allclose(D.log_gamma(np.array([1, 2, 5.5, 100, 1e6])), [math.lgamma(x) for x in (1, 2, 5.5, 100, 1e6)], rtol=1e-12, atol=1e-12)


def test_adjusted_is_benjamini_hochberg():
    rng = random.Random(5)
    rows = [[rng.random() ** 3 for _ in range(rng.randint(1, 12))] for _ in range(20)]
    flat, row = np.log(np.array(sum(rows, []))), np.repeat(np.arange(20), [len(r) for r in rows])
    got = np.exp(D.adjusted(flat, row))
    at = 0
    for r in rows:
        for p, q in zip(r, got[at : at + len(r)]):
            assert math.isclose(q, min(1, min(x * len(r) / sum(y <= x for y in r) for x in r if x >= p)), rel_tol=1e-9)
        at += len(r)


def test_keywords_and_terms(spark, monkeypatch):
    texts = [(f"c{i}", "common words here") for i in range(60)] + [("k1", "Rare Thing and training data here"), ("k1", "Rare Thing and training data here"), ("k2", "rare, thing"), ("k3", "training-data"), ("n", None), ("b", " "), ("s", "!?"), ("o", "one")]
    texts.append(("long", " ".join(f"v{i}" for i in range(80))))
    df = spark.createDataFrame([(*t, "clash") for t in texts], "chunk_id string, chunk_text string, n string")
    phrases = [" ".join(f"v{i}" for i in range(n)) for n in range(1, 71)]  # of seventy lengths
    q = spark.createDataFrame([("q", ["rare ", "RARE", "Training Data", "common", None, " ", "nowhere"]), ("e", []), ("z", None), ("v", phrases)], "id string, expected_keywords array<string>")

    def all_rows():
        scored = {(r.query_id, r.id, r.keyword): (r["count"], r.df, round(r.score, 9), r.distinctive) for r in D.keyword_scores(df, q, most_share=0.05).collect()}
        assert {k: (v[0], v[1], v[3]) for k, v in scored.items()} == {(r.query_id, r.id, r.keyword): (r["count"], r.df, r.distinctive) for r in D.query_keywords(df, q, most_share=0.05).collect()}
        held, totals = D.held_phrases(D.hashed_words(df, "chunk_id", "chunk_text"), D.keyword_terms(q, "id", "expected_keywords"))
        return scored, totals.first(), {(r.id, r.term): (r["count"], r.df, r.marked) for r in held.collect()}

    first = all_rows()
    rows = first[0]
    assert {k[1:] for k, r in rows.items() if r[3] and k[0] == "q"} == {("k1", "rare"), ("k1", "training data"), ("k2", "rare"), ("k3", "training data")} and rows["q", "c1", "common"][1] == 60
    assert sum(k[0] == "v" for k in rows) == 70 and tuple(first[1]) == (66, 60 * 3 + 6 + 2 + 2 + 1 + 80)
    assert rows["q", "k1", "rare"][2] > rows["q", "c1", "common"][2]
    terms = {r.id: {t.term: t.score for t in r.terms} for r in D.term_scores(df, "chunk_id", "chunk_text").collect()}
    assert terms["k1"]["rare"] > terms["c1"]["common"] and set(terms["k2"]) == {"rare", "thing"} and "n" not in terms
    # a word has one score, asked as a keyword or not
    assert all(math.isclose(rows["q", i, w][2], terms[i][w], abs_tol=1e-9) for i, w in (("k1", "rare"), ("k2", "rare"), ("c1", "common"), ("c9", "common")))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)  # the way for collections whose words are many
    assert all_rows() == first
    slow = {r.id: {t.term: t.score for t in r.terms} for r in D.term_scores(df, "chunk_id", "chunk_text").collect()}
    assert all(math.isclose(slow[i][t], s, abs_tol=1e-9) for i in terms for t, s in terms[i].items()) and {i for i in terms if terms[i]} == set(slow)
    assert D.query_keywords(df.where("false"), q).count() == 0 and D.keyword_scores(df, q.where("false")).count() == 0


def test_found_keywords_come_through_their_scores(spark, tmp_path, monkeypatch):
    from foliospark.llm import queries

    texts = [(f"c{i}", "common words and a few more here") for i in range(150)] + [("k1", "alpha beta, alpha common"), ("k1", "alpha beta, alpha common"), ("k2", "Beta gamma delta"), ("k3", "gamma common"), ("k4", "alpha"), ("n", None)]
    df = spark.createDataFrame(texts, "chunk_id string, chunk_text string")
    q = spark.createDataFrame([("q", [" Alpha", "beta", "Gamma Delta", "common"]), ("r", ["gamma", "common", "nowhere"])], "id string, expected_keywords array<string>")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    q.write.parquet(f"{tmp_path}/queries.parquet")

    def scores(**how):
        return {(r.query_id, r.keyword, r.id): (r["count"], r.df, round(r.score, 9), r.distinctive) for r in D.keyword_scores(df, q, **how).collect()}

    # the scores of distinctive keywords are the same whatever else is scored, both ways
    every = scores()
    wanted = {k: v for k, v in every.items() if v[3]}
    assert set(wanted) == {("q", "alpha", "k1"), ("q", "alpha", "k4"), ("q", "beta", "k1"), ("q", "beta", "k2"), ("q", "gamma delta", "k2"), ("r", "gamma", "k2"), ("r", "gamma", "k3")}
    assert scores(rare=True) == wanted and all(v[2] > 0 for v in wanted.values())
    found = {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert found == {("q", "k1"), ("q", "k2")}
    scored = D.keyword_scores
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert scores(rare=True) == wanted and found == {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    # a keyword without a score in a record doesn't count there
    monkeypatch.setattr(queries, "keyword_scores", lambda *a, **how: scored(*a, **how).where("not (keyword = 'beta' and id = 'k2')"))
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == {("q", "k1")}


@pytest.mark.parametrize("records", [50, 10**4, 10**10])
def test_edge_of_distinctive_keywords_is_exact(spark, records):
    edge = records // 50
    held = spark.createDataFrame([(i, edge + i) for i in (-1, 0, 1) if edge + i], "term long, df long")
    got = {r.term: r.distinctive for r in D.distinctive_terms(held, spark.createDataFrame([(records,)], "records long"), 0.02).collect()}
    assert got == {i: i <= 0 for i in (-1, 0, 1) if edge + i}


@pytest.mark.parametrize(
    "text, wanted",
    [
        ('Mrs. A said, "Stop! It is narrow," and left. Then J. K. B kept notes.v4.txt.', ["Mrs.", "Then"]),
        ("In the U.S. sample it fell. Return the list, etc. The rest is 3.14. k-means came next.", ["In", "Return", "The", "k-means"]),
        ('"Is it open?" asked the tutor. It waits ... then goes.', ['"Is', "It"]),
        ("It was tidal.The next (see Fig. 8. and Eq. 7) went on.", ["It", "The"]),
        ("Am 22. Oktober kam Dr. Xavo. Der Fehler liegt z. B. bei 0,3, d. h. fest! „Ist es so?“, fragte er.", ["Am", "Der", "„Ist"]),
        ("« Pourquoi ? » demanda M. Xavo. Est-ce vrai ? Oui.", ["«", "Est-ce", "Oui."]),
        ("¿Qué pasa? ¡Nada! El Dr. Z midió 2,3 unidades, aprox. la mitad.", ["¿Qué", "¡Nada!", "El"]),
        ("В 5 г. до н. э. было так. «Почему?» — спросил проф. Явор. Ошибка, т. е. сбой.", ["В", "«Почему?»", "Ошибка,"]),
        ("表格……其实很好。“为什么？”老师问道。下一句！", ["表", "“为", "下"]),
        ("誤差は0.13です。「なぜですか？」と尋ねました。", ["誤", "「な"]),
        ("यह है। क्या सच है? डॉ. X ने कहा।", ["यह", "क्या", "डॉ."]),
        ("هل هذا صحيح؟ قال د. X نعم.", ["هل", "قال"]),
        ("ดร. X บอกว่าดีครับ ค่าคือ 0.10 แปลว่าดีค่ะ จบ", ["ดร.", "ค่า", "จบ"]),
        ("1. First item\nand on. 2 more", ["1.", "2"]),
        ("no mark at all", ["no"]),
        ("", []),
        ('An open " mark. And more.', ["An", "And"]),
    ],
)
def test_sentence_starts(text, wanted):
    got = [text[a:b] for a, b in sentences(text)]
    assert len(got) == len(wanted) and all(g.startswith(w) for g, w in zip(got, wanted)), got


def test_long_quotations_and_stray_marks():
    speech = "It rained. " * 90
    for a, b in ("“”", "()", '""', "«»"):
        assert len(sentences(f"They said {a}{speech.strip()}{b} and left. Then it stopped.")) == 2
    assert len(sentences("A stray (mark and (a closed one). Then more. And more.")) == 3
    assert len(sentences("(" * 50_000 + " One. Two. " + "“" * 50_000)) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='aB .!?"()\n「」…1', max_size=80))
def test_sentences_cover_the_text(text):
    cut = sentences(text)
    assert "".join(text[a:b] for a, b in cut).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert all(a < b for a, b in cut) and all(p[1] <= n[0] for p, n in zip(cut, cut[1:]))


def test_sentence_rows(spark):
    df = spark.createDataFrame([("a", " One. Two."), ("a", " One. Two."), ("b", None), ("c", " ")], "id string, t string")
    assert [tuple(r) for r in split_sentences(df, "id", "t").orderBy("start_pos").collect()] == [("a", 0, 1, 5, "One."), ("a", 1, 6, 10, "Two.")]


@pytest.mark.parametrize(
    "text, marks, clean",
    [
        ("<h2>Head</h2>\n<p>One &amp; <em>two</em>.</p><!-- x\ny -->", ["html"], "Head\n\nOne & two."),
        ("<ul><li>a<li>b</ul><script>x()</script>", ["html"], "- a\n- b"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", ["html"], "a\tb\n1\t2"),
        ("# T\n\n**a** _b_ ~~c~~ `d` [e](f.md) ![g](h.png)[^1]\n> q\n- [x] r", ["markdown"], "T\n\na b c d e g\nq\n- r"),
        ("T\n---\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n```py\nx = a ** b\n```", ["markdown"], "T\n\na\tb\n1\t2\n\nx = a ** b"),
        ("== H ==\n'''a''' [[b|c]] {{x|y}}[[File:a.png|d]]\n{| class=w\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"], "H\n\na c\n\na\tb\n1\t2"),
        ("\\section{H}\n\\emph{a}~\\cite{x} $k > 1$.\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\[\nx^2\n\\]", ["latex"], "H\n\na k > 1.\n\n- b\n\nx^2"),
        ("5 * 2 * 3, a == b, ~2, {1, 2}, x^2, [4] and [1, 4], a < 5 and b > 2, $2 to $3, n_init_runs and learning_rate, C# R & D List<Integer>", [], None),
        ("- plain\n- list\n1. one", [], None),
        ("", [], ""),
    ],
)
def test_markup(text, marks, clean):
    got, found = M.clean(text)
    assert found == marks and got == (text if clean is None else clean)


def test_markup_drops_link_lists():
    body = "<p>" + "A long sentence, with commas, and some more words. " * 5 + "</p>"
    assert "Home" not in M.clean(f"<nav><a href=x>Home</a><a href=y>Next</a></nav>{body}{body}")[0]


def test_markup_keeps_structure_and_lines_with_links():
    body = "<p>" + "A long sentence, with commas, and some more words. " * 8 + "</p>"
    for part, kept in [
        ("<table><tr><td><a href=x>Pump A</a></td><td>12</td></tr></table>", "Pump A\t12"),
        ("<ul><li><a href=x>Pump</a></li></ul>", "- Pump"),
        ("<header><h1>Title</h1></header>", "Title"),
        ("<p>See <a href=x>there</a> now</p>", "See there now"),
    ]:
        assert kept in M.clean(body + part)[0].split("\n"), part


def test_ratios_are_those_of_the_source(spark):
    body = "<p>" + "A long sentence, with commas, and some more words. " * 6 + "</p>"
    menu = "<nav><a href=x>Home</a></nav>"
    rows = [(f"b{i}", body, "site") for i in range(20)] + [("m", menu, "site"), ("alone", menu, "other"), ("none", menu, None), ("t", "<p>See <a href=x>there</a> now.</p>", "site"), ("n", None, "site")]
    df = spark.createDataFrame(rows, "id string, t string, source string")
    got = {r.id: r.clean_text for r in M.clean_markup(df, "id", "t", F.col("source")).collect()}
    # a menu alone in its chunk is known by the other texts of its source; with nothing to compare it stays
    assert got["m"] == "" and got["alone"] == "Home" and got["none"] == "Home" and got["t"] == "See there now." and got["n"] is None
    # one text as a source of its own: both ways agree
    for text in (menu + body + body, body, f"<header><h1>Title</h1></header>{body}", "# T\n\n*a* <a href=x>b</a> c\n" + body):
        row = M.clean_markup(spark.createDataFrame([("x", text)], "id string, t string"), "id", "t").first()
        assert (row.clean_text, row.markups) == M.clean(text)


def test_markup_rows(spark):
    df = spark.createDataFrame([("a", "<b>x</b>"), ("a", "<b>x</b>"), ("b", " plain "), ("c", None)], "id string, t string")
    assert {r.id: (r.clean_text, r.markups) for r in M.clean_markup(df, "id", "t").collect()} == {"a": ("x", ["html"]), "b": ("plain", []), "c": (None, [])}
    assert [(r.id, r.markups) for r in M.markups(df, "id", "t").collect()] == [("a", ["html"])]


def test_every_mark_has_a_measured_path():
    for text, path, sums in [
        ("<div>a, <b>bc</b> d.<br></div></i>", "/html/div", [4, 2, 1]),
        ("<div>a, <b>bc</b> d.<br></div></i>", "/html/div/b", [2, 0, 1]),
        ("<div>a, <b>bc</b> d.<br></div></i>", "/html/i", [0, 0, 1]),
        ("\\begin{quote}a. \\begin{center}b\\end{center}\\end{quote}", "/latex/quote/center", [1, 0, 1]),
        ("**a, `b`** and **c**", "/markdown/emphasis", [5, 1, 2]),
        ("[[p|two words.]] {{x|y}}", "/wiki/link", [10, 1, 1]),
        ("<i>" * 3000 + "a.", "/html/i", [2, 1, 3000]),
    ]:
        reader = M.Reader(text)
        reader.run()
        assert reader.paths[path] == sums, (path, reader.paths)


def test_found_markups_come_through_the_ratios(spark, tmp_path, monkeypatch):
    from foliospark.llm import queries

    body = "<p>" + "A long sentence, with commas, and some more words. " * 6 + "</p>"
    texts = [(f"b{i}", body, "notes") for i in range(9)] + [("m", "<a href=x>Home</a>", "notes"), ("alone", "<a href=x>Home</a>", "slides"), ("w", "[[p|q]] and *r*", None), ("p", "- plain", "notes"), ("n", None, "notes")]
    df = spark.createDataFrame([(i, t, (s,)) for i, t, s in texts + texts], "chunk_id string, chunk_text string, metadata struct<source_type:string>")
    # marks around content and marks of controls are both residue; a menu alone in its source has nothing to be held against
    got = {(r.id, r.markup): r.content for r in M.residue(df, "chunk_id", "chunk_text", F.col("metadata.source_type")).collect()}
    assert got == {(f"b{i}", "html"): True for i in range(9)} | {("m", "html"): False, ("alone", "html"): True, ("w", "wiki"): True, ("w", "markdown"): True}
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    found = {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()}
    assert found == set(got)
    # a path without a ratio gives no row
    fused = M.fused_ratios
    monkeypatch.setattr(M, "fused_ratios", lambda sums, *a: fused(sums, *a).where("path <> '/wiki/link'"))
    assert found - {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()} == {("w", "wiki")}


def brute(word, words, least):
    """All words within two confusions, by trying every replacement."""
    out, now = {}, {word}
    for cost in (1, 2):
        now = {w[:i] + r + w[i + len(x) :] for w in now for x, r in S.CONFUSED for i in range(len(w)) if w.startswith(x, i)}
        for w in now:
            if w != word and words.get(w, 0) >= least:
                out.setdefault(w, cost)
    return out


def test_automaton_finds_every_candidate():
    rng = random.Random(3)
    words = {w: n for n, w in enumerate(["modern", "modem", "clear", "dear", "will", "vvill", "hello", "held", "corner", "comer", "the", "tbe", "list", "hst", "unit"], 5)}
    trie = S.build_trie(words)
    for w in ["rnodern", "c1ear", "tbe", "hcllo", "|ist", "comer", "unjt", "vvill", "1ist", "clear"]:
        assert all(c in S.candidates(w, trie, 5) for c, cost in brute(w, words, 5).items() if cost == 1)
    assert S.candidates("rnodcm", trie, 5)["modem"][0] == 2
    assert "unit" in S.candidates("unjt", trie, 5, generic=True) and "unit" in S.candidates("unt", trie, 5, generic=True)
    _ = rng


@pytest.mark.parametrize("line, page, wanted", [("On stable grammar, MTV110   18", 18, (True, True)), ("Unit 2 | Smooth treaty", 3, (True, False)), ("13 · Latent archive", 1, (True, False)), ("R o l l i n g   r e a d e r   ·   S T X 2 1 0", 1, (True, False)), ("- 20 -", 20, (False, True)), ("20", 21, (False, False)), ("lxxi", 70, (False, True)), ("20", None, (False, False)), ("Rows kept", 1, (False, False)), ("The end of a line", 1, (False, False)), ("", 1, (False, False))])
def test_furniture(line, page, wanted):
    assert S.furniture(line, page, page) == wanted


def test_scans(spark, monkeypatch):
    good = "The regular matrix shows a half-open view of the garden. A half-open door is shown."
    bad = "Unit 3 | The garden\nThe rcgular rnatrix sh0ws a half-\nopen view of the gar-\nden. A half-open door is shown.\n7"
    rows = [(f"g{i}", good, None, None) for i in range(30)] + [("x", bad, 7, 7), ("x", bad, 7, 7), ("n", None, 1, 1), ("e", "", 1, 1), ("s", "One mistake in tbe\nlines.", 1, 1)]
    df = spark.createDataFrame(rows, "id string, t string, a int, b int")
    scan = S.ScanRepair(df, "id", "t", F.col("a"), F.col("b"))
    assert {(r.id, r.noise) for r in scan.noise().collect()} == {("x", k) for k in ("header", "hyphenation", "misread", "page_number")}
    out = {r.id: r.repaired for r in scan.repaired().collect()}
    assert out["x"] == good and out["g1"] == good and out["n"] is None and out["e"] == ""
    empty = S.ScanRepair(df.where("false"), "id", "t", F.col("a"), F.col("b"))
    assert empty.noise().count() == 0 and empty.repaired().count() == 0


def test_one_answer_whatever_the_size(spark, monkeypatch):
    long = "pneumono" * 6
    rows = [(f"l{i}", "The green lace is old. The half-open " + long + " door.", None) for i in range(30)] + [(f"i{i}", "A red iace is new.", None) for i in range(30)]
    rows += [("x", "The green 1ace and a red 1ace are here, with " + long.replace("u", "ii", 1) + " too.", None), ("y", "It is half-\nopen and gar-\nden and old-\nfashioned ter-\nri-\ntory.", None), ("n", None, 1), ("b", " \n ", 1)]
    rows += [("old", "An old-fashioned garden. An old-fashioned view.", None), ("old2", "An old-fashioned one.", None)]
    df = spark.createDataFrame(rows, "id string, t string, a int")
    take = lambda: (lambda s: ({r.id: r.repaired for r in s.repaired().collect()}, {tuple(r) for r in s.noise().collect()}))(S.ScanRepair(df, "id", "t", F.col("a"), F.col("a")))
    few = take()
    assert few[0]["x"] == "The green lace and a red iace are here, with " + long + " too."
    assert few[0]["y"] == "It is half-open and garden and old-fashioned territory." and few[0]["b"] == " \n " and few[0]["n"] is None
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)  # the way for collections with many misread words
    monkeypatch.setattr(S, "SHARD", 1)  # and for large vocabularies
    assert take() == few


def test_running_headers_recur_over_pages(spark):
    text = lambda line: f"{line}\nthe matrix is shown here and\nthe garden is open."
    rows = [("a", text("Soft gardens   11"), 11, "d"), ("b", text("12   Soft gardens"), 12, "d"), ("c", text("SOFT GARDENS"), 13, "d"), ("e", text("Soft gardens"), 14, "other"), ("f", text("Total sum   15"), 15, "other"), ("g", text("2 1 8   S o f t   g a r d e n s"), 14, "d"), ("h", text("2 1 8   O n   r a d i a l   c l a y   —   Q S T 3 0 8"), 218, "z")]
    df = spark.createDataFrame(rows, "id string, t string, a int, doc string")
    got = {(r.id, r.noise) for r in S.ScanRepair(df, "id", "t", F.col("a"), F.col("a"), F.col("doc")).noise().collect()}
    assert got == {("a", "header"), ("a", "page_number"), ("b", "header"), ("b", "page_number"), ("c", "header"), ("g", "header"), ("h", "header"), ("h", "page_number")}


def test_rare_candidates_are_ranked_by_context(spark):
    rows = [(f"l{i}", "The flat roof is old.") for i in range(300)] + [(f"i{i}", "They ruled by fiat alone.") for i in range(20)]
    rows += [("x", "They ruled by f1at alone."), ("y", "The f1at roof is old."), ("z", "Some f1at is old."), ("p", "Page 12"), ("h", "Unit 3 | The garden"), ("q", "Page 13")]
    df = spark.createDataFrame([(*r, 12, 12) for r in rows], "id string, t string, a int, b int")
    out = {r.id: r.repaired for r in S.ScanRepair(df, "id", "t", F.col("a"), F.col("b")).repaired().collect()}
    assert (out["x"], out["y"], out["z"]) == ("They ruled by fiat alone.", "The flat roof is old.", "Some flat is old.")
    assert (out["p"], out["h"], out["q"]) == ("", "", "Page 13")


def test_mixture(spark):
    docs = [(i, "word " * 20, " Big ") for i in range(300)] + [(1000 + i, "word " * 20, "small") for i in range(10)] + [(2000, None, "small"), (2001, "x", None), (None, "x", "big"), (2002, "x", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 2), ("Small", 0.4, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = Mixture(d, t)
    assert {r.source for r in m.shares().where("short").collect()} == {"Small", "none"}
    plan = m.plan().collect()
    copies = Counter(r.copies for r in plan if r.source == "small" and r.tokens)
    assert copies == {3: 10} and max(r.copies for r in plan if r.source == "big") == 1
    total = sum(r.tokens for r in m.sized.collect())
    got = sum(r.tokens * r.copies for r in plan if r.source == "big")
    each = next(r.tokens for r in plan if r.source == "big")
    assert 0 <= total * 0.5 - got < 2 * each
    shares = {r.source: r.share for r in m.shares().collect()}
    assert math.isclose(sum(shares.values()), 1) and shares["none"] == 0
    assert Mixture(d, t).plan().select("id", "copies").collect().sort() == [(r.id, r.copies) for r in plan].sort()
    empty = Mixture(d.where("false"), t)
    assert empty.plan().count() == 0 and {r.share for r in empty.shares().collect()} == {0.0}


@pytest.mark.parametrize("label, code", [("en", "en"), ("EN", "en"), (" es-MX ", "es"), ("zh-Hans", "zh"), ("fr_CA", "fr"), ("ger", "de"), ("Ukrainian", "uk"), ("und", None), ("xx", None), ("", None), (None, None), ("english text", None)])
def test_labels(one, label, code):
    assert one(L.label_code, label) == code


def test_forward_sums_all_segmentations():
    p = {b"a": 0.4, b"ab": 0.2, b"b": 0.3, b"babab": 0.1}
    root, size = L.piece_trie(p)
    log = np.log(np.array([p[k] for k in sorted(p)]))

    def total(u):
        return 1.0 if not u else sum(p[u[:n]] * total(u[n:]) for n in range(1, min(5, len(u)) + 1) if u[:n] in p)

    def uses(u, piece):
        """Expected uses of a piece, by listing every segmentation."""
        def each(rest):
            if not rest:
                yield ()
            for n in range(1, min(5, len(rest)) + 1):
                if rest[:n] in p:
                    yield from ((rest[:n], *more) for more in each(rest[n:]))
        return sum(math.prod(p[x] for x in s) * s.count(piece) for s in each(u)) / total(u)

    words = [b"a", b"ab", b"abba", b"babab", b"bababab", b"ab" * 7]
    lattice = L.Lattice(words, root)
    assert size == 4 and np.allclose(np.exp(lattice.scores(log[:, None])[:, 0]), [total(u) for u in words])
    for n, piece in enumerate(sorted(p)):
        assert math.isclose(lattice.expected(log, np.array([1.0, 2, 0, 1, 1, 3]))[n], sum(t * uses(u, piece) for t, u in zip((1, 2, 0, 1, 1, 3), words)), rel_tol=1e-9)
    # a run of any length has a probability
    assert np.isfinite(L.Lattice([b"ab" * 50_000], root).scores(log[:, None])).all()


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    search = L.LanguageSearch(d)
    held = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 300").select("doc_id", "text", L.label_code(F.col("lang")).alias("label")).where("label is not null").limit(1500)
    got = {r.id: r.lang_code for r in search.languages(held).collect()}
    right = [got[r.doc_id] == r.label for r in held.select("doc_id", "label").collect()]
    assert sum(right) / len(right) > 0.93  # some labels are wrong
    mixed = "The thermal posterior predicts the smooth feature once translation is taken into account. " * 4 + "Aunque la solución parece incompleta, el resultado depende de las observaciones de los alumnos. " * 4
    odd = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "123 456 !!")], "doc_id long, text string")
    rows = search.stretches(odd).where(L.long_enough()).orderBy("id", "stretch_no").collect()
    assert [(r.id, r.lang_code) for r in rows] == [(1, "en"), (1, "es")] and abs(rows[0].words - 52) <= 2 and min(r.confidence for r in rows) > 0.9
