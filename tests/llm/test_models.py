"""Language model, outliers, secrets, HTML, language ID, toxicity, pipeline."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from texts import CLASH, SCHEMA, SF, rows_of

from pyspark.sql import functions as F

from scoutlake.llm import decontam, extract, hmm, langid, mixing, ngram_join, outliers, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc, modulus, rest=0):
    return zlib.crc32(str(doc if doc is not None else "").encode()) % modulus == rest


def small_model(states=3, size=5):
    rng = np.random.default_rng(1)
    return rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(size), states).T


def test_forward_and_counts_match_enumeration():
    start, move, emit = model = small_model()
    texts = [np.random.default_rng(k).integers(0, 5, n) for k, n in enumerate((4, 1, 6, 3, 4))]
    starts, moves, emissions, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for o in texts:
        total, s, m, e = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for path in itertools.product(range(3), repeat=len(o)):
            p = start[path[0]] * emit[o[0], path[0]]
            for t in range(1, len(o)):
                p *= move[path[t - 1], path[t]] * emit[o[t], path[t]]
            total += p
            s[path[0]] += p
            for t, state in enumerate(path):
                e[o[t], state] += p
                if t:
                    m[path[t - 1], state] += p
        starts, moves, emissions = starts + s / total, moves + m / total, emissions + e / total
        logs.append(math.log10(total))
    symbols = [o.astype("<u2").tobytes() for o in texts]
    got = hmm.expected_counts(model, symbols, 5)
    assert np.allclose(got[0], starts, 1e-4) and np.allclose(got[1], moves, 1e-4) and np.allclose(got[2], emissions, 1e-4)
    exact = np.zeros(len(texts))
    for rows, packed, active, steps in hmm._chunks(symbols):
        exact[rows] = hmm.forward(model, packed, active, steps)
    assert np.allclose(exact, logs)


def test_language_model(spark, documents):
    got = hmm.score_documents(documents).toPandas().set_index("doc_id")
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in documents.collect()}
    counts = Counter(w for d, t in tokens.items() if not held(d, 10) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for doc, t in tokens.items():
        r = got.loc[doc]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), total, held(doc, 10))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert got.score[got.held_out].sum() > got.base_score[got.held_out].sum()


def test_language_model_with_few_known_tokens(spark, monkeypatch):
    """The end token keeps its count when many tokens are more frequent."""
    rows = [(k, " ".join(f"w{k}x{i % 40}" for i in range(80))) for k in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in hmm.score_documents(docs, F.lit(False), 1).collect()}
    monkeypatch.setattr(hmm, "KNOWN", 30)
    few = {r.doc_id: r for r in hmm.score_documents(docs, F.lit(False), 1).collect()}
    total, distinct = 5 * 81, 5 * 40 + 1
    scale = math.log10(total + 0.1 * (distinct + 1))
    want = 80 * (math.log10(2.1) - scale) + math.log10(5.1) - scale
    for doc, r in few.items():
        assert (r.n_tokens, r.n_known) == (81, 81) and math.isclose(r.base_score, want, rel_tol=1e-9)
        assert math.isclose(r.base_score, whole[doc].base_score, rel_tol=1e-9) and math.isfinite(r.score)


def test_cut_texts_start_once():
    """A text of several segments counts one start."""
    model = (np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.full((3, 2), 1 / 3))
    starts, *_ = hmm.expected_counts(model, [np.zeros(3 * hmm.SEGMENT, "<u2").tobytes(), np.zeros(4, "<u2").tobytes()], 3)
    assert np.isclose(starts.sum(), 2)


def test_language_model_edges(edge, empty):
    got = hmm.score_documents(edge, rounds=1).collect()
    assert len(got) == 13 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert hmm.score_documents(empty, rounds=1).collect() == []


def test_base_statistics(documents):
    got = outliers.judge(documents).toPandas().set_index("doc_id")
    for r in documents.collect():
        text = r.text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        twice = {k + i for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for i in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        row = got.loc[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_found_by_group(spark):
    rng = np.random.default_rng(2)
    text = lambda n, mark="": " ".join(f"w{x}{mark}" for x in rng.integers(0, 10**6, n))
    rows = [(k, text(int(rng.integers(80, 200))), "en", "ab"[k % 2]) for k in range(200)]
    rows += [(1000 + k, text(100, "%%%"), "en", "a") for k in range(20)]
    got = outliers.judge(spark.createDataFrame(rows_of(rows), SCHEMA)).toPandas()
    assert got[got.doc_id < 1000].kept.mean() > 0.98 and not got[got.doc_id >= 1000].kept.any()


def test_outlier_in_each_single_statistic(spark):
    rng = np.random.default_rng(6)
    spread = {"log_words": (5.6, 0.5), "log_width": (1.6, 0.1), "symbols": (0, 0), "dup_lines": (0, 0), "repeats": (0.2, 0.5)}
    rows = [("g", *(abs(rng.normal(*spread[c])) if c in spread else 0.0 for c in outliers.VECTOR)) for _ in range(800)]
    plain = [spread[c][0] for c in outliers.VECTOR]
    far = {"log_words": 9.5, "log_width": 2.3, "symbols": 2.0, "dup_lines": 2.4, "repeats": 3.9}
    odd = [("g", *(far[c] if c == one else x for c, x in zip(outliers.VECTOR, plain, strict=True))) for one in outliers.VECTOR]
    schema = "grp string, " + ", ".join(f"{c} double" for c in outliers.VECTOR)
    frame = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else float(v), r)) for r in rows + odd], schema)
    estimate = outliers.estimates(frame)
    apart = [r.d2 for r in outliers._distance(spark.createDataFrame(frame.tail(5), schema), estimate).collect()]
    assert all(d > outliers.LIMIT for d in apart), apart
    assert outliers._distance(frame, estimate).where(f"d2 <= {outliers.LIMIT}").count() > 780
    assert np.isclose(outliers.consistency(0.75, 2), 0.75 / 0.40342640972002736)  # chi-square of 4 at 2 ln 4


def test_small_groups_are_judged_by_their_language(spark):
    rng = np.random.default_rng(7)
    text = lambda n, wide: " ".join("w" * wide + str(x) for x in rng.integers(10**5, 10**6, n))
    rows = [(k, text(int(rng.integers(80, 200)), 1), "en", "a") for k in range(60)]
    rows += [(100 + k, text(int(rng.integers(80, 200)), 9), "fr", f"s{k % 20}") for k in range(60)]
    rows += [(200, text(120, 9), "en", "z"), (201, text(120, 9), "fr", "z"), (202, text(120, 1), "en", "z")]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert (got[200].kept, got[201].kept, got[202].kept) == (False, True, True)


def test_determinant_estimate_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 3, (400, 5))
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in outliers.VECTOR))
    row = outliers._moments(frame).first()
    cov = np.cov(x.T, bias=True) + np.diag(np.square(outliers.FLOOR))
    assert np.allclose(np.array(row["inv"]).reshape(5, 5), np.linalg.inv(cov)) and np.isclose(row["logdet"], np.linalg.slogdet(cov)[1])
    assert outliers.estimates(frame).first()["logdet"] <= row["logdet"]


def test_outlier_edges(edge, empty):
    got = outliers.judge(edge).collect()
    assert len(got) == 13 and not any(r.kept for r in got if r.base_failed)
    assert outliers.judge(empty).collect() == []


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


KEY = "q7ZkP0vXw93LrT5bNcYh28JmDfGa61Ue"


def test_secrets(spark, documents, empty):
    texts = [
        "é🙂 TOKEN = 'abc' token=token:abcdefg Secret: \"x9\" PASSWORD=hunter22 and AKIA" + "Z" * 15 + " AKIA" + "Z" * 16,
        "a" * 30 + " deadbeef" * 4 + " " + "0123456789abcdef" * 2, "api_key:abcdef apikey=\"abcdefg\" passwd  =  qwerty",
        f"here {KEY} stands alone", "thequickbrownfoxjumpsoverthelazydog and internationalization_of_identifiers", "", None,
        "token=abcdefg" * 300,
    ]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    both = documents.select("doc_id", "text").unionByName(docs.select((docs.doc_id + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in secrets.scan(both).collect()}
    for doc, text in [(r.doc_id, r.text or "") for r in both.collect()]:
        spans = plain_spans(text)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    assert got[10**6 + 4].spans == f"markov:5:{5 + len(KEY)}" and got[10**6 + 5].spans == ""
    assert sum(r.n_markov for d, r in got.items() if d < 10**6) == 0
    clean = {r.doc_id: r for r in secrets.redacted(docs, secrets.train(both)).collect()}
    assert secrets.redacted(docs).columns == docs.columns and clean[4].text == "here [secret] stands alone"
    assert clean[4].n_chars == len(clean[4].text) and clean[7].text is None and clean[6].text == "" and clean[5].text == texts[4]
    assert secrets.scan(empty).collect() == [] and secrets.redacted(empty).collect() == []


def test_secrets_of_short_runs_and_beside_known_forms(spark, documents):
    rng = np.random.default_rng(8)
    signs = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    key = lambda n: "".join(rng.choice(signs, n))
    digest = "0123456789abcdef" * 2
    texts = [f"here {key(n)} it is" for n in (9, 10, 12, 14, 16, 19) for _ in range(5)]
    texts += [f"here prefix_{digest}_{key(24)} it is", "AKIA" + "Q" * 16 + "x7kd93mfq8z2vb5w", "JavaScript and MAX_BUFFER_SIZE", "token=abcdefg" * 300 + " ok"]
    model = secrets.train(documents)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, model).collect()}
    assert sum(clean[k] == "here [secret] it is" for k in range(1, 31)) >= 29
    got = {r.doc_id: r for r in secrets.scan(docs, model).collect()}
    kinds = [x.split(":")[0] for x in got[31].spans.split(",")]
    assert kinds == ["hex", "markov"] and clean[31].startswith("here prefix_[secret]") and clean[31].endswith("[secret] it is")
    assert (got[32].n_access, got[32].n_markov) == (1, 1) and clean[32] == "[secret][secret]"
    assert clean[33] == texts[32] and got[34].n_markov == 0


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    for r in pages.collect():  # these pages have one article each
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        pieces = re.split(r"</?(?:p|h1|div)[^>]*>", body)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in pieces]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)


def test_html_edges(spark):
    prose = "A long sentence, with some commas, that tells a story, and goes on for a while, as stories do. " * 3
    shell = "<html><body><div class='menu'><a href=/>Home</a></div><div id=content>%s</div><div class='sidebar'>%s</div></body>"
    cases = {
        shell % (f"<p>{prose}<p>{prose}<script>var a='</p>';if(a<b){{}}</script>", "<p>" + prose + "</p>"): 2,
        f"<div><div><p>{prose}</p></div><div class='comments'><p>{prose}</p></div><form><p>{prose}</p></form></div>": 1,
        f"<main><p>{prose}</p><ul><li><a href=x>{prose}</a></li></ul></main>": None,
        "<nav><a>only</a></nav>": 0, "": 0, "plain text, no markup at all": 1, "<p>a &amp; b &lt;c&gt; &eacute;</p>": 1,
        "<div>" * 3000 + f"<p>{prose}</p>": 1, "<p>unclosed <b>bold": 1, "<!-- <p>hidden</p> --><p>shown, yes</p>": 1,
    }
    rows = [(k, "u", page, "x") for k, page in enumerate(cases)] + [(None, None, None, None)]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k, want in enumerate(cases.values()):
        if want is not None:
            assert len([x for x in got[k].text.split("\n") if x]) == want, k
        assert got[k].n_chars == len(got[k].text)
    assert got[None].text == "" and got[6].text == "a & b <c> é"
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_rows_short_siblings_and_stray_signs():
    prose = "A long sentence, with some commas, that tells a story, and goes on for a while, as stories do. "
    row = "<div class=row><div class=col><p>%s</p></div><div class=col><p>%s</p></div></div>"
    rows = "".join(row % (f"r{k} {prose * (k + 1)}", f"s{k} {prose}") for k in range(3)) + row % ("Short one.", "Ok.")
    links = "<div class=list><a href=x>one link</a> <a href=y>another link</a></div>"
    for page in (f"<body><article>{rows}{links}</article></body>", f"<body>{links}<div class=page>{rows}<p>{prose}</p></div></body>"):
        got = extract.main_text(page).split("\n")
        assert [x.split()[0] for x in got[:8]] == ["r0", "s0", "r1", "s1", "r2", "s2", "Short", "Ok."] and "link" not in " ".join(got)
    quote = f"<blockquote><p>{prose * 3}</p><p>{prose * 3}</p></blockquote>"
    for shell in ("<article>%s</article>", "<div>%s</div>"):
        got = extract.main_text(shell % f"<p>Before.</p>{quote}<p>He said no.</p><p>After.</p>").split("\n")
        assert (got[0], got[-2], got[-1]) == ("Before.", "He said no.", "After.")
    assert extract.main_text("<p>I <3 this. It's fine.</p><p>para two isn't lost?</p>") == "I <3 this. It's fine.\npara two isn't lost?"
    assert extract.main_text("<p>a < b, it's so.</p><p title='x > y'>two</p><p data=it's>three's</p>") == "a < b, it's so.\ntwo\nthree's"
    assert extract.main_text("<script>if(a<b){x='</script><p>one</p><p>it's</p>") == "one\nit's"


def test_html_of_open_and_stray_tags_is_read_in_linear_time():
    """A walk over all open elements a tag would take minutes on each of these pages."""
    many = {
        "open": "<b><p>some text" * 30000, "stray": "<div></i></span></p>x" * 30000, "nested": "<div>text of a level, long enough" * 20000,
        "border": "<p><td>" + "<b>" * 20000 + "<hr>x" * 20000, "items": "<ul><li>" + "<b>x" * 20000 + "<li>y" * 20000,
        "raw": "<title>" + "</title " * 60000,
    }
    for name, page in many.items():
        begun = time.perf_counter()
        extract.main_text(page)
        assert time.perf_counter() - begun < 10, name


def test_html_tags_end_what_is_open_inside_their_borders_only():
    prose = "A long sentence, with some commas, that tells a story, and goes on for a while, as stories do. "
    def names(node):
        return [(c.name, names(c)) for c in node.children if isinstance(c, extract.Node)]
    assert names(extract.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")) == [
        ("ul", [("li", [("ul", [("li", []), ("li", [])])]), ("li", [])])]
    assert names(extract.parse("<table><tr><td>a<td>b<tr><th>c</table><p>d<p>e</b></p></p>f")) == [
        ("table", [("tr", [("td", []), ("td", [])]), ("tr", [("th", [])])]), ("p", []), ("p", [])]
    assert names(extract.parse("<p>a<b>b<div>c<p>d</div>e")) == [("p", [("b", [])]), ("div", [("p", [])])]
    for word in ("related-work", "post-share", "promo-text", "notice"):  # prose before class
        assert extract.main_text(f'<div><nav>y</nav><p class="{word}">{prose * 5}</p></div>') == (prose * 5).strip()
        assert extract.main_text(f'<p class="{word}">{prose}</p>') == ""
        assert extract.main_text(f'<article><p>{prose}</p><p class="{word}">{prose * 5}</p></article>') == prose.strip()
    assert extract.main_text(f"<form><p>{prose * 5}</p><select><option>x</select></form>") == (prose * 5).strip()
    assert extract.main_text(f'<div class="comments"><p class="related">{prose * 5}</p></div>') == ""


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(got.held_out == [held(d, 4, 2) for d in got.doc_id])
    apart = got[got.held_out]
    assert (apart.lang == apart.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_rejects_what_is_no_language_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = [
        "Сегодня утром дети играли в саду и смеялись над старой собакой соседа, которая спала под деревом",
        "今日は朝から天気がとても良いので、公園へ散歩に行きました。帰りに本屋へ寄った。",
        "Aamulla lapset leikkivät puutarhassa ja nauroivat naapurin vanhalle koiralle joka nukkui puun alla",
        "xkqz vbnrt wpldk zzxcv qwrtp lkjhg mnbvc xzqwk jfhgd pptrw kjsdf zxqwv",
    ]
    # Nor is a language that was left out.
    rest = docs.where("lang <> 'es'").withColumn("held_out", F.lit(False))
    left = docs.where("lang = 'es' and length(text) > 400").withColumn("held_out", F.lit(True))
    more = spark.createDataFrame([(-1 - k, t, None, None, None) for k, t in enumerate(strange)], docs.schema)
    table = rest.unionByName(left).unionByName(more.withColumn("held_out", F.lit(True)))
    got = langid.identify(table, ~F.col("held_out")).select("row.*", "rejected").toPandas()
    assert got[got.doc_id < 0].rejected.all()
    assert got[got.lang == "es"].rejected.mean() > 0.9
    assert got[(got.lang != "es") & (got.doc_id >= 0)].rejected.mean() < 0.005


def test_language_id_edges(edge, empty):
    got = langid.predictions(edge).collect()
    assert len(got) == 13
    for r in got:
        if r.doc_id in (2, 3, 4, 10):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "fr", "de")
    assert langid.predictions(empty).collect() == []
    kept = langid.accepted(edge)
    assert kept.columns == edge.columns and set(CLASH) <= set(kept.columns)


def test_language_id_and_mixing_send_each_text_to_python_once(edge, monkeypatch):
    sent = []
    for module in (langid, mixing):
        run = module.arrow_map
        monkeypatch.setattr(module, "arrow_map", lambda df, *rest, run=run: sent.append(df.columns) or run(df, *rest))
    langid.identify(edge)
    mixing.sizes(edge)
    assert sent == [["row", "held_out"], ["row", "source", "draw"]]


def test_language_id_of_many_small_slices_is_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    names = sorted(r[0] for r in docs.select("lang").distinct().collect())
    rows = docs.orderBy("doc_id").limit(200).collect()
    batch = pa.record_batch([pa.array([r.text for r in rows]), pa.array([names.index(r.lang) for r in rows])], names=["text", "code"])
    whole = langid._fit(len(names))(batch)
    monkeypatch.setattr(langid, "SLICE", 3000)
    parts = langid._fit(len(names))(batch)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def test_language_id_learns_nothing_from_texts_without_words(spark):
    docs = spark.createDataFrame([(k, " \t ", "en", "a", 3) for k in range(20)] + [(20, "some words", None, "a", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.rejected for r in langid.predictions(docs).collect()] == [True] * 21


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert all(got.held_out == [held(d, 5) for d in got.doc_id])
    apart = got[got.held_out]
    rank, toxic = apart.score.rank(), apart.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9 and (apart.predicted[~toxic] == 1).mean() < 0.05


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0, "x"), (7, 1, "x"), (8, None, "x"), (None, 1, "x"), (99, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(edge, labels).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_documents(empty, labels).collect() == []
    assert all(r.predicted == 0 for r in toxicity.score_documents(edge, labels.limit(0)).collect())


def test_pipeline(spark, edge, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_duplicates", "decontamination", "secret_scan", "source_mixing"]
    kept = corpus_pipeline.duplicates_stage(spark, docs, SF)
    found = ngram_join.ngram_components(docs, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.component_id for r in found.select("component_id").distinct().collect())
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "repeats"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids <= {r.doc_id for r in kept.collect()}
    assert not ids & {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    got = corpus_pipeline.duplicates_stage(spark, edge, SF).collect()  # null ids stay, repeated ids become one row
    assert sorted((r.doc_id for r in got), key=str).count(1) == 1 and sum(r.doc_id is None for r in got) == 2


def test_every_stage_on_edges_and_clashing_names(spark, edge, empty):
    names = ("gone", "twice", "of", "component_id", "Repeats", "row", "doc", "rejected")
    for table in (edge, empty):
        wide = table
        for c in names:
            wide = wide.withColumn(c, F.lit("mine"))
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, wide, SF)
            rows = out.collect()
            kept = [c for c in wide.columns if name != "source_mixing" or c != "Repeats"]
            assert out.columns == [*kept, "repeats"] if name == "source_mixing" else out.columns == kept
            assert len(rows) <= edge.count() and all(r["gone"] == "mine" for r in rows)
            assert rows or table is empty or name == "language_id"


def test_least_of_repeated_rows_stays(spark):
    rows = rows_of([(1, "b " * 30, "en", "s"), (1, "a " * 30, "en", "s"), (1, "a " * 30, "en", "r"), (2, "other text", "en", "s")])
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.duplicates_stage(spark, spark.createDataFrame(order, SCHEMA), SF).collect()
        assert {(r.doc_id, r.text[:1], r.source) for r in got} == {(1, "a", "r"), (2, "o", "s")}


def test_texts_are_not_shuffled_to_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        for step in (corpus_pipeline.duplicates_stage, corpus_pipeline.decontamination_stage):
            plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
