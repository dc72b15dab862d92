"""Encoding, counting, cleaning, scoring and classifying: small cases against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeq.llm import bpe, html_text, language_id, lm_score, quality_rules, token_counts, toxicity

ODD_TEXTS = [
    "", " ", "a", "  two  blanks\n\nand lines \t ", "it's IT'S we'll", "ΟΔΥΣΣΕΥΣ ΑΣ Σ", "İstanbul ﬁ Å é", "日本 १२ ½ ²", "x" * 5000,
    "a<|endoftext|>b <|startoftext|>C <|ENDOFTEXT|>", "\x1c\x85​  end", "emoji 😀😀 <| |>", "tab\tnew\x0bline\x0c\r\n",
]


def documents(spark, texts, start=0):
    """Documents with a null text and columns whose names operators use inside."""
    rows = [(i + start, t, "x", "y", 1) for i, t in enumerate([*texts, None])]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, k string, n int")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    own, known = bpe.Vocabulary(open(path, "rb").read()), Tokenizer.from_file(path)
    draw = random.Random(5)
    letters = "abc ABCΣσİß\n\t\x0b\x1c\x85 '’sStdre09²Ⅷ٣日한éÅ<|>.,!?😀"
    for t in ODD_TEXTS + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(400)]:
        want = known.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert " ".join(g[1] for g in got) == " ".join(map(str, want)), t
        if own.suffix:
            assert " ".join(g[2] for g in got) == known.decode(want, skip_special_tokens=False)


def test_encode_keeps_rows_and_ignores_other_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, ODD_TEXTS)
    docs = docs.union(docs.limit(3))
    rows = bpe.encode(docs, path, keep=("doc_id", "t"), outputs=("ids", "ids_text", "decoded")).collect()
    known = Tokenizer.from_file(path)
    assert len(rows) == len(ODD_TEXTS) + 4
    for r in rows:
        text = ODD_TEXTS[r["doc_id"]] if r["doc_id"] < len(ODD_TEXTS) else ""
        ids = known.encode(text, add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["ids_text"], r["t"]) == (ids, len(ids), " ".join(map(str, ids)), "x")
        assert r["decoded"] == known.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_counts_join_frequent_and_rare_pieces_alike(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    texts = [*ODD_TEXTS, "the the the cat", "the cat sat the"]
    for frequent in (0, 2, 1000):
        rows = token_counts.count_tokens(documents(spark, texts).union(documents(spark, texts)), path, frequent=frequent).collect()
        assert len(rows) == 2 * len(texts) + 2
        for r in rows:
            text = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
            assert r["n_tokens"] == len(known.encode(text, add_special_tokens=False).ids), (frequent, text)
            assert r["n_bytes"] == len(text.encode())
    assert token_counts.count_tokens(documents(spark, texts).limit(0), path).count() == 0


def test_lines_are_judged_alone():
    fine = "A plain sentence with a good number of words in it, said twice over."
    judged = lambda line: quality_rules.fails(line, line.encode().split())
    assert judged(fine) is None
    assert judged("home | about | contact | more here too for you.") in ("symbols", "navigation")
    assert judged("Home · News · Sport · Weather") == "navigation"
    assert judged("THIS LINE IS SHOUTED ALL THE WAY TO ITS END.") == "capitals"
    assert judged("no end") == "punctuation"
    assert judged("It is said here. Then the line goes on for more than ten words without end") is None
    assert judged("Licensed under the terms of some licence, as said before.") == "boilerplate"
    assert judged("a # b # c # d.") == "symbols"


def test_clean_counts_and_verdict(spark):
    line = "One two three four five six seven eight nine ten eleven twelve words stand here."
    unlike = "\n".join(" ".join(f"{w}{i}" for w in line[:-1].split()) + "." for i in range(6))
    texts = ["", unlike, unlike + "\nmenu | a | b | c | d", "a a a a", line + "\n" + line + "\n", unlike + "\n" + "JUNK TEXT " * 60]
    rows = {r["doc_id"]: r for r in quality_rules.clean(documents(spark, texts)).collect()}
    assert len(rows) == len(texts) + 1
    assert rows[1]["kept"] and rows[1]["text_clean"] == unlike
    assert rows[2]["kept"] and rows[2]["text_clean"] == unlike and rows[2]["n_lines_removed"] == 1
    assert (rows[3]["n_words"], rows[3]["n_repeat_words"], rows[3]["base_failed"]) == (4, 4, True)
    assert rows[4]["n_dup_lines"] == 1 and rows[4]["n_repeat_words"] == 30
    assert not rows[5]["kept"] and not rows[0]["kept"] and rows[len(texts)]["n_words"] == 0
    assert quality_rules.clean(documents(spark, texts).limit(0)).count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy, now.</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b>ed&nbsp; text,<br>next line.<p>Second one. With two.
    <ul><li>item a, yes.<li>item b</ul><div class="comments"><p>Nice, very nice.</p></div></article>
    <aside>Other, things.</aside><form>Search</form><footer>&copy; me.</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst bolded text, next line.\nSecond one. With two.\nitem a, yes.\nitem b"
    loose = "<div><div id='main-menu'>x y</div><p>A long sentence, with commas, stands here.</p><p>And, another one.</p><div>z</div></div>"
    assert html_text.main_text(loose) == "A long sentence, with commas, stands here.\nAnd, another one."
    for odd in ("", "<", "<p", "</p></div>", "<!-- open", "<p title='>'>", "<script>never closed"):
        html_text.main_text(odd)
    assert html_text.main_text("only text") == "only text"


def test_main_text_without_landmarks():
    long = " ".join(["Some words, and more of them, stand in here."] * 9)
    items = [f"Item {i} of the list that has some words, here" for i in range(6)]
    cells = [f"{i}" for i in range(6)]
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(6)) + "</ul>"
    page = (
        f"<html><body>{menu}<div><h1>A title of the page without any mark at its end</h1><p>{long}</p><ul><li>" + "<li>".join(items)
        + f"</ul><p>{long}</p><h2>Next</h2><p>{long}</p><table><tr><td>" + "<td>".join(cells) + f"</table><p>{long}</p><pre>x = 1</pre></div><div><div>{menu}</div></div></body></html>"
    )
    want = ["A title of the page without any mark at its end", long, *items, long, "Next", long, *cells, long, "x = 1"]
    assert html_text.main_text(page) == "\n".join(want)
    huge = " ".join([long] * 100)
    page = f"<div><p>{long}</p><blockquote>{huge}</blockquote><p>{long}</p><pre>{huge}</pre><p>{long}</p></div><div>Go</div>"
    assert html_text.main_text(page) == "\n".join([long, huge, long, huge, long])


def test_hints_do_not_outweigh_content():
    p = "<p>A long sentence, with commas, stands here.</p><p>And, another one.</p>"
    want = "A long sentence, with commas, stands here.\nAnd, another one."
    comments = "<div class='comments'><div class='comment'><article><p>Nice, very.</p></article></div></div>"
    for page in (
        f"<div class='content has-sidebar'><article>{p}</article>{comments}</div>",
        f"<div id='page-header-wrap'><div>{p}</div><div class='menu'>Go, on.</div></div>",
        f"<article><div class='post share'>{p}<div class='share'>Send, it.</div></div></article>",
        f"<main><div class='social'>Follow, us.</div><div class='has-sidebar'><div id='header-x'>{p}</div></div></main>",
        f"<div>{p}</div>{comments}",
    ):
        assert html_text.main_text(page) == want, page
    page = "<article><figure><figcaption>A figure, shown.</figcaption></figure><map name=m><p>Mapped text.</p></map><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>"
    assert html_text.main_text(page) == "A figure, shown.\nMapped text.\nSo x=1 holds."


def test_pages_keep_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, None, None, "t"), (2, "v", "", None)], "page_id long, url string, html string, t string")
    rows = html_text.extract(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == [(1, "", 0), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 5, 6, 12, 40):
        code = language_id.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
        apart = min([(code[i] != code[j]).sum() for i in range(k) for j in range(i)] or [1])
        assert apart >= (1 if k < 4 else code.shape[1] // 4)


def test_languages(spark):
    draw = random.Random(1)
    kinds = {"aa": "kla bru sto".split(), "bb": "ñéo ita uso".split(), "cc": "shi tsu koro".split()}
    texts = [(l, " ".join("".join(draw.choices(s, k=2)) for _ in range(30))) for l, s in kinds.items() for _ in range(30)]
    rows = [(i, t, l) for i, (l, t) in enumerate(texts)] + [(900, None, "aa"), (901, "", "bb"), (902, "12 ... 34", None), (903, texts[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("k", F.lit(0))
    model = language_id.learn(docs.filter("doc_id % 3 <> 1"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == l and 0 <= got[i]["score"] <= 1 for i, (l, _) in enumerate(texts))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert (got[903]["lang_pred"], got[903]["score"]) == (got[0]["lang_pred"], got[0]["score"])
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(90)) | {903}
    nothing = language_id.learn(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identified(docs, nothing).count() == 91
    assert language_id.identify(docs.limit(0), model).count() == 0
    mixed = " ".join(t for _, t in texts[:1]) + " " + texts[31][1]
    assert model.predict(mixed)[0] in ("aa", "bb")


def lm_texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    return [" ".join(draw.choices(words, k=draw.randint(0, 25))).title() for _ in range(60)] + ["", "never seen here", "w1\tw2\n"]


def test_lm_base_is_exact_and_ways_agree(spark):
    docs = documents(spark, lm_texts())
    docs = docs.union(docs.limit(2))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    from tradeq.llm.common import held_out

    rows = docs.collect()
    tokens = [((r["text"] or "").encode().lower().split() + [b"\n"], held(r["doc_id"])) for r in rows]
    count = Counter(w for t, h in tokens if not h for w in t)
    total, distinct = sum(count.values()), len(count)
    seen = {}
    for frequent in (0, 7, 1000):
        got = lm_score.score(docs, ~held_out("doc_id", 5, 1), frequent=frequent).collect()
        assert len(got) == len(rows)
        for r in got:
            t = (rows[r["doc_id"]]["text"] or "").encode().lower().split() + [b"\n"]
            want = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
            assert r["base_score"] == pytest.approx(want) and r["train_tokens"] == total
            assert (r["n_tokens"], r["n_known"]) == (len(t), sum(w in count for w in t))
            if frequent == 7:
                seen[r["doc_id"]] = r["score"]
    assert all(s < 0 for s in seen.values())
    empty = lm_score.score(docs, F.lit(False)).collect()
    assert {(r["train_tokens"], r["score"]) for r in empty} == {(0, 0.0)}
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0


def test_automaton_is_a_distribution(spark):
    docs = documents(spark, lm_texts()).select(F.col("text").alias("t"))
    words = lm_score.learn_words(lm_score.count_words(docs), 1000)
    sent = spark.sparkContext.broadcast(words)
    graph = lm_score.build(words, lm_score.count_grams(docs, sent).toPandas())
    single = {int(n): (c - words.discount) / words.total for n, c in zip(words.number, words.n)}

    def probability(state, v):
        w = 0.0
        while state * lm_score.PAIRS + v not in graph.arcs:
            w += graph.weight[state]
            state = graph.fail[state]
        return 10 ** (w + graph.arcs[state * lm_score.PAIRS + v])

    def backed(state):
        w = 0.0
        while state:
            w += graph.weight[state]
            state = graph.fail[state]
        return 10**w

    states = [0, lm_score.BEGIN + 1, 1, 2, lm_score.PAIRS + 2, lm_score.PAIRS + 2 + lm_score.TRIPLES + 3]
    for s in states:
        all_words = sum(probability(s, v) for v in single) + backed(s) * words.unknown
        assert all_words == pytest.approx(1.0, abs=1e-6)
    assert any(k // lm_score.PAIRS > lm_score.PAIRS + 1 for k in graph.arcs), "no arc of three words"


def test_toxicity(spark):
    draw = random.Random(9)
    syllables = "ba ko ri mu te sa lo ni".split()
    word = lambda: "".join(draw.choices(syllables, k=3))
    texts, labels = [], []
    for i in range(240):
        w = [word() for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for at in draw.sample(range(40), 5):
                w[at] = draw.choice(["vexgrump", "zzfoulish", "quonkhead"])
        texts.append(" ".join(w))
        labels.append((i, int(toxic), "x"))
    docs = documents(spark, [*texts, ""])
    marks = spark.createDataFrame([*labels, (0, 1, "x"), (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, t string")
    model = toxicity.learn(docs, marks.filter("doc_id IS NULL OR doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= 0.3) != bool(y) for i, y, _ in labels if i % 3 == 0)
    assert wrong <= 3
    assert got[240] == got[241] < 0.3
    one_kind = toxicity.learn(docs, marks.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, one_kind).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_lm_scores_use_every_pair_and_triple(spark):
    texts = [*lm_texts(), "rare1 rare2 rare3 w1", "rare1 rare2 rare3 w2", "w2 rare1 rare2 seldom", "w5 w6 rare9 w5 w6"]
    docs = documents(spark, texts)
    tokens = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    train = [tokens(t) for i, t in enumerate([*texts, None]) if i % 4 != 2]
    count = {o: Counter(tuple(x[i : i + o]) for x in train for i in range(len(x) - o + 1)) for o in (2, 3)}
    count[1] = Counter((w,) for x in train for w in x[1:])
    d = {}
    for o, c in count.items():
        once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
        d[o] = once / (once + 2 * twice) if once and twice else 0.5
    total, kinds = Counter(), Counter()
    for o in (2, 3):
        for g, n in count[o].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
    all_words = sum(count[1].values())

    def probability(g):
        if len(g) == 1:
            return (count[1][g] - d[1]) / all_words if count[1][g] else d[1] * len(count[1]) / all_words
        h = g[:-1]
        if not total[h]:
            return probability(g[1:])
        return (max(count[len(g)][g] - d[len(g)], 0) + d[len(g)] * kinds[h] * probability(g[1:])) / total[h]

    for frequent in (0, 7, 1000):  # where values are looked up changes nothing
        got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, F.expr("doc_id % 4 <> 2"), frequent=frequent).collect()}
        for i, t in enumerate([*texts, None]):
            x = tokens(t)
            want = sum(math.log10(probability(tuple(x[max(0, k - 2) : k + 1]))) for k in range(1, len(x)))
            assert got[i] == pytest.approx(want, abs=1e-9), (frequent, i)
