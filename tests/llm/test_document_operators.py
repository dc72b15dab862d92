"""Near-duplicates, repeated passages, benchmark items and the pipeline against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradeq.llm import decontaminate, near_dedup, suffix_dedup

ODD = "doc_id long, text string, v long, bucket string, k int"


def frame(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 7, "b", 1) for i, t in rows], ODD)


def near_copies(seed=2):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (4, 9, 60, 120, 250):
        base = draw.choices(words, k=size)
        for edits in (0, 0, 0, 1, 1, 2, 3, 5, 8, 13):
            text = list(base)
            for _ in range(edits):
                text[draw.randrange(size)] = draw.choice(words)
            rows.append((n, " ".join(text).upper() if n % 3 else " ".join(text)))
            n += 1
    rows += [(n, ""), (n + 1, " \n"), (n + 2, None), (None, rows[0][1]), (None, None), rows[3], rows[3], (5, "other words under a known id")]
    return rows


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.append((i, frozenset(s)))
    nodes = sorted({s for i, s in sets if s and i is not None}, key=lambda s: sorted(s))
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(nodes)), 2):
        both = len(nodes[a] & nodes[b])
        if both * 100 >= 85 * (len(nodes[a]) + len(nodes[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for i, s in sets:
        if s and i is not None:
            c = root(nodes.index(s))
            least[c] = min(i, least.get(c, i))
    return sorted((str(i), len(s), str(least[root(nodes.index(s))] if s and i is not None else i)) for i, s in sets)


@pytest.mark.parametrize("few", [16, 0])
def test_components_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)  # 0: every bucket counts as crowded
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rows = near_copies()
    got = near_dedup.groups(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)


def test_near_dedup_odd_inputs(spark):
    docs = frame(spark, near_copies())
    assert near_dedup.groups(docs.limit(0)).count() == 0
    alone = frame(spark, [(1, "a b c"), (2, "d e f"), (3, None)])
    assert sorted(r["component_id"] for r in near_dedup.groups(alone).collect()) == [1, 2, 3]
    kept = near_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    expected = {c: 0 for _, _, c in brute_components(near_copies())}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {str(i) for i in ids} <= set(expected) | {"None"} and ids.count(None) == 2


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(4)
    for j in (0.5, 0.85, 0.95):
        ups = []
        for _ in range(20):
            union = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
            only = int((1 - j) * 1000 / 2)
            x, y = union[only:], union[: 1000 - only]
            a, b = near_dedup.sketch(x), near_dedup.sketch(y)
            assert (near_dedup.merge(a, b) == near_dedup.sketch(union)).all()
            grid = np.linspace(0, 1, 201)
            like = near_dedup.log_likelihood(grid, np.array(0.5), np.array((a > b).sum()), np.array((a < b).sum()))
            ups.append(grid[like.argmax()])
            ok = near_dedup.may_link(np.array([len(x)]), np.array([len(y)]), a[None], b[None], 0.85)[0]
            assert ok if j >= 0.85 else not ok
        assert abs(np.mean(ups) - j) < 0.03
    short, long = draw.integers(0, 99, 10, dtype=np.uint64), draw.integers(0, 99, 20, dtype=np.uint64)
    assert not near_dedup.may_link(np.array([10]), np.array([20]), near_dedup.sketch(short)[None], near_dedup.sketch(long)[None], 0.85)[0]


def test_near_duplicate_stage_links_from_four_fifths(spark):
    draw = random.Random(14)
    rows, linked = [], set()
    for i in range(40):
        base = [f"w{draw.randrange(10**9)}" for _ in range(120)]
        last = i % 4  # 106, 105, 104, 103 of 126, 127, 128, 129 shingles: 0.841, 0.827, 0.812, 0.798
        other = [f"x{i}" if k in (40, 80) or k >= 120 - last else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        if last < 3:
            linked.add(2 * i + 1)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - linked
    assert {r["doc_id"] for r in near_dedup.without_copies(frame(spark, rows)).collect()} == {i for i, _ in rows}


def test_first_looks_follow_the_threshold():
    assert (near_dedup.banding(85), near_dedup.least_agreeing(85)) == ((42, 6), 82)
    for threshold in (30, 50, 70, 80, 85, 95):
        j = threshold / 100
        n, rows = near_dedup.banding(threshold)
        assert n * rows <= near_dedup.REGISTERS and n <= near_dedup.NUMBER + 1 and (1 - j**rows) ** n < 1e-8
        chance = [math.comb(near_dedup.RIDING, k) * j**k * (1 - j) ** (near_dedup.RIDING - k) for k in range(near_dedup.least_agreeing(threshold))]
        assert sum(chance) < 1e-7


def brute_spans(rows, n=50):
    least, words = {}, {}
    for i, t in rows:
        if i is not None:
            w = tuple((t or "").lower().split())
            words[i] = w
            least[w] = min(i, least.get(w, i))
    where = {}
    for w, i in least.items():
        for s in range(len(w) - n + 1):
            where.setdefault(w[s : s + n], []).append((i, s))
    marks = {}
    for places in where.values():
        first = min(i for i, _ in places)
        if any(i != first for i, _ in places):
            for i, s in places:
                marks.setdefault((i, i != first), set()).add(s)
    out = []
    for (i, removed), starts in marks.items():
        run = None
        for s in sorted(starts):
            if run and s <= run[1]:
                run[1] = s + n
            else:
                run = [s, s + n]
                out.append((i, run, removed))
    out = [(i, r[0], r[1], x) for i, r, x in out]
    for i, w in words.items():
        if len(w) >= n and sum(x == w for x in words.values()) > 1:
            out.append((i, 0, len(w), least[w] != i))
    return sorted(out)


def passages():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(draw.choices(words, k=k))
    common, long, short = text(60), text(130), text(49)
    rows = [(i, f"{text(draw.randint(0, 40))} {common}\n{text(draw.randint(0, 30))}") for i in range(40)]
    rows += [(100 + i, f"{text(20)} {long if i % 2 else long[40:]} {text(5)} {common.upper()}") for i in range(6)]
    rows += [(200 + i, f"{text(9)} {short} {text(9)}") for i in range(4)]
    rows += [(300, "x " * 200), (301, "x " * 70 + text(10)), (302, text(70)), (303, None), (304, ""), (305, " ")]
    same = text(80)
    rows += [(400, same), (401, same), (402, same.upper()), (402, same.upper()), (None, same), (None, None), (500, text(3000) + " " + common)]
    return rows


def test_spans_equal_brute_force(spark):
    rows = passages()
    got = suffix_dedup.spans(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["removed"]) for r in got) == brute_spans(rows)
    assert suffix_dedup.spans(frame(spark, rows).limit(0)).count() == 0


def test_cut_texts(spark):
    assert suffix_dedup.cut("a b  c\nd e", [(1, 3)]) == "a d e"
    assert suffix_dedup.cut("é b c", [(0, 1), (2, 3)]) == "b "
    rows = passages()
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    done = suffix_dedup.without_repeats(docs, length="n_chars")
    assert done.columns == docs.columns
    got = done.collect()
    assert len(got) == len(rows)
    spans = {}
    for i, a, b, removed in brute_spans(rows):
        if removed:
            spans.setdefault(i, []).append((a, b))
    want = sorted((str(i), suffix_dedup.cut(t, spans.get(i, [])) if t else t) for i, t in rows if i is not None)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["doc_id"] is not None) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def items_and_documents():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    text = lambda k: " ".join(draw.choices(words, k=k))
    items = [(i, (text(draw.randint(8, 70)) + (".\n" if i % 2 else ". ") + text(draw.randint(1, 12))).capitalize()) for i in range(330)]
    items += [(330, "two words"), (331, ""), (332, None), (None, text(20)), items[3], (3, text(15))]
    rows = [(i, text(draw.randint(0, 200))) for i in range(30)]
    for i in range(60):
        item = items[draw.randrange(330)][1]
        if i % 5 == 4:
            w = item.split()
            w[len(w) // 2] = "changed"
            item = " ".join(w)
        rows.append((100 + i, f"{text(draw.randint(0, 90))} {item.upper() if i % 3 else item} {text(draw.randint(0, 90))}"))
    rows += [(500, None), (501, ""), (502, " "), (503, items[-2][1] or ""), rows[31], (None, rows[31][1]), (504, "say two words here")]
    return items, rows


def brute_items(items, rows):
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    out = []
    known = [(i, t, (t or "").lower().split()) for i, t in dict.fromkeys(items)]
    for d, t in rows:
        have = runs((t or "").lower().split())
        for i, _, w in known:
            shared = len(runs(w) & have)
            if w and shared >= 0.8 * len(runs(w)):
                out.append((str(d), str(i), shared, len(runs(w))))
    return sorted(out)


def test_items_equal_brute_force(spark, monkeypatch):
    items, rows = items_and_documents()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    docs = frame(spark, rows)
    want = brute_items(items, rows)
    assert len(want) > 50
    found = lambda: sorted((str(r["doc_id"]), str(r["item_id"]), r["n_shared"], r["n_runs"]) for r in decontaminate.find(docs, bench).collect())
    assert found() == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 4000)
    monkeypatch.setattr(decontaminate, "BLOCKS", 5)
    assert found() == want
    clean = decontaminate.without(docs, bench)
    assert clean.columns == docs.columns
    dirty = {d for d, *_ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if str(d) not in dirty)
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.without(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_items_are_found_in_parts_and_without_rare_words(spark):
    draw = random.Random(21)
    text = lambda k, p="w": " ".join(f"{p}{draw.randrange(10**6)}" for _ in range(k))
    question, answer, rest = text(30), text(30), text(9000, "x")
    common = [f"c{i}" for i in range(70)]
    rare = text(8)
    # one item's rare words stand together; the others share its common words, which weigh little
    items = [(1, f"{question}.\n{answer}"), (2, " ".join([*common[:35], rare, *common[35:]]) + ".\n" + " ".join(common[:20]))]
    items += [(10 + i, " ".join(draw.sample(common, 60)) + ".\nyes") for i in range(60)]
    rows = [(1, f"{question}. {rest} {answer}"), (2, f"{answer} {rest} {question}."), (3, f"{question}. {rest}")]
    rows += [(4, " ".join([*common[:35], "other", *common[35:]]) + ".\n" + " ".join(common[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_items(items, rows)
    assert {(d, i) for d, i, *_ in want} == {("1", "1"), ("2", "1"), ("4", "2")}
    got = decontaminate.find(frame(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["n_shared"], r["n_runs"]) for r in got) == want
    assert [r["doc_id"] for r in decontaminate.without(frame(spark, rows), bench).collect()] == [3]


def test_wand_equals_exhaustive_scores():
    draw = random.Random(1)
    weights = []
    for _ in range(90):
        w = {f"t{t}".encode(): draw.random() for t in draw.sample(range(40), draw.randint(1, 12))}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    items = [decontaminate.Item(i, [], set(), set(), set()) for i in range(90)]
    segment = decontaminate.Segment(8, items, weights)
    segment.block = 9
    segment.most = np.zeros((len(segment.postings), 10), np.float32)
    for t, list_ in enumerate(segment.postings):
        for i, x in list_:
            segment.most[t, i // 9] = max(segment.most[t, i // 9], np.float32(x))
    for threshold in (0.2, 0.5, 0.9):
        terms = draw.sample(sorted(segment.terms), 20)
        query = [segment.terms[t] for t in terms]
        got = [hit for b in range(10) for hit in segment.wand(query, b, threshold)]
        want = [(i, s) for i, w in enumerate(weights) if (s := sum(w.get(t, 0) for t in terms)) >= threshold]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_pipeline_equals_its_parts(spark, tmp_path):
    draw = random.Random(12)
    kinds = {"aa": "kla bru sto mi".split(), "bb": "ñéo ita uso da".split()}
    text = lambda l, k: " ".join("".join(draw.choices(kinds[l], k=3)) for _ in range(k))
    rows = [(i, text("aa" if i % 2 else "bb", 70), "aa" if i % 2 else "bb") for i in range(30)]
    item, passage = text("aa", 30), text("aa", 60)
    rows += [(40, rows[0][1], "bb"), (41, rows[0][1] + " more", None), (42, text("aa", 60) + " " + item, "aa"), (43, "12 34", None)]
    rows += [(44, text("aa", 60) + "\n" + passage, "aa"), (45, passage + " " + text("aa", 60), "aa"), (46, None, "aa"), (47, "", None)]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or ""), 5) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, k int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == (set(range(30)) | {44, 45})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_items", "token_ids"]
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    kept = {i: t for i, t, _ in rows} | {45: rows[-3][1][len(passage) + 1 :]}
    for i, r in got.items():
        assert r["ids"] == known.encode(kept[i], add_special_tokens=False).ids, i
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
