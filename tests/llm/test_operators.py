"""Small fixtures for the operators: plain versions, odd rows, empty tables."""

import math
import os
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from ethospark.llm import (
    chat_format,
    common,
    decontaminate,
    html_text,
    language_id,
    line_dedup,
    lm_scoring,
    packing,
    quality_rules,
    suffix_dedup,
)
from ethospark.llm.queries import QUERIES, tokenizer
from ethospark.llm.text import Words

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c"), (5, "x " * 30_000), (6, "é🙂 ÀB\x0bC\n\n")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, a long text, columns whose names clash with results."""
    rows = [(i, t, 7, "n", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang string, id int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_models(spark, documents, odd):
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, FOLDER).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    profile = language_id.fit(documents)
    found = language_id.predict(odd, profile).collect()
    assert len(found) == len(ODD) and {r.lang_pred for r in found if not (r.text or "").strip()} == {"und"}
    foreign = spark.createDataFrame([(1, "это совсем другой язык " * 9), (2, documents.first().text)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in language_id.predict(foreign, profile).collect()} == {1: True, 2: False}
    assert language_id.predict(odd.limit(0), profile).count() == 0
    nothing = language_id.fit(odd.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_language_models_are_distributions(spark):
    texts = [("x", "abab abba baab " * 5), ("x", "aabb ba " * 9), ("y", "cdcd dccd cdd " * 7)] * 30
    df = spark.createDataFrame([(lang, t + "ab" * (k % 5)) for k, (lang, t) in enumerate(texts)], "lang string, text string")
    profile = language_id.fit(df)
    p = np.exp(profile.log_p[0]).sum(axis=0)  # letters seen, plus the floor of the others
    seen = len(profile.grams[0])
    floor = np.exp(profile.log_weight[0][0]) / language_id.ALPHABET * (language_id.ALPHABET - seen)
    assert np.allclose(p + floor, 1, atol=1e-3)


def test_decontamination(spark, documents, odd):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    item, other = make(30), make(30)
    edited = [w if k % 7 else "changed" for k, w in enumerate(item)]
    docs = [make(50) + item + make(20), make(5) + edited + make(90), make(200), item[:17] + make(40), make(60) + item[:6]]
    df = spark.createDataFrame([(k, " ".join(d).upper()) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "w1 w2")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench).collect()}
    assert set(found) == {(0, 1), (1, 1), (3, 1)}
    assert found[0, 1].score == 1 and (found[0, 1].start_word, found[0, 1].end_word) == (50, 80)
    assert found[1, 1].score == pytest.approx((2 * 25 - 5 + 2 * 0) / 60, abs=0.1)
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {2, 4}
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ODD)
    assert decontaminate.matches(odd.limit(0), bench).count() == 0
    assert decontaminate.matches(df, bench.limit(0)).count() == 0


def test_decontamination_finds_excerpts_of_long_items(spark):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    long, middle = make(1000), make(59)
    docs = [make(40) + long[300:790] + make(40), make(9) + middle[10:35] + make(30), make(80) + long[500:520], make(20) + long[:15] + make(20), make(300)]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(middle))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench).collect()}
    assert set(found) == {(0, 1), (1, 2), (2, 1)} and (found[0, 1].start_word, found[0, 1].end_word) == (40, 530)


def test_decontamination_finds_all_contained_items(spark, documents):
    bench = {r.item_id: brute.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    within = {
        (r.doc_id, i) for r in documents.collect() for i, b in bench.items()
        if f" {' '.join(b)} " in f" {' '.join(brute.words(r.text))} "
    }
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, FOLDER).collect()}
    assert within <= found and len(found) <= len(within) + 2


def test_quality_counts_and_verdict(spark, documents, odd):
    rows = documents.select("doc_id", "text").unionByName(odd.filter("doc_id in (1, 2, 3, 5)").select((-F.col("doc_id")).alias("doc_id"), "text"))
    extra = spark.createDataFrame([(-100, "a b c d e f g h " * 3 + "\nx\n\nx\n  \nx # * $"), (-101, "ab a b " + "a " * 20)], "doc_id long, text string")
    rows = rows.unionByName(extra)
    found = {r.doc_id: r for r in quality_rules.score_quality(rows).collect()}
    for r in rows.collect():
        text, got = r.text or "", found[r.doc_id]
        words = brute.WORD.findall(text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if brute.WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == expected
        assert got.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (got.base_failed and got.kept) and 0 <= got.quality <= 1
    assert sum(r.kept for r in found.values()) > len(found) / 2
    assert quality_rules.score_quality(rows.limit(0)).count() == 0


def test_quality_em_recovers_accuracies():
    rng, accuracy = random.Random(1), [0.9, 0.8, 0.7, 0.85]
    votes = Counter()
    for _ in range(20_000):
        good = 1 if rng.random() < 0.7 else -1
        votes[tuple(0 if rng.random() < 0.2 else good if rng.random() < a else -good for a in accuracy)] += 1
    prior, found = quality_rules.fit(sorted(votes.items()))
    assert prior == pytest.approx(0.7, abs=0.03) and found == pytest.approx(accuracy, abs=0.03)


def test_html():
    page = """<html><head><title>t</title></head><body hidden-x><h1>A &amp; B</h1><p>one <b>two
    <br>three<p>four<script>x<p></script><!-- no --><ul><li>a<li>b<ol start=3><li>c</ol></ul>
    <div style="display: none">gone<p>gone</div><span hidden>gone</span>
    <table><tr><th>k<th>value<tr><td>long key<td>v<tr><td colspan=2>both</table><pre>  x
   y</pre><blockquote>q</blockquote>end"""
    assert html_text.extract(page).split("\n") == [
        "A & B", "", "one two", "three", "", "four", "", "- a", "- b", "  3. c", "", "k        | value", "long key | v", "both",
        "", "  x", "   y", "", "> q", "", "end",
    ]
    assert html_text.extract("") == "" and html_text.extract("<p") == "" and html_text.extract("a<!-- b") == "a"
    assert html_text.extract("<div>" * 30_000 + "x") == "x" and html_text.extract("1 < 2 &lt; 3") == "1 < 2 < 3"


def test_html_keeps_visible_text():
    """Only the attribute and the style themselves hide; fields, drawings and open dialogs are shown."""
    for tag in ('div title="a hidden gem"', 'p class="nav hidden lg:flex"', "div data-style='display:none'", "p data-hidden", 'p title="x hidden=1"',
                'p style="display:none; display:block"', 'p style="background:url(display:none)"', "dialog open", "div title='style=\"display:none\"'"):
        assert html_text.extract(f"<{tag}>kept</{tag.split()[0]}>") == "kept", tag
    for tag in ("p hidden", "p HIDDEN=''", "p class=x hidden=until-found", "p style='color:red;DISPLAY : none'", 'p title="a"hidden', "dialog",
                "p style=display:none", "p style='display:none!important;display:block'", "p style='visibility:hidden'"):
        assert html_text.extract(f"a<{tag}>gone</{tag.split()[0]}>") == "a", tag
    assert html_text.extract('<body class="hidden x">a<p>b</body>') == "a\n\nb"
    assert html_text.extract("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>") == "yes"
    assert html_text.extract("say <textarea>\nA &amp; <b>\n  two</textarea> end") == "say A & <b>\n  two end"
    select = "pick <select><option>one<option selected>two</option><optgroup label='more'><option label='three'>x</optgroup></select> end"
    assert html_text.extract(select).split("\n") == ["pick", "one", "two", "more", "three", "end"]
    svg = "<svg><title>no</title><defs/><path d='1'/>no<text x=1>A<tspan>B</tspan></text><text>C</text><defs><text>no</text></defs></svg>end"
    assert html_text.extract(svg).split() == ["AB", "C", "end"]
    assert html_text.extract("<svg><g><p>broken out") == "broken out"
    assert html_text.extract("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>.") == "x=1."


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (None, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract_text(df).collect() if r.text is not None) == [(0, "a"), (2, "")]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_repeated_passages(spark, odd):
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, long = make(50), make(400)
    texts = [make(30) + passage + make(9), passage + make(60), make(80) + passage[:49], long, long, long[:399] + ["x"], passage + passage, make(49), make(49)]
    texts += [["a"] * 120, long[100:140] + make(30)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    where = defaultdict(list)
    for d, w in enumerate(texts):
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].append((d, k))
    for r in suffix_dedup.repeated_passages(df).collect():
        cover, later = set(), set()
        for places in where.values():
            for d, k in places if len(places) > 1 else ():
                if d == r.doc_id:
                    cover.update(range(k, k + 50))
                    later.update(range(k, k + 50) if (d, k) != places[0] else ())
        assert {i for s in r.spans for i in range(s.start, s.end)} == cover and r.n_repeated == len(cover)
        assert {i for s in r.later for i in range(s.start, s.end)} == later
    assert suffix_dedup.repeated_passages(odd).count() == len(ODD)
    assert suffix_dedup.repeated_passages(odd.limit(0)).count() == 0


def test_packing(spark, documents, odd):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer())
    reader.encode_special_tokens = True
    tricky = ["  two  spaces ", " \n a\n b  ", "it's 12,5 don't!! x²½ _a_   　x", "<|endoftext|> a<|endoftext|>", "\t\t x", "a" * 3000, "日本 語。 ñ́ é !"]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(tricky + [None])], "doc_id long, text string"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(rows, tokenizer()).collect():
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in rows.collect():
        ids = np.array([*reader.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(parts[r.doc_id], key=lambda x: x.start)
        assert b"".join(bytes(x.ids) for x in own) == ids.tobytes()
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))] and {x.doc_tokens for x in own} == {len(ids)}
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda x: x.offset)
        assert [x.offset for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        total = sum(x.length for x in own)
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding == 0
    limited = packing.pack(odd.withColumn("l", F.col("doc_id") != 5), tokenizer(), capacity=64, max_segments=2, max_loss=16, loss_column="l").collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for r in limited:
        for k, v in enumerate((r.length, 1, r.n_loss)):
            sums[r.sequence_id][k] += v
    assert all(a <= 64 and b <= 2 and c <= 16 for a, b, c in sums.values())
    assert packing.pack(odd.limit(0), tokenizer()).count() == 0


def test_packing_special_tokens(spark):
    """With ``special`` the ids are those of the tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer())
    texts = ["<|endoftext|>", " a b <|endoftext|> c <|endoftext|><|endoftext|>\n x", "plain text <|endoftext>", "a<|endoftext|>b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = defaultdict(list)
    for r in packing.pack(df, tokenizer(), special=True).collect():
        parts[r.doc_id].append(r)
    for k, text in enumerate(texts):
        ids = np.array([*reader.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(parts[k], key=lambda x: x.start)
        assert b"".join(bytes(x.ids) for x in own) == ids.tobytes() and {x.doc_tokens for x in own} == {len(ids)}


def test_chats_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\[\\INST]", "[ROLE]x[TEXT]", "<<SYS>> <</SYS>>\\n é🙂\n"]
    rows = [(k, t, role, texts[(k + t) % len(texts)], 1) for k in range(7) for t, role in enumerate(["system", "user", "assistant", "tool<s>", None])]
    rows += [(50, 1, "user", "b", 1), (50, 1, "user", "a", 1), (50, None, "system", "s", 1), (None, 0, "assistant", "x", 1)]
    rows += [(60, 0, "user", "q", 1), (60, 1, "assistant", "r", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid int")
    made = chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()
    expected = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    for r in made:
        assert [(t.role, t.text) for t in r.turns] == expected[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted and r.valid == (r.conv_id == 60)
    assert len(made) == len(expected) and chat_format.format_chats(df.limit(0)).count() == 0


def test_lm_scoring(spark, documents, odd):
    rows = QUERIES["op9_lm_scoring"](spark, FOLDER).collect()
    counts, texts = Counter(), {r.doc_id: [*brute.words(r.text), None] for r in documents.collect()}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    total, types = sum(counts.values()), len(counts)
    for r in rows:
        w = texts[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.train_tokens) == (len(w), total)
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    model = lm_scoring.fit(documents)
    assert lm_scoring.score(odd, model).count() == len(ODD) and lm_scoring.score(odd.limit(0), model).count() == 0
    nothing = lm_scoring.score(odd, lm_scoring.fit(odd.limit(0))).collect()
    assert all(r.score == r.base_score for r in nothing)


def test_lm_states_are_distributions(spark):
    """Probabilities after a history sum to one over known words, the end and the unknown word."""
    rng = random.Random(4)
    df = spark.createDataFrame([(k, " ".join(rng.choice("abcde") for _ in range(12))) for k in range(60)], "doc_id long, text string")
    model = lm_scoring.fit(df)
    nodes = model.nodes.toPandas()
    keys = nodes["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts, sure = (nodes[c].to_numpy()[order] for c in ("c", "sure"))
    automaton = lm_scoring.Automaton(keys[order], counts, sure, model.total, model.types)
    for history in ("a b", "c", "b b"):
        probes = [f"{history} {w}" for w in [*"abcde", "unknown"]] + [history]
        total = 0.0
        for text in probes:
            _, _, _, cost = automaton.token_costs(Words(pa.array([text])))
            total += 10 ** cost[len(history.split())]
        assert total == pytest.approx(1, abs=1e-6)
    scores = lm_scoring.score(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), model).first()
    assert scores.score == pytest.approx(automaton.token_costs(Words(pa.array(["a b c"])))[3].sum())


@pytest.mark.parametrize("chunk, stretch, bits", [(1 << 23, 4096, 28), (60, 3, 15), (1, 1, 16)])
def test_lm_keeps_rare_arcs(spark, chunk, stretch, bits):
    """An n-gram below any share of the tokens has its arc: scores are those of a plain model."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(60)] + ["rare pair here", "a rare pair here b", "once upon a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = Counter()
    for t in texts:
        w = ["<s>", *brute.words(t), "</s>"]
        grams.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    words = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    norm = sum(words.values()) + 0.5 * (len(words) + 1)

    def p(history, w):
        if not history:
            return (words.get(w, 0) + 0.5) / norm
        own, lower = grams[history], p(history[1:], w)
        arcs = [c for g, c in grams.items() if g[:-1] == history and c >= 2]
        if not arcs:
            return lower
        c = grams[(*history, w)]
        return (c - 0.75 if c >= 2 else 0) / own + (1 - sum(c - 0.75 for c in arcs) / own) * lower

    probes = [*texts[:5], *texts[-5:], "rare pair", "pair here b new", "a rare pair here"]
    model = lm_scoring.fit(df, filter_bits=bits)
    asked = spark.createDataFrame([(k, t, {"k": k}) for k, t in enumerate(probes)], "doc_id long, text string, score map<string,int>")
    carried = lm_scoring.score(asked.withColumnRenamed("score", "extra"), model, carry=("extra",)).collect()
    assert all(r.extra == {"k": r.doc_id} for r in carried)
    scores = lm_scoring.score(asked, model, chunk_bytes=chunk, stretch=stretch).collect()
    for r in scores:
        w = ["<s>", *brute.words(probes[r.doc_id]), "</s>"]
        expected = sum(math.log10(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w)))
        assert r.score == pytest.approx(expected) and r.n_known == sum(x in words for x in w)
    assert len(scores) == len(probes)


def test_lm_reads_texts_in_bounded_batches(spark, monkeypatch):
    """No chunk holds more than an Arrow batch of bounded bytes, and the session keeps its own setting."""
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 1000).alias("text"))
    before, sizes = spark.conf.get(common.BATCH), []
    score = lm_scoring._score

    def watched(rows, *rest):
        task = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
        sizes.extend(r.n for r in rows.mapInArrow(task, "n long").collect())
        return score(rows, *rest)

    monkeypatch.setattr(lm_scoring, "_score", watched)
    few = docs.limit(3)
    scored = lm_scoring.score(docs, lm_scoring.fit(few)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("scores")).first()
    assert scored.n == 3000 and scored.scores == 1
    assert sum(sizes) > 3000 * 6000 and max(sizes) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH) == before


def test_line_windows(spark, odd):
    texts = {
        1: "a\nb\nc\nd", 2: "x\nb\nc\nd\ny", 3: "a\n\nb\n \nc\nd\nlast", 4: "a\nb", 5: None, 6: "", 7: "q\nq\nq\nq\nq", 8: "a\nb\nc\nd", 9: "b\nc\nz",
    }
    df = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, n_lines int")
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert found == {
        1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("\n \nlast", 5, 4), 4: ("a\nb", 2, 0), 5: (None, 0, 0), 6: ("", 0, 0),
        7: ("q", 5, 4), 8: ("", 4, 4), 9: ("b\nc\nz", 3, 0),
    }
    same = line_dedup.dedup_lines(odd).collect()
    assert sorted(map(str, (r.text for r in same))) == sorted(map(str, (t for _, t in ODD)))
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, stages = spark.read.parquet(f"{FOLDER}/documents.parquet"), corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    bench = [brute.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    sizes = []
    for _, stage in stages[:-1]:
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), left.schema)
        sizes.append(docs.count())
    assert sizes[0] >= 0.99 * spark.read.parquet(f"{FOLDER}/documents.parquet").count() and sizes == sorted(sizes, reverse=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    joined = [f" {' '.join(brute.words(t))} " for t in texts.values()]
    assert not any(f" {' '.join(b)} " in t for b in bench for t in joined)
    groups, _ = brute.jaccard_components(texts, 5, 80)
    assert len(set(groups.values())) == len(texts)
    assert {r.doc_id for r in stages[-1][1](spark, docs, FOLDER).collect()} == set(texts)


def test_pipeline_stages_leave_their_own_table_only(spark):
    """What a stage stored on its way to near copies is emptied; the setting of shuffle files is the session's again."""
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, text if k < 3 else f"{k} other {k * 7} words {k * k}", "en", "s", 9) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    folder, before = spark.sparkContext.getCheckpointDir().removeprefix("file:"), spark.conf.get(common.TIDY)
    older = set(os.listdir(folder))
    left = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, FOLDER)
    made = [n for n in os.listdir(folder) if n not in older and os.path.exists(f"{folder}/{n}/_SUCCESS")]
    assert any(n.startswith("jaccard-") for n in made)
    assert {n.split("-")[0] for n in made if spark.read.parquet(f"{folder}/{n}").count()} == {"pipeline"}
    assert sorted(r.doc_id for r in left.collect()) == [0, 3, 4, 5] and spark.conf.get(common.TIDY) == before


def test_pipeline_reads_texts_in_bounded_batches(spark, monkeypatch, tmp_path):
    """Language ID of the pipeline is handed batches of bounded bytes, and the session keeps its own setting."""
    import corpus_pipeline

    docs = spark.range(3000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(6000).alias("n_chars")
    )
    before, sizes, predict = spark.conf.get(common.BATCH), [], language_id.predict

    def watched(rows, profile):
        task = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
        sizes.extend(r.n for r in rows.mapInArrow(task, "n long").collect())
        return predict(rows, profile)

    monkeypatch.setattr(language_id, "predict", watched)
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, docs, str(tmp_path)).columns == docs.columns
    assert sum(sizes) > 3000 * 6000 and max(sizes) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH) == before


def test_html_tables_against_a_grid():
    rng = random.Random(8)
    for _ in range(300):
        rows = [
            [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4))]
            for _ in range(rng.randint(1, 5))
        ]
        cell = lambda t, span, down: f"<td{f' colspan={span}' if span > 1 else ''}{f' rowspan=\"{down}\"' if down > 1 else ''}>{t}"
        page = "<table>" + "".join("<tr>" + "".join(cell(*c) for c in row) for row in rows) + "</table>"
        assert html_text.extract(page) == "\n".join(brute.table_text(rows)), page


def test_html_lists_against_a_plain_version():
    rng = random.Random(9)

    def make(depth):
        order = rng.random() < 0.6
        entries = [
            (rng.choice([None, None, None, rng.randint(-9, 99999)]), rng.choice(["one", "two words"]), make(depth - 1) if depth and rng.random() < 0.4 else None)
            for _ in range(rng.randint(1, 4))
        ]
        return order, rng.choice([None, None, 4, 123456]) if order else None, order and rng.random() < 0.4, entries

    def markup(items):
        order, start, back, entries = items
        tag = "ol" if order else "ul"
        inside = "".join(f"<li{f' value={v}' if v is not None else ''}>{t}{markup(below) if below else ''}" for v, t, below in entries)
        return f"<{tag}{f' start={start}' if start is not None else ''}{' reversed' if back else ''}>{inside}</{tag}>"

    for _ in range(200):
        items = make(2)
        assert html_text.extract(markup(items)) == "\n".join(brute.list_text(items)), markup(items)


def test_html_cells_keep_their_lines_and_padding_is_bounded():
    page = "<table><tr><td><ul><li>a<li>b</ul><td>q<tr><td><pre>x\n  y</pre><td>z</table>"
    assert html_text.extract(page).split("\n") == ["- a | q", "- b |", "x   | z", "  y |"]
    groups = "<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>"
    assert html_text.extract(groups).split("\n") == ["A | b", "  | c", "d | e"]
    cells = "".join(f"<td rowspan=0>{'w' * 100}" for _ in range(200))
    page = f"<table><tr>{cells}" + "<tr><td>x" * 2000 + "</table>"
    text = html_text.extract(page)
    assert len(text) < 2 * len(page) and text.count("x") == 2000 and text.count("w") == 20_000
    begin = time.perf_counter()
    assert html_text.extract("<p><button>" + "<div>" * 50_000 + "x" + "</p>" * 50_000) == "x"
    assert time.perf_counter() - begin < 5
    assert html_text.extract("<ol start=99999999999999999999999><li>a</ol>") == "1. a"


def test_language_sample_of_copies_and_few_texts(spark):
    rows = [("x", "le chat dort sur la chaise verte")] * 3000 + [("y", f"the dog number {k} sleeps on a chair") for k in range(200)]
    rows += [("z", "ein sehr langer Satz " * 500), ("n", "12 34"), ("e", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    sample = language_id._sample(df, 2000).collect()
    assert len(sample) == len({(r.lang, r.text) for r in sample})
    assert {r.lang for r in sample} == {"x", "y", "z", "n"}
    assert 2000 <= sum(len(r.text) for r in sample if r.lang == "y") < 2050
    assert sum(r.held for r in sample) == sum(r.lang == "y" for r in sample) // 10
    profile = language_id.fit(df, train_chars=2000)
    found = language_id.predict(df.filter("lang in ('x', 'y', 'z')"), profile).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred) for r in found} == {("x", "x"), ("y", "y"), ("z", "z")}


def test_language_models_against_plain_kneser_ney(spark):
    rng = random.Random(4)
    texts = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(12)] for k, letters in (("p", "aab c"), ("q", "abbd "))}
    df = spark.createDataFrame([(k, t) for k, many in texts.items() for t in many], "lang string, text string")
    profile = language_id.fit(df, train_chars=10**6)
    taught = defaultdict(list)
    for r in language_id._sample(df, 10**6).collect():
        if not r.held:
            taught[r.lang].append(r.text)
    new = ["".join(rng.choice("abcde ") for _ in range(25)) for _ in range(30)]
    entropy, length = profile.cross_entropy(pa.array(new))
    for k, lang in enumerate(profile.languages):
        p = brute.kneser_ney(map(language_id._clean, taught[lang]), language_id.ORDER, language_id.DISCOUNT, language_id.ALPHABET)
        for i, text in enumerate(map(language_id._clean, new)):
            if text:
                padded = " " * (language_id.ORDER - 1) + text
                costs = [-math.log(p(padded[j : j + language_id.ORDER])) for j in range(len(text))]
                assert length[i] == len(text) and entropy[i, k] == pytest.approx(sum(costs) / len(text), rel=1e-4)
