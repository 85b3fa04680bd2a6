"""Vector codes, Merkle manifest, token files: plain versions, odd rows, empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ethospark.llm import merkle, repair, token_files, token_ids, vector_codes
from ethospark.llm.queries import QUERIES, tokenizer

FOLDER = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "  a", "a  b", "a   b ", "a\n\n b\t", "é à  b", "x　 y", "»  «", "a\x1c b", "a\x85 b",
    "<|endoftext|>a<|endoftext|>", "b's don't 12 3a", "🙂 a 🙂  b", "x " * 3000, "y" * 3000, "  z z",
]


@pytest.fixture(scope="module")
def reader():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# token ids and grammars


def test_token_ids_are_those_of_the_tokenizer(reader):
    rng = random.Random(5)
    marks = ["a", "Word", " ", "  ", "\n", " ", " ", "é", "ß", "'s", "12", ".", "…", "🙂", "<|endoftext|>", "̀"]
    texts = ODD_TEXTS + ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(400)]
    own = token_ids.TokenIds(tokenizer())
    for table in (1 << 24, 200):  # the second one starts anew for each slice
        token_ids.TABLE_BYTES, kept = table, token_ids.TABLE_BYTES
        for k in range(0, len(texts), 40):
            part = texts[k : k + 40]
            ids, offsets = own.encode(pa.array(part, pa.string()), special=True)
            for i, text in enumerate(part):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == reader.encode(text or "", add_special_tokens=False).ids
        token_ids.TABLE_BYTES = kept
    ids, offsets = own.encode(pa.array(["x<|endoftext|>"]))
    assert 50256 not in ids.tolist()
    ids, offsets = token_ids.with_end(*own.encode(pa.array([None, "a", ""], pa.string())), 0)
    assert offsets.tolist() == [0, 1, 3, 4] and ids[[0, 2, 3]].tolist() == [0, 0, 0]
    assert own.encode(pa.array([], pa.string()))[1].tolist() == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_grammars_give_back_any_range(ids, a, b):
    ids = np.array(ids, np.int32) * 9000
    grammar = repair.compress(ids, least=2)
    assert np.array_equal(grammar.decode(), ids)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert np.array_equal(grammar.slice(a, b), ids[a:b])
    assert (grammar.rules < grammar.base + np.arange(len(grammar.rules))[:, None]).all()
    assert grammar.lengths.tolist() == [len(grammar._expand(np.array([grammar.base + k], np.int32))) for k in range(len(grammar.rules))]
    for x in (grammar.symbols, grammar.rules.ravel()):
        assert np.array_equal(repair.unpack_numbers(repair.pack_numbers(x), len(x)), x)


@pytest.mark.parametrize("largest", [50_000, 1 << 30])
def test_pairs_and_places_in_order(largest):
    x = np.random.default_rng(1).integers(0, largest, 500).astype(np.int32) // (largest // 9) * (largest // 9)
    at = np.arange(0, 499, 2)
    pairs, places = repair._in_pair_order(x[:-1], x[1:], at)
    assert sorted(places.tolist()) == at.tolist() and (np.diff(pairs) >= 0).all()
    assert np.array_equal(pairs, x[places].astype(np.int64) << 32 | x[places + 1])


def test_grammars_are_smaller():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 500, np.int32)
    grammar = repair.compress(ids)
    assert len(grammar.symbols) + 2 * len(grammar.rules) < len(ids) / 20


# token files


def plain_files(rows, reader):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = reader.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [7, 1 << 20])
def test_token_files(spark, tmp_path, reader, shard_ids):
    rows = [(None, "null id"), (5, "same"), (5, "same"), *[(100 - k, t) for k, t in enumerate(ODD_TEXTS)]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(3)
    path = str(tmp_path / "files")
    token_files.write_tokens(df, path, tokenizer(), special=True, shard_ids=shard_ids)
    want = plain_files(rows, reader)
    found = [tuple(r) for r in token_files.read_documents(spark, path).collect()]
    assert sorted(((r[1], r[2:]) for r in found)) == sorted(((r[1], (r[2], bytearray(r[3]))) for r in want))
    assert sorted(map(str, ((r[0], r[1]) for r in found))) == sorted(map(str, ((r[0], r[1]) for r in want)))
    some = spark.createDataFrame([(5,), (None,), (85,), (12345,)], "id long")
    chosen = token_files.read_documents(spark, path, wanted=some).collect()
    assert sorted((r.start, bytes(r.ids)) for r in chosen) == sorted((w[1], w[3]) for w in want if w[0] in (5, None, 85))
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.filter(F.col("n_ids") > shard_ids).count() == 0


def test_only_long_texts_are_cut(spark, tmp_path):
    rows = [(k, "a b c" if k != 4 else "a b c " * 20) for k in range(12)]
    path = str(tmp_path / "files")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    token_files.write_tokens(df, path, tokenizer(), shard_ids=10)
    shards = spark.read.parquet(f"{path}/shards")
    assert [r.text_ids for r in token_files._only_cut(shards).select("text_ids").distinct().collect()] == [[4]]
    assert [r.doc_id for r in token_files.read_documents(spark, path).orderBy("start").collect()] == list(range(12))


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer())
    assert token_files.read_documents(spark, path).count() == 0


def test_op13(spark, reader):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = [(d, s, n, zlib.crc32(ids)) for d, s, n, ids in plain_files(docs, reader)]
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, FOLDER).collect())) == want


# Merkle manifest


def plain_tree(nodes):
    """(root, path of each node) of a list of digests."""
    paths, level = [[] for _ in nodes], list(nodes)
    places = list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(places):
            other = p ^ 1
            paths[k].append((level[other] if other < len(level) else "", p % 2 == 1))
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return (level[0] if level else None), paths


@pytest.mark.parametrize("height", [1, 2, 10])
def test_merkle_tree(spark, height):
    rng = random.Random(height)
    sizes = {None: 3, "": 1, "a": 37, "é": 8, "z": 1, "Z": 5}
    rows = [(g, i, h(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    rows += [("a", 5, h("a", "5")), ("a", 5, h("other")), ("a", None, h("none")), ("a", None, h("none"))]  # repeated, tied, null
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "g string, i long, node string, extra string, rank int, part int").repartition(5)
    found = merkle.merkle_tree(df, "g", ["i"], height).collect()
    groups = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    trees, leaves = {}, {}
    for g in groups:
        leaves[g] = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        trees[g] = plain_tree(leaves[g])
    root, tops = plain_tree([trees[g][0] for g in groups])
    want = sorted(
        (str(g), leaf, trees[g][0], root, tuple(path) + tuple(top))
        for g, top in zip(groups, tops)
        for leaf, path in zip(leaves[g], trees[g][1])
    )
    assert want == sorted((str(r.g), r.node, r.subroot, r.root, tuple((x.sibling, x.left) for x in r.path)) for r in found)
    assert {r.extra for r in found} == {"x"}


def test_merkle_leaves_and_folds(spark):
    row = spark.createDataFrame([(7, None, "é", "")], "a long, b string, c string, d string")
    leaf = row.select(merkle.leaf_digest(*map(F.col, "abcd"))).first()[0]
    assert leaf == h("1:7", "-", "2:é", "0:")
    empty = spark.createDataFrame([], "g string, i long, node string")
    assert merkle.merkle_tree(empty, "g", ["i"]).count() == 0
    alone = merkle.merkle_tree(spark.createDataFrame([("g", 1, "ab")], "g string, i long, node string"), "g", ["i"])
    folded = alone.select("root", "subroot", merkle.fold(F.lit("ab"), F.col("path")).alias("f"), merkle.siblings(F.col("path")).alias("s"))
    assert tuple(folded.first()) == ("ab", "ab", "ab", "")
    clash = empty.select("*", *[F.lit(1).alias(c) for c in ("rank", "total", "part", "group", "row", "o0", "block", "path", "root")])
    assert merkle.merkle_tree(clash, "g", ["i"]).columns[-3:] == ["subroot", "root", "path"]


def test_op12_finds_tampered_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op12_merkle_manifest"](spark, FOLDER).collect()
    assert len(found) == len(docs) and len({r.root for r in found}) == 1
    for r in found:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None
        assert r.verified == (not tampered) == (r.folded_root == r.root)


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """(id, label, entries per part, error) of usable rows, and the codebooks."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    dims = len(kept[0][1])
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in kept if len(v) == dims]
    width = dims // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        near = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, near) if n[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    coded = []
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        coded.append((i, lab, bytes(e for _, e in best), sum(d for d, _ in best)))
    return coded, books


@pytest.mark.parametrize("entries,chunk", [(5, 7), (256, 8192)])
def test_vector_codes(spark, entries, chunk, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    rng = random.Random(entries)
    rows = [(k, [rng.choice((-1, 1)) * rng.random() ** 3 for _ in range(8)], rng.choice([1, 1, 1, 2, None])) for k in range(90)]
    rows += [(200 + k, rows[3][1], 1) for k in range(60)]  # one vector in a third of all rows
    rows += [(3, rows[3][1], 1), (None, rows[4][1], None), (300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1)]
    rows += [(303, [float("inf")] + [0.0] * 7, 1), (304, [0.5] * 4, 1), (305, [], 2), (306, [9.0] * 8, None), (307, [-0.0] * 8, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, error int, code string")
    books, found = vector_codes.vector_codes(df.repartition(3), entries=entries)
    want, plain = plain_codes(rows, 4, entries, 4)
    assert books.entries.tolist() == plain and books.n_other_length == 2
    text = ",".join(str(x) for part in plain for entry in part for x in entry)
    assert books.sha256 == hashlib.sha256(text.encode()).hexdigest()
    per_label = {}
    for _, lab, _, error in want:
        per_label[lab] = per_label.get(lab, 0) + error
    found = found.collect()
    assert sorted((str(r.vec_id), str(r.label), bytes(r.code), r.error) for r in found) == sorted((str(i), str(lab), c, e) for i, lab, c, e in want)
    assert all(r.label_error == per_label[r.label] for r in found)


def test_vector_codes_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(1, [1.0] * 4, 1)]):
        books, found = vector_codes.vector_codes(spark.createDataFrame(rows, shape))
        want, _ = plain_codes(rows, 4, 256, 4)
        assert sorted((r.vec_id, bytes(r.code), r.error) for r in found.collect()) == [(i, c, e) for i, _, c, e in want]
    for bad in ([(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="parts|exact"):
            vector_codes.vector_codes(spark.createDataFrame(bad, shape))[1].count()


def test_op11(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, _ = plain_codes(rows, 4, 256, 4)
    found = QUERIES["op11_vector_codes"](spark, FOLDER).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in found) == [(i, c.hex(), e) for i, _, c, e in want]
