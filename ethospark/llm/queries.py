"""The registered queries of this subpackage and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.llm import (
    chat_format,
    decontaminate,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    lm_scoring,
    merkle,
    packing,
    quality_rules,
    suffix_dedup,
    token_files,
    vector_codes,
)
from ethospark.llm.common import fold_of, table
from ethospark.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return add


def tokenizer() -> str:
    """Path of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold_of("doc_id", 3) == 1)
    profile = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), profile).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"
    )


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_rules.score_quality(table(spark, folder, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select(*first, *[c for c in scored.columns if c not in first])


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, folder, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), tokenizer(), special=True)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op8_chat_format",
    r"""
WITH raw AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT *, replace(text, '\', '\\') AS e FROM raw
), s AS (
    SELECT *, length(e)
        + length(regexp_replace(e, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]', '\0' || chr(1), 'g')) - length(e)
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS chars
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars,
    CASE WHEN regexp_full_match(string_agg(role, '>' ORDER BY turn, role, text), '(system>)?user(>assistant>user)*(>assistant)?') THEN true ELSE false END AS valid
FROM s GROUP BY conv_id
""",
)
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat_format.format_chats(turns)
    read = made.select("conv_id", "formatted", "valid", chat_format.read_back(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.loss), lambda t: t.text), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold_of("doc_id", 5) == 1)
    model = lm_scoring.fit(docs.filter(~F.col("held_out")))
    scored = lm_scoring.score(docs, model, carry=("held_out",))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query(
    "op10_line_dedup",
    r"""
WITH e AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), k AS (
    SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i
    FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
    SELECT doc_id, i, line, lead(line) OVER x AS l2, lead(line, 2) OVER x AS l3 FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY i)
), later AS (
    SELECT doc_id, i FROM w WHERE l3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT k.doc_id, k.p FROM later JOIN k ON k.doc_id = later.doc_id AND k.i BETWEEN later.i AND later.i + 2
), kept AS (
    SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) AS text FROM e ANTI JOIN gone USING (doc_id, p) GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
    coalesce(a.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed
FROM documents d
LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
""",
)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def _vector_sql(rounds: int = 4) -> str:
    """All parts against all entries in every round."""
    nearest = """
{to} AS (
    SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT x.vec_id, x.label, x.p, x.v, b.e,
            CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM x JOIN {books} b ON b.p = x.p
    ) GROUP BY vec_id, label, p, v
)"""
    moved = """
{to} AS (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
        SELECT p, e, list(c ORDER BY k) AS v FROM (
            SELECT p, e, k, CAST(floor(CAST(sum(v[k]) AS DECIMAL(38,0)) / count(*)) AS BIGINT) AS c
            FROM {near}, unnest(range(1, 1 + len(v))) AS u(k) GROUP BY p, e, k
        ) GROUP BY p, e
    ) m ON m.p = b.p AND m.e = b.e
)"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(to=f"n{r} ", books=f"b{r}"), moved.format(to=f"b{r + 1}", books=f"b{r}", near=f"n{r}")]
    last = f"b{rounds}"
    return f"""
WITH usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v,
        row_number() OVER (ORDER BY vec_id) - 1 AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (
    SELECT vec_id, label, e, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM usable, unnest(range(4)) AS u(p)
), b0 AS (SELECT p, e, v FROM x WHERE e < 256), {",".join(steps)}, {nearest.format(to="z", books=last)}, coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM z GROUP BY vec_id, label
)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
FROM coded
"""


@query("op11_vector_codes", _vector_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codebooks, coded = vector_codes.vector_codes(table(spark, folder, "embeddings"))
    return coded.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(codebooks.sha256).alias("codebooks_sha256"), "label",
    )


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query(
    "op12_merkle_manifest",
    r"""
WITH RECURSIVE crc AS (
    SELECT DISTINCT doc_id, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(CAST(doc_id AS VARCHAR))),
            lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), j // 8 + 1, 1)) ELSE 0 END)),
        lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)) AS c
    FROM documents WHERE doc_id IS NOT NULL
), d AS (
    SELECT d.*, coalesce(xor(c, 4294967295) % 7 = 0, false) AS hit FROM documents d LEFT JOIN crc USING (doc_id)
), lead_ AS (
    SELECT doc_id, lang, sha256(p || n || t) AS leaf,
        sha256(p || CASE WHEN hit AND n_chars IS NOT NULL THEN strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) ELSE n END || t) AS own
    FROM (
        SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') AS p,
            coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(text) || ':' || text, '-') AS t
        FROM d
    )
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM lead_
), low AS (
    SELECT lang, 0 AS level, r, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lang, level + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r))
    FROM low WHERE n > 1 GROUP BY lang, level, r // 2, n
), sub AS (
    SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT 0 AS level, r, n, h FROM sub
    UNION ALL
    SELECT level + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)) FROM high WHERE n > 1 GROUP BY level, r // 2, n
), climb AS (
    SELECT l.doc_id, l.lang, l.leaf, l.own, 0 AS level, l.r, l.n, l.own AS h, '' AS proof, false AS up, l.r AS place FROM leaves l
    UNION ALL
    SELECT c.doc_id, c.lang, c.leaf, c.own,
        CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.r // 2 ELSE s.r END, CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE s.n END,
        CASE WHEN c.n = 1 THEN c.h WHEN c.r % 2 = 0 THEN sha256(c.h || coalesce(b.h, t.h, '')) ELSE sha256(coalesce(b.h, t.h) || c.h) END,
        CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || coalesce(b.h, t.h, '') END, c.up OR c.n = 1, c.place
    FROM climb c
    LEFT JOIN low b ON NOT c.up AND c.n > 1 AND b.lang IS NOT DISTINCT FROM c.lang AND b.level = c.level AND b.r = xor(c.r, 1)
    LEFT JOIN high t ON c.up AND c.n > 1 AND t.level = c.level AND t.r = xor(c.r, 1)
    LEFT JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang
    WHERE NOT (c.up AND c.n = 1)
)
SELECT c.doc_id, c.leaf, s.h AS subroot, g.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = g.h AS verified
FROM climb c LEFT JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang, (SELECT h FROM high WHERE n = 1) g
WHERE c.up AND c.n = 1
""",
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in _FIELDS]
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf_digest(*map(F.col, _FIELDS)).alias("node"),
        F.when(tampered, merkle.leaf_digest(*changed)).alias("tampered"),
    )
    tree = merkle.merkle_tree(leaves, "lang", ["doc_id"])
    folded = tree.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "node"), F.col("path")))
    return folded.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_token_files")
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer(), special=True)
    read = token_files.read_documents(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
