"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    compress_quality,
    decontaminate,
    html_text,
    jaccard,
    language,
    merkle,
    packing,
    personal,
    quality_rules,
    shards,
    token_counts,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary; never a file of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1: urls --------------------------------------------------------------------------

#: The rules of the contract: host, path, action.
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_url_filters", sql=f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN contains(url, '://')
                             THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
        FROM pages),
    parts AS (
        SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
    urls AS (
        SELECT row_number() OVER () AS row_id, page_id,
               translate(raw, '{_UPPER}', '{_LOWER}') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM parts),
    rules(rule_host, rule_path, action) AS (
        VALUES {", ".join(str(r) for r in URL_RULES)}),
    fits AS (
        SELECT row_id, rule_host || rule_path AS rule, action,
               row_number() OVER (PARTITION BY row_id ORDER BY
                   length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
        FROM urls JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host))
         AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row_id)""")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


# --- 2: main text of pages ------------------------------------------------------------

@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


# --- 3: shards ------------------------------------------------------------------------

@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = shards.Ring(shards=16)
    return shards.assign_shards(table(spark, sf_dir, "documents"), ring).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# --- 4: language ----------------------------------------------------------------------

def fold(folds: int) -> Column:
    """The fold of a document by its id; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.where(fold(4) != 2))
    return language.identify(documents, model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


# --- 5: token counts ------------------------------------------------------------------

@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     tokenizer_file("byte_bpe_50k.tiktoken"))


# --- 6: quality classifier ------------------------------------------------------------

@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = compress_quality.learn(
        documents, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return compress_quality.score_quality(documents, model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")


# --- 7: packing -----------------------------------------------------------------------

@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


# --- 8: quality rules -----------------------------------------------------------------

@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge(documents, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


# --- 9: benchmark decontamination -----------------------------------------------------

@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


# --- 10: n-gram Jaccard join ----------------------------------------------------------

@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"),
                                   jaccard.Settings(words=3, share=90))


# --- 11: personal data ----------------------------------------------------------------

@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return personal.report(documents, personal.learn(documents))


# --- 12: Merkle manifest --------------------------------------------------------------

def _merkle_sql(levels: int = 9) -> str:
    """Leaves of up to 8 ** ``levels`` rows a language, a level of nodes at a time.

    A node is (tree, level, pos, digest); ``leaf_sql`` gives a row's digest with any text.
    """
    def leaf_sql(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')"
            for f in fields) + ")"

    def tree(name: str, leaves: str, up: int) -> str:
        """Tables ``name``_0 to ``name``_``up``: a finished tree keeps its one node."""
        parts = [f"{name}_0 AS ({leaves})"]
        for k in range(up):
            parts.append(f"""{name}_{k + 1} AS (
        SELECT tree, pos // 8 AS pos, CASE WHEN any_value(size) = 1 THEN any_value(digest)
               ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,
               (any_value(size) + 7) // 8 AS size
        FROM {name}_{k} GROUP BY tree, pos // 8)""")
        return ",\n    ".join(parts)

    def siblings(name: str, up: int) -> str:
        """Per level the run's other digests before and after a node."""
        return ",\n    ".join(f"""{name}_s{k} AS (
        SELECT tree, pos, size,
               coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
        FROM {name}_{k})""" for k in range(up))

    def fold(of: str, name: str, tree: str, pos: str, up: int, out: str) -> str:
        """``of`` (row, proof, folded) carried through the levels of a tree."""
        parts, last = [], of
        for k in range(up):
            parts.append(f"""{out}{k} AS (
        SELECT f.* EXCLUDE (proof, folded), proof || before || after AS proof,
               CASE WHEN s.size = 1 THEN folded ELSE sha256(before || folded || after) END AS folded
        FROM {last} f JOIN {name}_s{k} s
          ON s.tree IS NOT DISTINCT FROM f.{tree} AND s.pos = f.{pos} // {8 ** k})""")
            last = f"{out}{k}"
        return ",\n    ".join(parts)

    crc = """list_reduce(list_prepend(4294967295, list_transform(string_split(
        CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte:
        xor(crc >> 8, list_reduce(list_prepend(xor(crc, byte) & 255,
            [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
            CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    top = 4
    return f"""
    WITH rows AS (
        SELECT doc_id, lang AS tree, {leaf_sql("text")} AS digest,
               {leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other,
               xor({crc}, 4294967295) % 3 = 0 AS tampered
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1
                  AS pos, count(*) OVER (PARTITION BY tree) AS size
        FROM rows),
    {tree("lower", "SELECT tree, pos, digest, size FROM placed", levels)},
    {tree("upper", f"""SELECT 1 AS tree, tree AS name, digest,
        row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos,
        count(*) OVER () AS size FROM lower_{levels}""", top)},
    {siblings("lower", levels)},
    {siblings("upper", top)},
    start AS (
        SELECT p.doc_id, p.tree, p.pos, p.digest AS leaf, u.pos AS upper_pos, 1 AS one,
               u.digest AS subroot, '' AS proof,
               CASE WHEN tampered THEN other ELSE p.digest END AS folded
        FROM placed p JOIN upper_0 u ON u.name IS NOT DISTINCT FROM p.tree),
    {fold("start", "lower", "tree", "pos", levels, "a")},
    {fold(f"a{levels - 1}", "upper", "one", "upper_pos", top, "b")}
    SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256,
           folded AS folded_root, folded = r.digest AS verified
    FROM b{top - 1}, upper_{top} r"""


@query("op12_merkle_dataset_manifest", sql=_merkle_sql())
def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(
        table(spark, sf_dir, "documents"), changed=tampered,
        tampered={"text": merkle.ascii_lower(F.col("text"))}).select(
        F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
        "folded_root", "verified")


# --- 13: collocations -----------------------------------------------------------------

@query("op13_phrase_collocation_mining", sql=f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
    runs AS (
        SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS words
        FROM spread, (VALUES (1), (2), (3), (4)) t(s) WHERE i + s - 1 <= len(w)),
    f AS (SELECT lang, size, words, count(*) AS f FROM runs GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS (
        SELECT lang, size, words AS phrase, string_split(words, ' ') AS w, f AS a
        FROM f WHERE size > 1 AND f >= 30),
    cuts AS (
        SELECT c.lang, c.size, phrase, a, k, x.f AS l, y.f AS r,
               CAST(CAST(a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
        JOIN f x ON x.lang = c.lang AND x.size = k AND x.words = array_to_string(w[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.size = c.size - k
                AND y.words = array_to_string(w[k + 1:c.size], ' ')),
    weakest AS (
        SELECT * FROM cuts
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (
        SELECT * FROM weakest s WHERE NOT EXISTS (
            SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.size > s.size
               AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')
               AND 100 * CAST(c.a AS HUGEINT) >= 80 * CAST(s.a AS HUGEINT))),
    ranked AS (
        SELECT *, row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op13_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
