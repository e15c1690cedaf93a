"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html, language, lines, manifest, mixing, neardup, neighbours, packing, periods, toxicity, urls
from ._common import table


def held_out(modulus: int, remainder: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: its lines, those that stay, links of its lines, and the class (doc_id, line) of each line in order.

    A null text has no lines and no classes.
    """
    return lines.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The listed urls: fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits best and its verdict; null urls have neither and are allowed."""
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: url, main text and its length; null html has an empty text."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: its words, its source's words and target, and the words that the mix takes; null texts have none."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: held_out (false without an id), score and prediction; null and empty texts score `toxicity.BASE`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"))
    model = toxicity.letter_model(toxicity.triple_counts(docs))
    sample = toxicity.sample(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.learn(sample, model), model, ("doc_id", "held_out"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: size of its shingle set, component and whether it stays; null and empty texts are alone."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: length, digest of its edited text, both fingerprints and likenesses; null texts are empty."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: held_out (false without an id), language and score; `und` where there is no letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"))
    model = language.learn(docs.where("NOT held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs, model, ("doc_id", "held_out"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector; unusable vectors take no part."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its ids' digest and place; null texts are their closing id alone."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: its tokens' number, and digests of the ids and of the bytes they decode to; null texts are empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: its runs, the longest one, and digests of all runs and of the words that they leave; null texts have none."""
    return periods.periodic_runs(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: leaf, roots, its proof's digest, and the root that its leaf, or a tampered one, folds to."""
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_html_extraction": op3_html_extraction,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}



def _tree(name: str, levels: int = 6) -> str:
    """CTEs from {name}0 (tree, i, n, digest) up: {name}1 and on, {name}root (tree, root), and {name}path (tree, i, proof, up) of the leaves."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (max(n) + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16),"
            f" {name}s{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after"
            f" FROM {name}{k} a LEFT JOIN {name}{k} b ON b.tree = a.tree AND b.i // 16 = a.i // 16 AND b.i <> a.i WHERE a.n > 1 GROUP BY a.tree, a.i)"
        )
    out.append(f"{name}root AS (" + " UNION ALL ".join(f"SELECT tree, digest AS root FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    steps = ", ".join(f"{{'b': s{k}.before, 'a': s{k}.after}}" for k in range(levels))
    joins = " ".join(f"LEFT JOIN {name}s{k} s{k} ON s{k}.tree = l.tree AND s{k}.i = l.i // {16**k}" for k in range(levels))
    out.append(f"{name}path AS (SELECT l.tree, l.i, list_filter([{steps}], lambda x: x.b IS NOT NULL) AS up FROM {name}0 l {joins})")
    return ", ".join(out)


def _leaf(text: str) -> str:
    columns = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": text}
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in columns.values()) + ")"


#: CRC-32 of a decimal, byte by byte, for want of such a function.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substring(doc_id::VARCHAR, k, 1))::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
)

ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": f"""
        WITH hashed AS (
            SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents
        ), rows_ AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
                   dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS tree FROM hashed
        ), t0 AS (SELECT tree, i, n, leaf AS digest FROM rows_), {_tree("t")},
        u0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, root AS digest FROM troot), {_tree("u", 4)},
        joined AS (
            SELECT r.*, q.root AS subroot, (SELECT root FROM uroot) AS root, list_concat(p.up, w.up) AS up
            FROM rows_ r JOIN tpath p ON p.tree = r.tree AND p.i = r.i JOIN troot q ON q.tree = r.tree JOIN upath w ON w.i = r.tree
        ), folded AS (
            SELECT *, sha256(array_to_string(list_transform(up, lambda x: x.b || x.a), '')) AS proof_sha256,
                   list_reduce(list_prepend({{'b': coalesce(other, leaf), 'a': ''}}, up), lambda d, x: {{'b': sha256(x.b || d.b || x.a), 'a': ''}}).b AS folded_root
            FROM joined
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "op4_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS tie
            FROM documents
        ), dealt AS (
            SELECT *, ('0x' || substring(md5(tie), 1, 8))::BIGINT % (SELECT greatest(1, ceil(sum(size) / 1048576))::BIGINT FROM sized) AS shard FROM sized
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [3, 1, 2][(nth % 3) + 1] AS weight, 2 * source_size AS cap FROM sources
        ), levels AS (
            SELECT *, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total,
                   coalesce(sum(cap) OVER before, 0)::DOUBLE AS spent_before, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS behind
            FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), capping AS (
            SELECT *, spent_before + behind * (cap::DOUBLE / weight) <= total AS capped FROM levels
        ), targets AS (
            SELECT *, CASE WHEN capped THEN cap::DOUBLE
                      ELSE (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)::DOUBLE) * weight / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target
            FROM capping
        ), blocks AS (
            SELECT round(sum(CASE WHEN capped THEN 0 ELSE target END) / 16)::BIGINT AS n FROM targets
        ), quotients AS (
            SELECT source, nth, unnest(range(0, (cap // 16)::BIGINT)) AS k, target FROM targets WHERE NOT capped
        ), seats AS (
            SELECT source, count(*) AS seats FROM (
                SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth, k) AS r FROM quotients) WHERE r <= (SELECT n FROM blocks) GROUP BY source
        ), shards AS (
            SELECT d.source, shard, sum(size)::BIGINT AS words FROM dealt d GROUP BY d.source, shard
        ), shard_quotients AS (
            SELECT h.source, shard, seats, words, unnest(range(0, (2 * words // 16)::BIGINT)) AS k FROM shards h JOIN seats s ON s.source IS NOT DISTINCT FROM h.source
        ), quotas AS (
            SELECT source, shard, count(*) AS quota FROM (
                SELECT *, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS r FROM shard_quotients) WHERE r <= seats GROUP BY source, shard
        ), takes AS (
            SELECT h.source, h.shard, words, t.source_size, t.target,
                   CASE WHEN capped THEN 2 * words ELSE least(coalesce(quota, 0) * 16, 2 * words) END AS take,
                   CASE WHEN words > 0 THEN ('0x' || substring(md5('7|' || coalesce(h.source, '') || '|' || h.shard), 1, 8))::BIGINT % words // 16 * 16 ELSE 0 END AS first
            FROM shards h JOIN targets t ON t.source IS NOT DISTINCT FROM h.source LEFT JOIN quotas q ON q.source IS NOT DISTINCT FROM h.source AND q.shard = h.shard
        ), placed AS (
            SELECT d.doc_id, d.size, t.*, CASE WHEN words > 0 THEN take // words ELSE 0 END AS rounds,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY tie, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM dealt d JOIN takes t ON t.source IS NOT DISTINCT FROM d.source AND t.shard = d.shard
        ), runs AS (
            SELECT *, take - rounds * words AS rest FROM placed
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (rounds * size + greatest(least(start + size, first + rest) - greatest(start, first), 0)
                + greatest(least(start + size, first + rest - words) - greatest(start, 0), 0))::BIGINT AS taken
        FROM runs""",
    "op2_url_filters": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(rule, h, p, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), best AS (
            SELECT *, (SELECT max(printf('%05d', length(r.rule)) || r.rule) FROM rules r
                       WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS b
            FROM p
        )
        SELECT page_id, host, path, substring(b, 6) AS rule,
               coalesce((SELECT verdict FROM rules r WHERE r.rule = substring(b, 6)), 'allow') AS verdict
        FROM best""",
    "op6_minhash_neardup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), each AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 2, len(w))], ' ') AS s FROM each
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        ), component AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
}
