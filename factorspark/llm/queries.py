"""The registered queries of the dealt operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced_mix, bpe, byte_cnn, dedup, merkle, neighbours, ngram_lm, packing, quality_rules, quotation, spelling, url_filter
from . import secrets as secret_scan
from .common import durable, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, from the package that every node has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = durable(secret_scan.candidates(read_table(spark, folder, "documents")), "secret-candidates")
    dictionary = secret_scan.dictionary_of(read_table(spark, folder, "benchmark"))
    forest = secret_scan.trained(secret_scan.labelled(found), dictionary)
    return secret_scan.judged(found, forest).select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


@query
def op3_byte_cnn_quality(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.judged(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@query
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.components(read_table(spark, folder, "documents"))


@query
def op7_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.judged(read_table(spark, folder, "documents"))


@query
def op8_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotation.conversations(read_table(spark, folder, "conversations"))


def _op8_sql() -> str:
    levels, attribution = quotation.LEVELS, quotation.ATTRIBUTION
    own = f"list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{levels}') AND NOT regexp_matches(x, '{attribution}'))"
    return f"""
    WITH RECURSIVE messages AS (SELECT row_number() OVER () AS message, conv_id, turn, string_split(text, chr(10)) AS cut FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
    lines AS (SELECT message, conv_id, turn, unnest(cut) AS line, unnest(range(len(cut))) AS pos FROM messages),
    levels AS (
      SELECT message, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '{levels}', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(line, '{levels}', '')), '[ \t\r\f\v]+', ' ', 'g')) AS passage FROM lines),
    runs AS (
      SELECT conv_id, turn, level, string_agg(passage, ' ' ORDER BY pos) AS passage, count(*) AS n FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY message, level ORDER BY pos) AS run FROM levels WHERE passage <> '') GROUP BY message, conv_id, turn, level, run),
    passages AS (
      SELECT conv_id, turn, level, passage FROM levels WHERE length(passage) >= {quotation.LEAST}
      UNION ALL SELECT conv_id, turn, level, passage FROM runs WHERE n > 1 OR length(passage) < {quotation.LEAST}),
    said AS (SELECT conv_id, passage, min(turn) AS source FROM passages WHERE level = 0 GROUP BY 1, 2),
    votes AS (
      SELECT q.conv_id, q.turn, q.level, s.source, sum(length(q.passage)) AS votes
      FROM passages q JOIN said s ON q.conv_id = s.conv_id AND q.passage = s.passage WHERE q.level > 0 AND s.source < q.turn GROUP BY 1, 2, 3, 4),
    linked AS (
      SELECT conv_id, turn, source AS parent_turn
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, source DESC) AS place FROM votes) WHERE place = 1),
    walk(conv_id, turn, parent_turn, root_turn, depth) AS (
      SELECT conv_id, turn, parent_turn, parent_turn, 1 FROM linked
      UNION ALL
      SELECT w.conv_id, w.turn, w.parent_turn, l.parent_turn, w.depth + 1 FROM walk w JOIN linked l ON l.conv_id = w.conv_id AND l.turn = w.root_turn),
    threads AS (SELECT conv_id, turn, min(parent_turn) AS parent_turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM walk GROUP BY 1, 2),
    own AS (
      SELECT c.conv_id, c.turn, c.role, t.parent_turn, COALESCE(t.root_turn, c.turn) AS root_turn, CAST(COALESCE(t.depth, 0) AS BIGINT) AS depth,
             CASE WHEN regexp_matches(text, '(?m){levels}') THEN trim(array_to_string({own}, chr(10)), chr(10)) ELSE text END AS text
      FROM conversations c LEFT JOIN threads t ON c.conv_id = t.conv_id AND c.turn = t.turn)
    SELECT conv_id, turn, role, text, parent_turn, root_turn, depth,
           row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
           '<|' || COALESCE(role, 'unknown') || '|>' || chr(10) || COALESCE(text, '') || chr(10) || '<|end|>' AS chat
    FROM own"""


SQL["op8_quotation_linking"] = _op8_sql()


@query
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, folder, "embeddings"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return url_filter.judged(pages, url_filter.listed_of(pages))


def _op10_sql() -> str:
    """The exact answer without the Bloom filter: rules, then membership in the list of canonical URLs."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    name = verdict = "NULL"
    for rule in sorted(url_filter.RULES, key=lambda r: (len(r.name), r.name)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        name, verdict = f"CASE WHEN {fits} THEN '{rule.name}' ELSE {name} END", f"CASE WHEN {fits} THEN '{rule.verdict}' ELSE {verdict} END"
    words, parameters = "|".join(url_filter.LISTED_WORDS), "|".join(url_filter.LISTED_PARAMETERS)
    return f"""
    WITH rest AS (
      SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
    parts AS (SELECT page_id, url, {lower.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
    keyed AS (
      SELECT page_id, url, host, path, {name} AS rule, {verdict} AS ruled,
             regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '([.]html|/)+$', '') AS canonical FROM parts),
    listed AS (SELECT DISTINCT canonical FROM keyed
               WHERE host <> '' AND (regexp_matches(host, '(^|[.-])({words})([.-]|$)') OR regexp_matches(url, '[?&]({parameters})=')))
    SELECT k.page_id, k.host, k.path, k.rule, l.canonical IS NOT NULL AS listed,
           COALESCE(k.ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM keyed k LEFT JOIN listed l ON k.canonical = l.canonical AND k.ruled IS NULL AND k.host <> ''"""


SQL["op10_url_filter"] = _op10_sql()


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audited(read_table(spark, folder, "documents"))


def _op11_sql() -> str:
    """Lists of nodes, level by level; siblings by position; the leaf folded with them in a recursion."""

    def leaf(text: str) -> str:
        fields = [f"COALESCE(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    digits = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
    bits = f"list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: {step})"
    crc = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda crc, byte: {bits})"
    parents = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
    return f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, source, {leaf('text')} AS leaf, {leaf("replace(text, chr(10), '')")} AS altered, {crc} % 2 = 1 AS tampered FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
    levels(source, level, nodes) AS (
      SELECT source, 0, list(leaf ORDER BY place) FROM placed GROUP BY source
      UNION ALL SELECT source, level + 1, {parents} FROM levels WHERE len(nodes) > 1),
    tops AS (SELECT source, max(level) AS height, arg_max(nodes, level)[1] AS subroot FROM levels GROUP BY source),
    sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS source_place FROM tops),
    upper_levels(level, nodes) AS (
      SELECT 0, list(subroot ORDER BY source_place) FROM sources
      UNION ALL SELECT level + 1, {parents} FROM upper_levels WHERE len(nodes) > 1),
    top AS (SELECT max(level) AS top_height, arg_max(nodes, level)[1] AS root FROM upper_levels),
    runs AS (
      SELECT p.doc_id, p.leaf, p.place, p.source, l.level, CAST(p.place // CAST(pow(3, l.level) AS BIGINT) AS BIGINT) AS pos, l.nodes
      FROM placed p JOIN levels l ON p.source IS NOT DISTINCT FROM l.source AND len(l.nodes) > 1
      UNION ALL
      SELECT p.doc_id, p.leaf, p.place, p.source, s.height + l.level, CAST(s.source_place // CAST(pow(3, l.level) AS BIGINT) AS BIGINT), l.nodes
      FROM placed p JOIN sources s ON p.source IS NOT DISTINCT FROM s.source JOIN upper_levels l ON len(l.nodes) > 1),
    sides AS (
      SELECT source, place, level, array_to_string(nodes[pos - pos % 3 + 1:pos], '') AS before, array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '') AS after FROM runs),
    fold(source, place, level, node, proof) AS (
      SELECT source, place, 0, CASE WHEN tampered THEN altered ELSE leaf END, '' FROM placed
      UNION ALL
      SELECT f.source, f.place, f.level + 1, sha256(s.before || f.node || s.after), f.proof || s.before || s.after
      FROM fold f JOIN sides s ON f.source IS NOT DISTINCT FROM s.source AND f.place = s.place AND f.level = s.level),
    ends AS (SELECT source, place, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY source, place)
    SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
    FROM placed p JOIN sources s ON p.source IS NOT DISTINCT FROM s.source JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.place = e.place JOIN top t ON true"""


SQL["op11_merkle_manifest"] = _op11_sql()


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read_table(spark, folder, "documents"))


@query
def op13_balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_mix.mixed(read_table(spark, folder, "documents"))
