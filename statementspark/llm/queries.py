"""The thin queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_words, materialize, table


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_templates

    found = line_templates.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"))


def op2_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source"), F.col("doc_id").cast("long").alias("doc_id"), count_words(F.col("text")).alias("size"))
    mixed = mixing.expand(mixing.mix_classes(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    alphabet = 50_257  # ids of this vocabulary
    blocks = token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), alphabet)
    return token_files.read_ids(blocks, alphabet)


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamming

    coded = materialize(hamming.codes(table(spark, sf_dir, "embeddings")), "mih-coded")
    return hamming.search(coded, coded.where("id % 50 = 0"))


def op6_pack_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    found = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    langs, model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, langs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def op11_grammar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    same = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    rows = rows.unionByName(own)
    back = chat_format.read_back(chat_format.format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "identical",
    )


def op12_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return turn_repair.repair_conversations(turn_repair.damage(rows))


def op13_jumping_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that op2 mixes to."""
    from . import mixing

    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(count_words(F.col("text"))).alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns of op4 find, without its models."""
    from . import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"), None)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and fixed limits of op7, without its learned rules."""
    from . import quality

    stats = quality.counts(table(spark, sf_dir, "documents")).withColumn("base_failed", quality.base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_OPS = (op1_line_templates, op2_mix_pivotal, op3_token_files, op4_markov_secrets, op5_multi_index_hashing, op6_pack_bin_slack, op7_decision_list, op8_simhash_trie, op9_text_to_tag, op10_language_mixture, op11_grammar_chat, op12_dial_repair, op13_jumping_trie)
QUERIES = {f.__name__: f for f in (*_OPS, mix_targets, secret_counts, quality_counts)}

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CHAT = "</s>[INST] ok [/INST]"
_ESCAPED = r"<\\*(?:<SYS>>|</SYS>>|s>|/s>)|\[\\*(?:INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\])"
_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n) ORDER BY n) AS crc_table FROM range(256) AS t(n)"


def _crc(text: str) -> str:
    """DuckDB: unsigned crc32 of an ASCII text."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(crc_table[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"


def _add(s: str, cost: object, edit: str) -> str:
    return f"lpad(CAST(CAST({s}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {s}[7:] || '{edit}'"


#: The parts of operators that SQL can express; trained models, seeded draws, XXH64, tokenizers and markup it cannot.
SQL: dict[str, str] = {
    "mix_targets": f"""
WITH d AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 2.0 AS cap FROM d),
r AS (SELECT *, row_number() OVER o AS k, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT arg_min(rate, k) FILTER (rate * w < cap) AS rate FROM r)
SELECT source, source_size, round(CASE WHEN f.rate IS NULL THEN cap ELSE least(cap, f.rate * w) END, 3) AS target FROM r, f""",
    "secret_counts": f"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda v: length(v) >= 6)) AS n_assign,
 len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access,
 len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex FROM documents""",
    "quality_counts": f"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM r),
n AS (SELECT r, i, array_to_string(w[i:i + 4], chr(1)) AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM r) AS x),
again AS (SELECT r, i FROM n QUALIFY count(*) OVER (PARTITION BY r, five) >= 2),
c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM again, range(5) AS t(j) GROUP BY r),
k AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN c USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM k""",
    "op11_grammar_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{_CHAT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + len(regexp_extract_all(role, '{_ESCAPED}')) END) AS BIGINT) AS formatted_chars, true AS identical
FROM t GROUP BY conv_id""",
    "op12_dial_repair": f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE f <> 0),
r AS (SELECT *, row_number() OVER w AS pos, lag(role[1]) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
g AS (SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN k > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM r),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- Least cost and audit to each state, as one string that sorts as they do.
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000002I' AS s2, '000004II' AS s3 FROM ids
 UNION ALL SELECT conv_id, pos, n0, n1, m2, least(n3, {_add("m2", 2, "I")}) FROM (SELECT *, least(n2, {_add("n0", 2, "I")}, {_add("n1", 2, "I")}, {_add("n3", 2, "I")}) AS m2 FROM (
  SELECT conv_id, pos, {_add("s0", 3, "D")} AS n0, least({_add("s1", 3, "D")}, CASE WHEN keeps AND c = 's' THEN {_add("s0", "t", "K")} END) AS n1,
   least({_add("s2", 3, "D")}, CASE WHEN keeps THEN {_add("o", "2 + t", "R")} END, CASE WHEN keeps AND c = 'u' THEN {_add("o", "t", "K")} END) AS n2,
   least({_add("s3", 3, "D")}, CASE WHEN keeps THEN {_add("s2", "2 + t", "R")} END, CASE WHEN keeps AND c = 'a' THEN {_add("s2", "t", "K")} END) AS n3
  FROM (SELECT p.conv_id, g.pos, s0, s1, s2, s3, least(s0, s1, s3) AS o, c, fault NOT IN ('b', 'd') AS keeps, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t FROM p JOIN g ON g.conv_id = p.conv_id AND g.pos = p.pos + 1))))
, best AS (SELECT conv_id, arg_max(least(s0, s3), pos) AS s FROM p GROUP BY 1),
a AS (SELECT conv_id, generate_subscripts(string_split(s[7:], ''), 1) AS j, unnest(string_split(s[7:], '')) AS edit FROM best WHERE length(s) > 6),
i AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS pos FROM a),
o AS (SELECT i.conv_id, j, edit, role, text, row_number() OVER w AS o, first_value(edit = 'K' AND c = 's') OVER w AS led FROM i LEFT JOIN g ON g.conv_id = i.conv_id AND g.pos = i.pos AND edit <> 'I' WHERE edit <> 'D' WINDOW w AS (PARTITION BY i.conv_id ORDER BY j)),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' WHEN edit = 'R' THEN text ELSE text END, chr(10) ORDER BY j) AS whole FROM o GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(s[1:6] AS BIGINT) AS cost, s[7:] AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids JOIN best USING (conv_id) LEFT JOIN n USING (conv_id) LEFT JOIN z USING (conv_id)""",
    "op13_jumping_trie": f"""
WITH crc AS ({_CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations),
c AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS f, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc),
r AS (SELECT c, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = f WHERE i < h UNION ALL SELECT c, 1, i, role, text FROM c JOIN t ON t.conv_id = c WHERE i >= h),
l AS (SELECT c, list([role, text] ORDER BY part, i) AS turns FROM r GROUP BY c),
s AS (SELECT c.c, coalesce(turns, []) AS turns FROM c LEFT JOIN l USING (c)),
m AS (SELECT c, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
n AS (SELECT depth, turns[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(array_to_string(list(c ORDER BY c) FILTER (size = depth), ','), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, count(x.depth) AS n_children FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1] LEFT JOIN n x ON x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path GROUP BY ALL),
v AS (SELECT path, unnest(range(depth + 1)) AS up, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth][2]) END AS saved FROM k),
u AS (SELECT up AS depth, path[1:up] AS path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM v GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN u USING (depth, path)""",
}
