"""The queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm._common import read_table


def public_tokenizer(name: str) -> str:
    """The path of one of the public tokenizer files that are installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_output import token_output

    return token_output(read_table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.winnowing import edited_likeness

    return edited_likeness(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(read_table(spark, sf_dir, "documents"), window=400)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.near_dup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import learn, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, read_table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import remove_repeated_words

    return remove_repeated_words(read_table(spark, sf_dir, "documents"), window=35)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.conversation_repair import repair_damaged

    return repair_damaged(read_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ranked_search import ranked_search

    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_winnowing": op2_winnowing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}
#: Words that are covered by a window of 35 whose sequence starts anywhere else are left out.
_REPEATED_WORDS = """WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
grams AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS g FROM starts),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM grams) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
words AS (SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)"""


def _repaired() -> str:
    """Damage, faults, and the cheapest edits by a walk over the turns that keeps, for each last role, the cheapest audit so far.

    A state is one string, nine digits of cost and then the audit, so that the least string is the cheapest and then least in ASCII.
    """
    add = lambda state, cost, edit: f"(printf('%09d', CAST(left({state}, 9) AS BIGINT) + ({cost})) || substr({state}, 10) || '{edit}')"
    before_user, before_assistant = f"least(z, s, a, {add('u', 5, 'I')})", f"least(u, {add('z', 5, 'I')}, {add('s', 5, 'I')}, {add('a', 5, 'I')})"
    keep = lambda state, initial: f"CASE WHEN fault IN (0, 3) AND r = '{initial}' THEN {add(state, 'm', 'K')} END"
    rerole = lambda state: f"CASE WHEN fault IN (0, 3) THEN {add(state, 'm + 1', 'R')} END"
    crc = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, {crc} % 20 AS h FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE h <> 0),
placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM placed),
priced AS (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS m FROM faulty),
states AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM conversations
UNION ALL SELECT d.conv_id, d.i + 1, {add('z', 2, 'D')}, least({add('s', 2, 'D')}, {keep('z', 's')}),
  least({add('u', 2, 'D')}, {keep(before_user, 'u')}, {rerole(before_user)}), least({add('a', 2, 'D')}, {keep(before_assistant, 'a')}, {rerole(before_assistant)})
  FROM states d JOIN priced p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i + 1),
whole AS (SELECT conv_id, least(z, {add('s', 10, 'II')}, {add('u', 5, 'I')}, a) AS best FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
letters AS (SELECT conv_id, p, substr(best, CAST(9 + p AS BIGINT), 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS p FROM whole)),
numbered AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
met AS (SELECT n.conv_id, n.p, n.e, CASE WHEN n.e <> 'I' THEN t.role END AS role, CASE WHEN n.e = 'I' THEN '' ELSE t.text END AS text, CASE WHEN n.e = 'K' AND t.r = 's' THEN 0 ELSE 1 END AS spoken
  FROM numbered n LEFT JOIN placed t ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.i = n.i WHERE n.e <> 'D'),
said AS (SELECT *, sum(spoken) OVER (PARTITION BY conv_id ORDER BY p) AS nth FROM met),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM said GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (last IS NOT NULL AND last || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM whole w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM w.conv_id"""


def _ranked() -> str:
    """The score of every document with a term of the item."""
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents),
whole AS (SELECT count(*) AS big_n, CAST(coalesce(sum(len(ws)), 0) AS BIGINT) AS big_l FROM docs WHERE len(ws) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct({words('text')}) AS ts FROM benchmark),
asked AS (SELECT q, item_id, unnest(ts) AS term FROM items),
each AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM docs),
posts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
parts AS (SELECT r, doc_id, term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS part FROM posts JOIN dfs USING (term), whole),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores) WHERE rank <= 50"""


ORACLE_SQL: dict[str, str] = {"op10_substring_dedup": _REPEATED_WORDS, "op11_conversation_repair": _repaired(), "op12_ranked_search": _ranked()}
