"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, dedup, divergence, license, mix, near, quality, repair, shard, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classify(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(more))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out("id"))
    return quality.score(docs, model)


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.place(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link(_table(spark, sf_dir, "documents"), similarity=0.85)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: conversations damaged row by row, as a hash of identifier and turn decides; nulls are one space."""
    held = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(held["conv_id"], F.lit(":"), held["turn"])) % 20
    made = rows.select("conv_id", "turn", held["role"].alias("role"), held["text"].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return made.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(damaged(_table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.account(_table(spark, sf_dir, "documents"), mix.in_turn(3, 1, 2)).drop("source")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_exact_dedup,
        op4_chat_format,
        op5_token_counts,
        op6_quality,
        op7_minimax_shards,
        op8_near_dedup,
        op9_bpe,
        op10_toxicity,
        op11_conversation_repair,
        op12_source_divergence,
        op13_mix,
    )
}

def _state(*offers: str) -> str:
    """The least of the offered states, NULL where none can be reached."""
    return f"least({', '.join(offers)})" if len(offers) > 1 else offers[0]


def _edit(state: str, cost: str, letter: str, turn: str, when: str = "true") -> str:
    """A state is cost (9 digits), audit, chr(1), turns; this one comes from `state` by one edit."""
    told = f"|| CASE WHEN substr({state}, strpos({state}, chr(1)) + 1) = '' THEN '' ELSE chr(10) END || {turn}" if turn else ""
    return (
        f"CASE WHEN {when} AND {state} IS NOT NULL THEN printf('%09d', substr({state}, 1, 9)::INTEGER + {cost}) || substr({state}, 10, strpos({state}, chr(1)) - 10) || '{letter}'"
        f" || substr({state}, strpos({state}, chr(1))) {told} END"
    )


_KEPT = {2: [("q0", "u"), ("q1", "u"), ("q3", "u")], 3: [("q2", "a")], 1: [("q0", "s")]}
_MUST = "fault NOT IN ('blank', 'duplicate')"
_MORE = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_NEW = {
    k: _state(
        _edit(f"q{k}", "2", "D", ""),
        *(_edit(q, _MORE, "K", "role || ':' || text", f"{_MUST} AND left(role, 1) = '{i}'") for q, i in _KEPT.get(k, [])),
        *(_edit(q, f"1 + {_MORE}", "R", f"'{'assistant' if k == 3 else 'user'}:' || text", f"{_MUST} AND left(role, 1) <> '{i}'") for q, i in _KEPT.get(k, []) if i != "s"),
    )
    for k in range(4)
}
_INSERTS = {2: ("r0", "r1", "r3"), 3: ("r2",)}


def _closed(source: str) -> str:
    """SELECT of a layer after one round of inserts."""
    made = {k: _state(f"r{k}", *(_edit(q, "5", "I", f"'{'assistant' if k == 3 else 'user'}:'") for q in _INSERTS.get(k, ()))) for k in range(4)}
    return f"SELECT * REPLACE ({', '.join(f'{made[k]} AS r{k}' for k in (2, 3))}) FROM {source}"


#: CRC-32 bit by bit over the bytes of an ASCII string.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({0}) * 8), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({0}, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END)), "
    "lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END))"
)

_REPAIR_SQL = f"""
    WITH RECURSIVE k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
    ), h AS (SELECT *, {_CRC.format('key')} % 20 AS kind FROM k), d AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM h) WHERE kind <> 0
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
            right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ends,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair
        FROM d
    ), f AS (
        SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
    ), w AS (
        SELECT c.conv_id, 0 AS n, '000000000' || chr(1) AS q0, NULL::VARCHAR AS q1, '000000005I' || chr(1) || 'user:' AS q2, '000000010II' || chr(1) || 'user:' || chr(10) || 'assistant:' AS q3 FROM (SELECT DISTINCT conv_id FROM k) c
        UNION ALL
        SELECT conv_id, n, r0, r1, r2, r3 FROM ({_closed(f'({_closed("(SELECT w.conv_id, w.n + 1 AS n, " + ", ".join(f"{_NEW[x]} AS r{x}" for x in range(4)) + " FROM w JOIN f ON f.conv_id = w.conv_id AND f.n = w.n + 1)")})')})
    ), z AS (
        SELECT conv_id, arg_max(least(q0, q3), n) AS best FROM w GROUP BY 1
    ), t AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1
    )
    SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        substr(best, 1, 9)::BIGINT AS cost, substr(best, 10, strpos(best, chr(1)) - 10) AS audit, sha256(substr(best, strpos(best, chr(1)) + 1)) AS repaired_sha256
    FROM z LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS z
            FROM documents
        ), g AS (
            SELECT doc_id, z,
                first_value(doc_id) OVER (PARTITION BY z ORDER BY length(whole) DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY z) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(z) AS text_sha256 FROM g
    """,
    "op4_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *,
                20 + length(regexp_replace(replace(role, '\', '\\'), '[<\[]', '\0\\', 'g'))
                + length(regexp_replace(replace(text, '\', '\\'), '[<\[]', '\0\\', 'g')) AS chars
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_conversation_repair": _REPAIR_SQL,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
        c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        l AS (SELECT lang, sum(total) AS n_lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
        s AS (SELECT lang, source, sum(n) AS n_source FROM c GROUP BY 1, 2),
        g AS (SELECT DISTINCT lang, source FROM d),
        h AS (SELECT g.lang, g.source, coalesce(n_source, 0)::HUGEINT AS n_source, n_lang::HUGEINT AS n_lang, coalesce(v, 0)::HUGEINT AS v FROM g LEFT JOIN l USING (lang) LEFT JOIN s USING (lang, source)),
        a AS (
            SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (n_source + v) AS p, 1 + (1000000000 * (total + 1)) // (n_lang + v) AS q
            FROM h JOIN k USING (lang) LEFT JOIN c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term
        ), t AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM a WHERE n > 0 AND p > q
        ), b AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
            FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 4
        ), z AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(b.value, 0) AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
        ), u AS (SELECT * FROM t UNION ALL SELECT * FROM z)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 200
    """,
    "op13_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), p AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size) AS place FROM d),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
                ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight
            FROM p GROUP BY 1
        ), r AS (
            SELECT *, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s
        ), f AS (SELECT *, cap / weight <= (budget - capped) / free AS topped FROM r),
        t AS (
            SELECT source, source_size, CASE WHEN topped THEN cap ELSE (budget - coalesce(sum(cap) FILTER (topped) OVER (), 0)) * weight / sum(weight) FILTER (NOT topped) OVER () END AS target FROM f
        ), l AS (
            SELECT p.*, source_size, target, floor(target)::BIGINT AS e,
                coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, greatest(0, least(a + size, e) - a) + greatest(0, least(source_size + a + size, e) - source_size - a) AS taken FROM l
    """,
}
